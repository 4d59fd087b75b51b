"""Stored keyed tables: what an upsert, a lookup and an expiry touch."""

import os

from pyspark.sql import functions as F

from kinloom.sources import store


def files(path):
    return {os.path.join(os.path.basename(d), f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "kv")
    rows = spark.range(200).selectExpr("id as key", "concat('v', id) as value", "0 as turn")
    store.save_keyed(rows, path, ["key"], 16)
    before = files(path)
    new = spark.createDataFrame([(3, "new", 1), (3, "older", 0), (1000, "added", 1)], "key long, value string, turn int")
    touched = {r["bucket"] for r in store._bucketed(new, ["key"], 16).collect()}
    store.upsert_keyed(spark, path, new, ["key"], [F.desc("turn")], 16)
    after = files(path)
    kept = {k for k, at in before.items() if after.get(k) == at}
    assert {int(k.split("=")[1].split("/")[0]) for k in before.keys() - kept} == {b for b in touched if any(f"bucket={b}/" in k for k in before)}
    got = {r.key: r.value for r in store.load_keyed(spark, path).collect()}
    assert len(got) == 201 and got[3] == "new" and got[1000] == "added" and got[4] == "v4"
    asked = store.get_keyed(spark, path, spark.createDataFrame([(3,), (4,), (5000,)], "key long"), ["key"], 16)
    assert {r.key for r in asked.collect()} == {3, 4}
    assert "PartitionFilters: [bucket" in asked._jdf.queryExecution().toString().replace("isnotnull(bucket", "bucket") or "bucket#" in asked._jdf.queryExecution().toString()


def test_expiry_drops_rows_and_empty_buckets(spark, tmp_path):
    path = str(tmp_path / "ttl")
    at = lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp")
    rows = spark.range(40).select(F.col("id").alias("key"), F.when(F.col("id") % 4 == 0, at(1)).when(F.col("id") % 4 == 1, at(9)).alias("expires_at"))
    store.save_keyed(rows, path, ["key"], 64)
    before = files(path)
    store.expire_keyed(spark, path, at(5), buckets=64)
    assert {r.key for r in store.load_keyed(spark, path).collect()} == {i for i in range(40) if i % 4}
    after = files(path)
    assert all(after[k] == before[k] for k in after if k in before)
    store.expire_keyed(spark, path, at(5), buckets=64)  # nothing left to do
    assert files(path) == after
