"""Files, versions, jobs and users as tables; jobs are event-sourced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.schema import ACTIVE, FINISHED


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def job_state(events: DataFrame) -> DataFrame:
    """One row for each job: its last status and progress, when it was created, first run and finished, and its duration in seconds.

    A pre-aggregated pass, so that a job of very many events costs no more than any other.
    """
    done = F.col("status").isin(*FINISHED)
    last = F.max(F.struct("at", "seq", "status", "progress"))
    out = events.groupBy("job_id").agg(last.alias("last"), F.min("at").alias("created_at"), F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"), F.max(F.when(done, F.col("at"))).alias("finished_at"))
    finished = F.when(F.col("last.status").isin(*FINISHED), F.col("finished_at"))
    return out.select("job_id", F.col("last.status").alias("status"), F.col("last.progress").alias("progress"), F.col("last.at").alias("updated_at"), "created_at", "started_at", finished.alias("completed_at"), ((F.unix_micros(finished.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6).alias("duration"))


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE))


def old_finished(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    return jobs.where(F.col("status").isin(*FINISHED) & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")))


def job_stats(jobs: DataFrame, *by: str) -> DataFrame:
    """Jobs by status, and the sum and mean of non-zero durations."""
    d = F.when(F.col("duration") != 0, F.col("duration"))
    return jobs.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running")], F.sum(d).alias("total_duration"), F.avg(d).alias("average_duration"))


def with_file(jobs: DataFrame, files: DataFrame) -> DataFrame:
    return jobs.join(files.select("file_id", "filename"), "file_id", "left")


def with_current_size(files: DataFrame, versions: DataFrame) -> DataFrame:
    current = versions.select(F.col("version_id").alias("current_version_id"), "file_size", "row_count")
    return files.join(current, "current_version_id", "left")


def current_versions(versions: DataFrame) -> DataFrame:
    return latest(versions, ["file_id"], [F.desc("version_number"), F.desc("version_id")])


def file_stats(files: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Versions, jobs and stored bytes of each file, counted rather than kept."""
    v = versions.groupBy("file_id").agg(F.count("*").alias("total_versions"), F.sum("file_size").alias("storage_used"), F.max("version_number").alias("last_version"))
    j = jobs.groupBy("file_id").agg(F.count("*").alias("total_jobs"))
    return files.select("file_id").join(v, "file_id", "left").join(j, "file_id", "left").fillna(0, ["total_versions", "storage_used", "last_version", "total_jobs"])


def user_stats(files: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    f = files.join(versions.groupBy("file_id").agg(F.sum("file_size").alias("bytes")), "file_id", "left").groupBy("user_id").agg(F.count("*").alias("total_files"), F.sum("bytes").alias("storage_used"))
    j = jobs.groupBy("user_id").agg(F.count("*").alias("total_jobs"), F.count_if(F.col("status") == "completed").alias("total_analyses"), F.max("updated_at").alias("last_activity"))
    return f.join(j, "user_id", "full").fillna(0, ["total_files", "storage_used", "total_jobs", "total_analyses"])


def owned(files: DataFrame, user: str) -> DataFrame:
    return files.where(F.col("user_id") == user)


def newest(df: DataFrame, at: str, key: str, n: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(at), key)
    return out.limit(n) if n else out


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns and an order-free checksum of the rows."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("row_count"), F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")).alias("checksum")).withColumn("column_count", F.lit(len(df.columns)))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row counts and the columns that came and went."""
    a, b = old.agg(F.count("*").alias("old_rows")), new.agg(F.count("*").alias("new_rows"))
    names = lambda x, y: F.array(*[F.lit(c) for c in sorted(set(x.columns) - set(y.columns))]).cast("array<string>")
    return a.crossJoin(b).withColumns({"added_columns": names(new, old), "removed_columns": names(old, new)})


def keyed_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of rows added, removed or modified: one full join of the keys and row digests."""
    both = [c for c in old.columns if c in new.columns and c != key]
    digest = F.xxhash64(*both)
    a, b = old.select(key, digest.alias("_a"), F.lit(1).alias("_o")), new.select(key, digest.alias("_b"), F.lit(1).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


# --- writes: every function returns the table's next state; events are only appended ---


def versions_of(versions: DataFrame, file_id: str) -> DataFrame:
    """A file's versions, the first one first."""
    return versions.where(F.col("file_id") == file_id).orderBy("version_number", "version_id")


def versions_in_order(versions: DataFrame) -> DataFrame:
    """All files' versions with their place in the file's history (1 for the first)."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("version_number", "version_id")))


def with_version(versions: DataFrame, added: DataFrame) -> DataFrame:
    """The versions and those added: (version_id, file_id, ...) numbered on from each file's last."""
    last = versions.groupBy("file_id").agg(F.max("version_number").alias("_last"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("version_id"))
    new = added.join(last, "file_id", "left").withColumn("version_number", (F.coalesce("_last", F.lit(0)) + place).cast(versions.schema["version_number"].dataType)).drop("_last")
    return versions.unionByName(new, allowMissingColumns=True)


def with_file_added(files: DataFrame, versions: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and versions with new files (file_id, current_version_id, ...), each with its first version."""
    first = added.select("file_id", F.col("current_version_id").alias("version_id"))
    return files.unionByName(added, allowMissingColumns=True), with_version(versions, first)


def without_files(files: DataFrame, versions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and versions without the given files (file_id)."""
    ids = gone.select("file_id").distinct()
    return files.join(ids, "file_id", "left_anti"), versions.join(ids, "file_id", "left_anti")


def job_event(jobs: DataFrame, status: str, at: Column, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """(job_id, status, at) to append for jobs whose present status is among `allowed` (any, if None)."""
    own = jobs.where(F.col("status").isin(*allowed)) if allowed else jobs
    return own.select("job_id", F.lit(status).alias("status"), at.alias("at"))


def created(new: DataFrame, at: Column) -> DataFrame:
    """First events of new jobs (job_id, user_id, file_id, ...): pending, without progress; a row without an id gets one."""
    own = new if "job_id" in new.columns else new.withColumn("job_id", F.lit(None).cast("string"))
    return own.withColumns({"job_id": F.coalesce("job_id", F.expr("uuid()")), "status": F.lit("pending"), "progress": F.lit(0.0), "at": at})


def progressed(jobs: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """Events for updates (job_id, progress) of jobs that exist: the status stays, progress is held within 0 and 100."""
    own = jobs.select("job_id", "status").join(updates.select("job_id", "progress"), "job_id")
    return own.select("job_id", "status", F.greatest(F.lit(0.0), F.least(F.lit(100.0), "progress")).alias("progress"), at.alias("at"))


def moved(jobs: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """Events for updates (job_id, status, message) of jobs that exist; the message stays with failures alone."""
    own = jobs.select("job_id", "progress").join(updates.select("job_id", "status", "message"), "job_id")
    return own.select("job_id", "status", "progress", at.alias("at"), F.when(F.col("status") == "failed", F.col("message")).alias("error_message"))


def with_results(jobs: DataFrame, results: DataFrame, stored: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Events that complete the jobs of `results` (job_id, result_data, ...), and the table of results with theirs, a job's last one only."""
    own = results.join(jobs.select("job_id", "progress"), "job_id")
    events = own.select("job_id", F.lit("completed").alias("status"), "progress", at.alias("at"), "result_data")
    kept = stored.join(own.select("job_id"), "job_id", "left_anti")
    return events, kept.unionByName(own.drop("progress"), allowMissingColumns=True)


def without_jobs(events: DataFrame, stored: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and results without the given jobs (job_id)."""
    ids = gone.select("job_id").distinct()
    return events.join(ids, "job_id", "left_anti"), stored.join(ids, "job_id", "left_anti")


def cancelled(jobs: DataFrame, at: Column) -> DataFrame:
    """Events that cancel what is still active."""
    return job_event(jobs, "cancelled", at, ACTIVE)


def restarted(jobs: DataFrame, at: Column) -> DataFrame:
    """Events that queue failed jobs again; no others may be restarted."""
    return job_event(jobs, "queued", at, ("failed",))


def without_old(events: DataFrame, jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """The events without those of jobs finished that were created over `days` days ago."""
    return events.join(old_finished(jobs, now, days).select("job_id"), "job_id", "left_anti")
