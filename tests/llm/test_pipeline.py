"""The pipeline against plain Python on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from kinloom.llm import pieces, secrets
from kinloom.llm.common import table
from tests.llm.test_operators import brute_components, shingle_set, words


def test_pipeline_equals_plain_stages(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    own = {r.doc_id for r in cp.identify_language(spark, table(spark, sf, "documents"), sf).collect()}
    assert {i for i, r in docs.items() if any(c.isalpha() for c in r.text)} == own
    _, at = brute_components([(i, docs[i].text) for i in sorted(own)])
    kept = {i for i in own if at[i] == i}
    items = [" ".join(words(r.text)) for r in table(spark, sf, "benchmark").collect()]
    clean = {i for i in kept if not any(f" {x} " in f" {' '.join(words(docs[i].text))} " for x in items)}
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert got.keys() == clean and len(clean) < len(kept) < len(docs)
    back = {r.doc_id: r.text for r in pieces.decoded(cp.run(spark, sf), pieces.load(), ["doc_id"]).collect()}
    for i, r in got.items():
        text = secrets.redact(docs[i].text)
        assert back[i] == text and r.n_chars == len(text) and r.exact and (r.lang, r.source) == (docs[i].lang, docs[i].source)
    assert shingle_set("") == set()


NAMES = "ids n_pieces n_bytes exact doc n u v g w m sig bands label node rep k1 k2 t t2 far held_out digest lang_pred score component_id kept n_shingles spans base_sha256 item_id similarity first_word _text _ids bucket chunk copy deal hub hubs to from".split()


def test_stages_keep_columns_and_take_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("source", "label")
    docs = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in docs.columns])
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name
        got = stage(spark, docs, sf)
        if name != cp.STAGES[-1][0]:
            assert got.columns == docs.columns, name
        else:
            assert got.columns == [*(c for c in docs.columns if c != "text"), "ids_", "n_pieces_", "n_bytes_", "exact_"]
        kept = got.select("doc_id", "label", *NAMES).limit(5).collect()
        assert kept and all(r[n] == i for r in kept for i, n in enumerate(NAMES) if n != "label"), name


def test_stages_with_repeated_and_null_ids(spark, sf):
    """Rows without an id and rows that repeat one are documents of their own: copies go, other texts stay."""
    long = [" ".join(f"{w}{k}" for w in "the house on the green hill by the old river bank where people walk".split()) for k in range(6)]
    rows = [(None, long[0]), (None, long[1]), (None, long[0]), (None, None), (None, None), (7, long[2]), (7, long[3]), (7, long[2]), (8, long[3]), (9, ""), (9, ""), (10, long[4]), (2, long[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or -1, r.text) for r in cp.drop_near_duplicates(spark, docs, sf).collect()), key=repr)
    assert got == sorted([(-1, long[0]), (-1, long[1]), (-1, None), (-1, None), (7, long[2]), (7, long[3]), (9, ""), (9, ""), (2, long[4])], key=repr)
    for name, stage in cp.STAGES:
        if name not in ("language_id", "near_dedup"):
            assert stage(spark, docs, sf).count() == len(rows), name
