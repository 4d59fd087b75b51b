"""Queries over the test tables, each with equivalent DuckDB SQL where SQL can express it.

People are stood in for by `embeddings` (six slices of ten components are the
feature vectors, a digit by label and id the profiles), tag cells by part
names, jobs by events (a job is a user's events of one parity), files by
customers and versions by orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import text as ft
from kinloom.functions.scoring import power_mean
from kinloom.functions.vectors import summed, unit
from kinloom.operators import catalog, community, graph, insights, layout, louvain, pairs, paths, peel, report, search, subgraph, vector_store
from kinloom.operators.pair_graph import PairGraph
from kinloom.schema import COMPLEMENTARITY_WEIGHTS, FEATURES, SIMILARITY_WEIGHTS
from kinloom.scratch import dense_id, folder, written
from kinloom.sources import people, store
from kinloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- stand-ins ------------------------------------------------------------------------------------


def _people(spark: SparkSession, d: str, kind: str = "array<double>") -> DataFrame:
    """person_id, six vectors <feature> and six profiles p_<feature>."""
    rows = dense_id(_t(spark, d, "embeddings"), ["vec_id"], "person_id")
    vec = {f: F.slice("embedding", 1 + 10 * k, 10).cast(kind) for k, f in enumerate(FEATURES)}
    profile = {f"p_{f}": F.concat(F.lit("P"), (F.col("label") + F.col("vec_id") * (k + 1)) % 10) for k, f in enumerate(FEATURES)}
    return rows.select("person_id", "label", *[c.alias(n) for n, c in (vec | profile).items()])


def _scores(spark: SparkSession) -> DataFrame:
    n = spark.range(600).select((F.col("id") / 100).cast("int").alias("k"), (F.col("id") / 10 % 10).cast("int").alias("a"), (F.col("id") % 10).cast("int").alias("b"))
    score = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.col("a") - F.col("b")) / F.lit(9.0) + F.col("a") % 3 * F.lit(0.02)))
    names = F.array(*map(F.lit, FEATURES))
    return n.where("a = b or (a * 3 + b * 5 + k) % 4 <> 0").select(F.get(names, F.col("k")).alias("category"), F.concat(F.lit("P"), "a").alias("target"), F.concat(F.lit("P"), "b").alias("comparison"), score.alias("score"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with raw cosines and complementarities."""
    return pairs.scored_pairs(_people(spark, d), {f: f"p_{f}" for f in FEATURES}, _scores(spark))


def _graph(spark: SparkSession, d: str) -> PairGraph:
    """All people as a complete graph whose pairs are never written."""
    return PairGraph.of(_people(spark, d, "array<float>"), {f: f"p_{f}" for f in FEATURES}, _scores(spark))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).edges()


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select("person_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("vec")) for f in FEATURES])).alias("x")).select("person_id", "x.*")


def _label_graph(spark: SparkSession, d: str) -> DataFrame:
    """Ten labels as nodes, edges weighted by the mean edge between their people."""
    own = _blocks(spark, d).where("a <> b")
    return own.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg((F.sum("weight") / F.sum("n")).alias("weight"))


def _membership(spark: SparkSession, d: str) -> DataFrame:
    return _people(spark, d).select(F.col("person_id").alias("node"), F.col("label").cast("long").alias("community"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Edges and weights by the labels that they join."""
    return written(_graph(spark, d).blocks(_membership(spark, d)), "blocks")


def _tag_rows(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, feature, tag): the words of part names; the feature is the part's size class."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("person_id"), F.concat(F.lit("f"), F.col("p_size") % 3).alias("feature"), ft.tags(F.replace("p_name", F.lit(" "), F.lit("|"))).alias("tags"))
    return p.select("person_id", "feature", F.explode("tags").alias("tag"))


def _as_job_events(e: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in (("click", "queued"), ("view", "running"), ("purchase", "completed"), ("signup", "failed"), ("logout", "cancelled")) for x in kv])
    return e.select(F.concat(F.col("user_id"), F.lit("-"), F.col("event_id") % 2).alias("job_id"), F.col("user_id").cast("string").alias("user_id"), F.coalesce(kinds[F.col("event_type")], F.lit("pending")).alias("status"), F.col("value").alias("progress"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    return _as_job_events(_t(spark, d, "events"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = _job_events(spark, d)
    return catalog.job_state(e).join(e.groupBy("job_id").agg(F.min("user_id").alias("user_id")), "job_id").withColumn("file_id", F.col("user_id"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("file_id"), F.col("c_name").alias("filename"), F.col("c_nationkey").cast("string").alias("user_id"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("version_id"), F.col("o_custkey").cast("string").alias("file_id"), F.col("o_orderkey").alias("version_number"), F.floor("o_totalprice").cast("long").alias("file_size"), (F.col("o_orderkey") % 100).alias("row_count"))


_P = "p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS person_id, label, vec_id, " + ", ".join(f"list_transform(embedding[{1 + 10 * k}:{10 + 10 * k}], lambda x: x::DOUBLE) AS v_{f}, 'P' || ((label + vec_id * {k + 1}) % 10) AS p_{f}" for k, f in enumerate(FEATURES)) + " FROM embeddings)"
_SC = "sc AS (SELECT k, 'P' || a AS target, 'P' || b AS comparison, CASE WHEN a = b THEN 0e0 ELSE least(1e0, abs(a - b) / 9e0 + (a % 3) * 2e-2) END AS score FROM range(6) t(k), range(10) x(a), range(10) y(b) WHERE a = b OR (a * 3 + b * 5 + k) % 4 <> 0)"
_RAW = (
    f"{_P}, {_SC}, raw AS (SELECT a.person_id AS i, b.person_id AS j, "
    + ", ".join(f"list_cosine_similarity(a.v_{f}, b.v_{f}) AS {f}, coalesce(f{k}.score, r{k}.score, 5e-1) AS c_{f}" for k, f in enumerate(FEATURES))
    + " FROM p a JOIN p b ON a.person_id < b.person_id "
    + " ".join(f"LEFT JOIN sc f{k} ON f{k}.k = {k} AND f{k}.target = a.p_{f} AND f{k}.comparison = b.p_{f} LEFT JOIN sc r{k} ON r{k}.k = {k} AND r{k}.target = b.p_{f} AND r{k}.comparison = a.p_{f}" for k, f in enumerate(FEATURES))
    + ")"
)
_SCORED = _RAW + ", mm AS (SELECT " + ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in FEATURES) + " FROM raw), scored AS (SELECT i, j, " + ", ".join(f"CASE WHEN hi_{f} > lo_{f} THEN ({f} - lo_{f}) / (hi_{f} - lo_{f}) ELSE 5e-1 END AS {f}, c_{f}" for f in FEATURES) + " FROM raw, mm)"
_WS, _WC = sum(SIMILARITY_WEIGHTS.values()), sum(COMPLEMENTARITY_WEIGHTS.values())
_EDGES = (
    _SCORED
    + ", sc2 AS (SELECT i, j, exp("
    + " + ".join(f"{SIMILARITY_WEIGHTS[f] / _WS!r}::DOUBLE * ln(greatest(least({f}, 1e0), 1e-9))" for f in FEATURES)
    + ") AS s, pow("
    + " + ".join(f"{COMPLEMENTARITY_WEIGHTS[f] / _WC!r}::DOUBLE * sqrt(least(greatest(c_{f}, 0e0), 1e0))" for f in FEATURES)
    + ", 2) AS c FROM scored), edges AS (SELECT i AS src, j AS dst, pow(least(1e0, (5e-1 * (5e-1 * s + 5e-1 * c) + 5e-1 * sqrt(s) * sqrt(c)) * pow(least(s, c), 2e-1)), 85e-2) AS weight FROM sc2)"
)
_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT i, j, '{f}' AS feature, {f} AS sim, c_{f} AS comp, {SIMILARITY_WEIGHTS[f]!r}::DOUBLE AS ws, {COMPLEMENTARITY_WEIGHTS[f]!r}::DOUBLE AS wc FROM {{}}" for f in FEATURES) + ")"
_VECS = f"{_P}, vecs AS (" + " UNION ALL ".join(f"SELECT person_id, '{f}' AS feature, v_{f} AS vec, {SIMILARITY_WEIGHTS[f]!r}::DOUBLE AS ws FROM p" for f in FEATURES) + ")"
_MEM = ", m AS (SELECT person_id AS node, label AS community FROM p)"
_LABELS = _EDGES + ", lg AS (SELECT least(a.label, b.label)::BIGINT AS src, greatest(a.label, b.label)::BIGINT AS dst, avg(weight) AS weight FROM edges e JOIN p a ON a.person_id = e.src JOIN p b ON b.person_id = e.dst WHERE a.label <> b.label GROUP BY ALL)"
_TAGS = "tags AS (SELECT p_partkey AS person_id, 'f' || (p_size % 3) AS feature, unnest(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS tag FROM part)"
_JOBEV = "ev AS (SELECT user_id || '-' || (event_id % 2) AS job_id, user_id::VARCHAR AS user_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' WHEN 'logout' THEN 'cancelled' ELSE 'pending' END AS status, value AS progress, ts AS tm, event_id AS seq FROM events)"
_JOBS = f"{_JOBEV}, jobs AS (SELECT job_id, min(user_id) AS user_id, arg_max(status, (tm, seq)) AS status, arg_max(progress, (tm, seq)) AS progress, max(tm) AS updated_at, min(tm) AS created_at, min(tm) FILTER (status = 'running') AS started_at, CASE WHEN arg_max(status, (tm, seq)) IN ('completed', 'failed', 'cancelled') THEN max(tm) FILTER (status IN ('completed', 'failed', 'cancelled')) END AS completed_at FROM ev GROUP BY job_id), job AS (SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS duration FROM jobs)"


def _r(*names: str) -> list:
    return [F.round(n, 8).alias(n) for n in names]


# --- scans, filters, text -------------------------------------------------------------------------

_BLANK = {"text": "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '  ' WHEN doc_id % 7 = 2 THEN 'nan' ELSE text END", "lang": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END"}


def _incomplete(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.expr(_BLANK["text"]).alias("text"), F.expr(_BLANK["lang"]).alias("lang"))


_INC = f"inc AS (SELECT doc_id, {_BLANK['text']} AS text, {_BLANK['lang']} AS lang FROM documents)"


@query(f"WITH {_INC} SELECT doc_id, lang FROM inc WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') NOT IN ('', 'nan') AND lang <> ''")
def scan_complete_rows(spark, d):
    return people.complete(_incomplete(spark, d), ("text", "lang", "absent")).select("doc_id", "lang")


@query(f"WITH {_INC} SELECT 'text' AS column_name, count(*) FILTER (text IS NULL OR trim(text) IN ('', 'nan'))::BIGINT AS rejected FROM inc UNION ALL SELECT 'lang', count(*) FILTER (lang = '')::BIGINT FROM inc")
def rejected_per_column(spark, d):
    return people.rejected(_incomplete(spark, d), ("text", "lang"))


@query(f"WITH {_P} SELECT DISTINCT feature, profile FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, p_{f} AS profile FROM p" for f in FEATURES) + ")")
def feature_profiles_distinct(spark, d):
    wide = _people(spark, d).select("person_id", *[F.col(f"p_{f}").alias(f) for f in FEATURES])
    return people.distinct_profiles(people.profiles(wide, list(FEATURES)))


@query(f"WITH {_P} SELECT person_id, " + ", ".join(f"p_{f} AS {f}" for f in FEATURES) + " FROM p")
def feature_projection(spark, d):
    return _people(spark, d).select("person_id", *[F.col(f"p_{f}").alias(f) for f in FEATURES])


@query("SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS tags FROM part")
def tags_split_pipe(spark, d):
    return _t(spark, d, "part").select("p_partkey", ft.tags(F.replace("p_name", F.lit(" "), F.lit(" | "))).alias("tags"))


@query("SELECT p_partkey, list_filter(string_split(p_type, ' '), lambda x: x <> '') AS tags FROM part")
def tags_split_semicolon(spark, d):
    return _t(spark, d, "part").select("p_partkey", ft.tags(F.replace("p_type", F.lit(" "), F.lit("; ;")), ";").alias("tags"))


def _cut(sql: str, delimiter: str) -> str:
    return f"list_filter(list_transform(flatten(list_transform({sql}, lambda x: string_split(x, {delimiter}))), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


_RICH = "[text]"
for _d in ("'|'", "','", "';'", "chr(10)", "' and '", "' & '"):
    _RICH = _cut(_RICH, _d)


@query(f"SELECT doc_id, list_filter(list_transform({_RICH}, lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'or', 'in', 'at', 'of', 'to', 'for'))[1:10] AS tags FROM documents")
def rich_tags_first10(spark, d):
    return _t(spark, d, "documents").select("doc_id", ft.rich_tags(F.col("text")).alias("tags"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 9) * 1e2 / 9 WHEN event_id % 3 = 1 THEN least(event_id % 250, 100)::DOUBLE ELSE 0e0 END AS progress FROM events")
def progress_parse(spark, d):
    n = F.col("event_id")
    said = F.when(n % 3 == 0, F.concat(F.lit("Step "), n % 9, F.lit("/9"))).when(n % 3 == 1, F.concat(n % 250, F.lit("% done"))).otherwise("waiting")
    return _t(spark, d, "events").select("event_id", ft.progress(said).alias("progress"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN value END AS value FROM events")
def nan_sanitised(spark, d):
    n = F.col("event_id") % 4
    return _t(spark, d, "events").select("event_id", ft.finite(F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(float("inf"))).otherwise(F.col("value"))).alias("value"))


@query("SELECT doc_id, md5(text) AS key FROM documents")
def content_key_md5(spark, d):
    return _t(spark, d, "documents").select("doc_id", ft.content_key(F.col("text")).alias("key"))


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders)::BIGINT AS total_rows, 2::INTEGER AS total_columns FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_rows(spark, d):
    return people.preview(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 10)


# --- vectors and pairs ----------------------------------------------------------------------------


@query("WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS k FROM embeddings), s AS (SELECT label, k, sum(x) AS x FROM e GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM s GROUP BY label) SELECT label, list(round(x / n, 8) ORDER BY k) AS vec FROM s JOIN n USING (label) GROUP BY label")
def tag_vector_sum_l2(spark, d):
    e = _t(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return summed(e, ["label"], "vec").select("label", F.transform(unit(F.col("vec")), lambda x: F.round(x, 8)).alias("vec"))


@query(f"WITH {_RAW} SELECT i, j, " + ", ".join(f"round({f}, 8) AS {f}" for f in FEATURES) + " FROM raw")
def pair_cosine(spark, d):
    return pairs.similarities(_people(spark, d), FEATURES).select("i", "j", *_r(*FEATURES))


@query(f"WITH {_SCORED} SELECT i, j, " + ", ".join(f"round({f}, 8) AS {f}" for f in FEATURES) + " FROM scored")
def minmax_normalised(spark, d):
    return pairs.scaled_similarities(_people(spark, d), FEATURES).select("i", "j", *_r(*FEATURES))


@query(f"WITH {_RAW} SELECT i, j, " + ", ".join(f"round(c_{f}, 8) AS c_{f}" for f in FEATURES) + " FROM raw")
def complementarity_lookup(spark, d):
    return pairs.lookups(_people(spark, d), {f: f"p_{f}" for f in FEATURES}, _scores(spark)).select("i", "j", *_r(*[f"c_{f}" for f in FEATURES]))


@query("WITH f AS (SELECT DISTINCT p_brand AS category, p_size % 10 AS profile FROM part) SELECT a.category, a.profile AS target, b.profile AS comparison FROM f a JOIN f b USING (category)")
def profile_cross_scores(spark, d):
    own = _t(spark, d, "part").select(F.col("p_brand").alias("feature"), (F.col("p_size") % 10).alias("profile")).distinct()
    return pairs.cross_scores(own)


@query("SELECT l_orderkey, l_linenumber, round(exp(5e-1 * ln(greatest(least(l_discount, 1e0), 1e-9)) + 5e-1 * ln(greatest(least(l_tax, 1e0), 1e-9))), 8) AS mean FROM lineitem")
def power_mean_geom(spark, d):
    v = {"a": F.col("l_discount"), "b": F.col("l_tax")}
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(power_mean(v, 1.0, 0), 8).alias("mean"))


@query("SELECT l_orderkey, l_linenumber, round(pow((2 * sqrt(l_discount) + sqrt(l_tax)) / 3e0, 2), 8) AS mean FROM lineitem")
def power_mean_half(spark, d):
    v = {"a": F.col("l_discount"), "b": F.col("l_tax")}
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(power_mean(v, {"a": 2.0, "b": 1.0}, 0.5), 8).alias("mean"))


@query(f"WITH {_EDGES} SELECT src, dst, round(weight, 8) AS weight FROM edges")
def edge_weights(spark, d):
    return _edges(spark, d).select("src", "dst", *_r("weight"))


@query("WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS s FROM part), e AS (SELECT p_partkey, len(s) AS n, unnest(s) AS g FROM t) SELECT a.p_partkey AS i, b.p_partkey AS j, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE, 8) AS jaccard FROM e a JOIN e b ON a.g = b.g AND a.p_partkey < b.p_partkey GROUP BY ALL")
def jaccard_pairs(spark, d):
    p = _t(spark, d, "part").select("p_partkey", ft.tags(F.col("p_name"), " ").alias("tags"))
    return pairs.jaccard(p, "p_partkey", "tags").select("i", "j", *_r("jaccard"))


# --- insights -------------------------------------------------------------------------------------

_LABEL = lambda x, cuts, rest: "CASE " + " ".join(f"WHEN {x} > {c} THEN '{n}'" for c, n in cuts) + f" ELSE '{rest}' END"
_STATS = _SCORED + _LONG.replace("{}", "scored") + f", st AS (SELECT feature, avg(sim) AS sm, var_pop(sim) AS sv, avg(comp) AS cm, var_pop(comp) AS cv FROM long GROUP BY feature), stats AS (SELECT *, {_LABEL('sm', insights.DIVERSITY, 'very_high')} AS diversity_level, {_LABEL('cm', insights.POTENTIAL, 'limited')} AS complementarity_potential FROM st)"


@query(f"WITH {_STATS} SELECT feature, round(sm, 8) AS similarity_mean, round(sv, 8) AS similarity_variance, round(cm, 8) AS complementarity_mean, round(cv, 8) AS complementarity_variance, diversity_level, complementarity_potential, round(sm * (1 - sv), 8) AS homogeneity_score FROM stats")
def feature_insights(spark, d):
    return insights.stats_of_sums(_graph(spark, d).stats()).select("feature", *_r("similarity_mean", "similarity_variance", "complementarity_mean", "complementarity_variance"), "diversity_level", "complementarity_potential", *_r("homogeneity_score"))


@query(f"WITH {_STATS} SELECT 'Dataset characteristics: ' || string_agg(feature || ': ' || {_LABEL('sm', insights.HOMOGENEITY, 'extremely diverse')} || ', ' || {_LABEL('cm', insights.MATCHING, 'very limited matching opportunities')} || CASE WHEN sm < 0.3 AND cm > 0.7 THEN '{insights.GUIDANCE[0]}' WHEN sm > 0.7 AND cm < 0.3 THEN '{insights.GUIDANCE[1]}' ELSE '' END, '; ' ORDER BY feature) AS context FROM stats")
def insight_context(spark, d):
    return insights.context(insights.stats_of_sums(_graph(spark, d).stats()))


@query(f"WITH {_STATS} SELECT feature, CASE WHEN diversity_level IN ('very_low', 'low') THEN CASE WHEN complementarity_potential IN ('limited', 'moderate') THEN 'reduce_both_weights' ELSE 'emphasize_complementarity' END WHEN diversity_level IN ('high', 'very_high') THEN CASE WHEN complementarity_potential IN ('excellent', 'good') THEN 'balanced_or_emphasize_complementarity' ELSE 'emphasize_similarity' END ELSE 'balanced_weights' END AS recommendation FROM stats")
def weight_recommendation(spark, d):
    return insights.recommendation(insights.stats_of_sums(_graph(spark, d).stats()))


_TFIDF = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), top AS (SELECT term, sum(tf) AS n, count(*) AS df FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 100), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1 AS idf FROM top), wt AS (SELECT doc_id, term, tf * idf AS x FROM tf JOIN idf USING (term)), tfidf AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM wt)"


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 8) AS weight FROM tfidf")
def tfidf_weights(spark, d):
    return insights.tfidf(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", *_r("weight"))


@query(f"WITH {_TFIDF}, s AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.weight * b.weight) AS sim FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL) SELECT count(*) FILTER (sim > 0)::BIGINT AS pairs, round(sum(sim) / (SELECT count(*) * (count(*) - 1) / 2 FROM documents), 8) AS similarity_mean FROM s")
def tfidf_similarity(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    sums = insights.pair_sums(written(insights.tfidf(docs, "doc_id", "text"), "tfidf"), "doc_id")
    n = docs.agg(F.count("*").alias("n"))
    return sums.crossJoin(n).select("pairs", F.round(F.try_divide("total", F.col("n") * (F.col("n") - 1) / 2), 8).alias("similarity_mean"))


# --- graph ----------------------------------------------------------------------------------------


@query(f"WITH {_EDGES}, n AS (SELECT count(*) AS n FROM p) SELECT n AS n_nodes, count(*)::BIGINT AS n_edges, round(sum(weight) / (n * (n - 1) / 2), 8) AS density, round(avg(weight), 8) AS mean_weight FROM edges, n GROUP BY n")
def subgraph_density(spark, d):
    return graph.density_of_blocks(_blocks(spark, d), _membership(spark, d)).select("n_nodes", "n_edges", *_r("density", "mean_weight"))


@query(f"WITH {_EDGES} SELECT node, round(sum(weight), 8) AS degree FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY node")
def weighted_degree(spark, d):
    return _graph(spark, d).degrees().select("node", *_r("degree"))


@query(f"WITH {_EDGES}, c AS (SELECT quantile_cont(weight, 0.9) AS cut FROM edges) SELECT src, dst, round(weight, 8) AS weight FROM edges, c WHERE weight >= cut")
def edge_percentile_filter(spark, d):
    return _graph(spark, d).above_percentile(90).select("src", "dst", *_r("weight"))


@query(f"WITH {_EDGES}{_MEM}, mk AS (SELECT weight, a.community AS a, b.community AS b FROM edges JOIN m a ON a.node = src JOIN m b ON b.node = dst), x AS (SELECT community, count(*) AS size FROM m GROUP BY 1 HAVING count(*) > 1), y AS (SELECT community, any_value(size) AS size, coalesce(sum(weight) FILTER (a = b), 0) AS inside, coalesce(sum(weight) FILTER (a <> b), 0) AS outside FROM x JOIN mk ON community = a OR community = b GROUP BY community) SELECT community::BIGINT AS community, size, round(inside, 6) AS internal_weight, round(outside, 6) AS external_weight, round(inside / (size * (size - 1) / 2), 8) AS density, round(inside / (inside + outside), 8) AS cohesion_ratio FROM y")
def community_metrics(spark, d):
    out = graph.metrics_of_blocks(_blocks(spark, d), _membership(spark, d))
    return out.select("community", "size", *[F.round(c, 6).alias(c) for c in ("internal_weight", "external_weight")], *_r("density", "cohesion_ratio"))


@query(f"WITH {_EDGES}{_MEM}, mk AS (SELECT weight, a.community AS a, b.community AS b FROM edges JOIN m a ON a.node = src JOIN m b ON b.node = dst), t AS (SELECT sum(weight) AS t FROM mk), d AS (SELECT c, sum(weight) AS d FROM (SELECT a AS c, weight FROM mk UNION ALL SELECT b, weight FROM mk) GROUP BY c), l AS (SELECT a AS c, sum(weight) AS l FROM mk WHERE a = b GROUP BY a) SELECT round(sum(coalesce(l, 0) / t - pow(d / (2 * t), 2)), 8) AS modularity FROM d LEFT JOIN l USING (c), t")
def modularity_by_label(spark, d):
    own = _blocks(spark, d)
    return graph.modularity_of_blocks(own, own.agg(F.sum("weight").alias("m"))).select(*_r("modularity"))


@query(f"WITH {_EDGES}{_MEM}, mk AS (SELECT weight, a.community = b.community AS same FROM edges JOIN m a ON a.node = src JOIN m b ON b.node = dst), w AS (SELECT avg(weight) FILTER (same) AS i, avg(weight) FILTER (NOT same) AS o FROM mk), s AS (SELECT count(*) AS k, var_pop(n) AS v, avg(n) AS a FROM (SELECT count(*) AS n FROM m GROUP BY community)) SELECT k, round((i - o) / greatest(i + o, 1e-3) * (1 - 3e-1 * least(1e0, v / (a * a))) * (1 + 2e-1 * least(1e0, k / 5e0)), 8) AS quality FROM w, s")
def community_quality(spark, d):
    return graph.quality_of_blocks(_blocks(spark, d), _membership(spark, d)).select("k", *_r("quality"))


@query(f"WITH RECURSIVE {_EDGES}{_MEM}, c AS (SELECT quantile_cont(weight, 0.99) AS cut FROM edges), k AS (SELECT src, dst FROM edges, c WHERE weight >= cut), a AS (SELECT src AS x, dst AS y FROM k UNION ALL SELECT dst, src FROM k), r(node, label) AS (SELECT node, node FROM m UNION SELECT a.y, r.label FROM r JOIN a ON a.x = r.node) SELECT node, min(label) AS component FROM r GROUP BY node")
def connected_components(spark, d):
    return _graph(spark, d).components(99)


# Greedy peeling: each step holds the degrees of the nodes that are left; the least one goes, its edges come off the others.
_PEEL = (
    _EDGES
    + ", arcs AS (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"
    + ", left_(step, node, degree) AS (SELECT 0, a, sum(weight) FROM arcs GROUP BY a UNION ALL SELECT s.step + 1, s.node, s.degree - arcs.weight FROM (SELECT step, node, degree, first_value(node) OVER (ORDER BY round(degree, 9), node) AS x FROM left_) s JOIN arcs ON arcs.a = s.x AND arcs.b = s.node)"
    + ", peel AS (SELECT step, arg_min(node, (round(degree, 9), node)) AS node, min(degree) AS degree, CASE WHEN count(*) > 1 THEN sum(degree) / (count(*) * (count(*) - 1)) ELSE 0 END AS density, count(*) AS size FROM left_ GROUP BY step)"
)


@query(f"WITH RECURSIVE {_PEEL} SELECT step::BIGINT AS step, node, round(degree, 6) AS degree, round(density, 6) AS density FROM peel")
def peel_order(spark, d):
    return peel.order(_graph(spark, d)).select("step", "node", F.round("degree", 6).alias("degree"), F.round("density", 6).alias("density"))


@query(f"WITH RECURSIVE {_PEEL} SELECT step::BIGINT AS prefix, size::BIGINT AS size, round(density, 6) AS density FROM peel WHERE size >= 3 AND density >= 40e-2")
def dense_prefixes(spark, d):
    return subgraph.prefixes(peel.order(_graph(spark, d)), 0.4).select("prefix", "size", F.round("density", 6).alias("density"))


@query(f"WITH RECURSIVE {_PEEL}, f AS (SELECT min(step) AS step FROM peel WHERE size >= 3 AND density >= 40e-2) SELECT node, round((SELECT density FROM peel JOIN f USING (step)), 6) AS density FROM left_ JOIN f USING (step)")
def dense_subgraph(spark, d):
    return peel.dense_prefix(peel.order(_graph(spark, d)), 0.4).select("node", F.round("density", 6).alias("density"))


_ARCS = _EDGES + ", arcs AS (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"
_ROUNDS = (
    _ARCS
    + ", r(step, node) AS (SELECT 0, person_id FROM p UNION ALL SELECT step + 1, node FROM (SELECT x.step, x.node, sum(weight) AS degree, sum(sum(weight)) OVER () AS total, count(*) OVER () AS n"
    + " FROM r x JOIN arcs ON arcs.a = x.node JOIN r y ON y.node = arcs.b GROUP BY x.step, x.node) WHERE n >= 3 AND total / (n * (n - 1)) < 38e-2 AND degree > total / n)"
)


@query(f"WITH RECURSIVE {_ROUNDS}, l AS (SELECT node FROM r WHERE step = (SELECT max(step) FROM r)) SELECT node FROM l, (SELECT count(*) AS n FROM l) WHERE n >= 3 AND (SELECT sum(weight) FROM arcs JOIN l x ON x.node = a JOIN l y ON y.node = b) >= 38e-2 * n * (n - 1)")
def batch_peeling(spark, d):
    return _graph(spark, d).dense_part(0.38, 0.0)


@query()
def communities_dense(spark, d):
    return community.detect(_label_graph(spark, d), community.DENSE)


@query()
def communities_sparse(spark, d):
    own = _graph(spark, d)
    cut = own.quantile(0.9)
    return own.on_matrix(community.divided(("louvain", "greedy_modularity")), community.MEMBERS, float("inf") if cut is None else cut)


@query()
def communities_louvain(spark, d):
    """All people on the table form, contracted to at most 64 communities before the kernel ends it."""
    own = _graph(spark, d)
    return louvain.of_pairs(own, own.quantile(0.9), kernel_nodes=64)


@query()
def community_selection(spark, d):
    g = written(_label_graph(spark, d), "labels")
    found = written(community.detect(g, community.DENSE), "members")
    each = None
    for m in community.DENSE:
        own = graph.community_metrics(g, found.where(F.col("method") == m).select("node", "community")).withColumn("method", F.lit(m))
        each = own if each is None else each.unionByName(own)
    return community.method_scores(each, True)


_SPREAD = _ARCS + ", l0 AS (SELECT person_id AS node, person_id AS community FROM p)"
for _k in range(1, 6):
    _SPREAD += f", v{_k} AS (SELECT a AS node, community, sum(weight) AS w FROM arcs JOIN l{_k - 1} l ON l.node = arcs.b GROUP BY ALL), l{_k} AS (SELECT l.node, coalesce(arg_max(v.community, (v.w, -v.community)), any_value(l.community)) AS community FROM l{_k - 1} l LEFT JOIN v{_k} v USING (node) GROUP BY l.node)"


@query(f"WITH {_SPREAD} SELECT node, community FROM l5")
def label_propagation(spark, d):
    return _graph(spark, d).label_propagation(5)


_TOUR = (
    _LABELS
    + ", a AS (SELECT src AS x, dst AS y, weight FROM lg UNION ALL SELECT dst, src, weight FROM lg)"
    + ", t(path, total) AS (SELECT [min(x)], 0::DOUBLE FROM a UNION ALL SELECT list_append(path, y), total + weight FROM t JOIN a ON a.x = path[-1] AND NOT list_contains(path, y))"
    + ", f AS (SELECT path, total + weight AS total FROM t JOIN a ON a.x = path[-1] AND a.y = path[1] WHERE len(path) = (SELECT count(DISTINCT x) FROM a) AND path[2] < path[-1])"
)


@query(f"WITH RECURSIVE {_TOUR}, b AS (SELECT arg_max(path, total) AS path, max(total) AS total FROM f) SELECT unnest(range(len(path))) AS position, unnest(path) AS node, round(total, 6) AS weight FROM b")
def max_cycle_exact(spark, d):
    return layout.cycle(_label_graph(spark, d)).select("position", "node", F.round("weight", 6).alias("weight"))


@query(f"WITH RECURSIVE {_EDGES}, arcs AS (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), r(step, node, seen, total) AS (SELECT 0, min(a), [min(a)], 0::DOUBLE FROM arcs UNION ALL SELECT step + 1, arg_max(b, (weight, -b)), list_append(any_value(seen), arg_max(b, (weight, -b))), any_value(total) + max(weight) FROM r JOIN arcs ON arcs.a = r.node WHERE NOT list_contains(seen, b) GROUP BY step), z AS (SELECT max_by(total, step) + (SELECT weight FROM arcs WHERE a = max_by(r.node, r.step) AND b = min_by(r.node, r.step)) AS weight FROM r) SELECT step::BIGINT AS position, node, round(z.weight, 6) AS weight FROM r, z")
def greedy_cycle(spark, d):
    return layout.cycle_of_pairs(_graph(spark, d)).select("position", "node", F.round("weight", 6).alias("weight"))


@query(f"WITH RECURSIVE {_LABELS}, lim AS (SELECT min(weight) AS lo, max(weight) AS hi FROM lg), dd AS (SELECT src, dst, 2 - 19e-1 * (weight - lo) / (hi - lo) AS d FROM lg, lim), a AS (SELECT src AS x, dst AS y, d FROM dd UNION ALL SELECT dst, src, d FROM dd), r(x, y, d, n) AS (SELECT x, y, d, 1 FROM a UNION ALL SELECT r.x, a.y, r.d + a.d, n + 1 FROM r JOIN a ON a.x = r.y WHERE n < 4 AND r.x <> a.y) SELECT x AS src, y AS dst, round(min(d), 8) AS distance FROM r WHERE x < y GROUP BY x, y")
def shortest_paths(spark, d):
    return layout.shortest_paths(_label_graph(spark, d)).select("src", "dst", *_r("distance"))


@query()
def stress_layout(spark, d):
    return layout.stress_layout(_label_graph(spark, d))


def _community(spark: SparkSession, d: str) -> tuple[DataFrame, PairGraph]:
    """Nodes and the graph of one label's people (a hundredth of all pairs), which are not written."""
    nodes = _membership(spark, d).where("community = 3").select("node")
    return nodes, _graph(spark, d).only(nodes)


@query()
def people_communities(spark, d):
    """The people of every label are divided, each label's as a graph of its own."""
    labels = _membership(spark, d).withColumnRenamed("community", "group")
    found, scores = subgraph.communities_of_groups(_graph(spark, d), labels)
    return found.join(scores, ["group", "method"], "left").select(F.col("group").alias("label"), "method", "node", "community", F.round("score", 6).alias("score"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"WITH RECURSIVE {_EDGES}, m AS (SELECT person_id AS node FROM p WHERE label = 3), lg AS (SELECT e.* FROM edges e SEMI JOIN m ON e.src = m.node SEMI JOIN m m2 ON e.dst = m2.node), lim AS (SELECT min(weight) AS lo, max(weight) AS hi FROM lg), dd AS (SELECT src, dst, 2 - 19e-1 * (weight - lo) / (hi - lo) AS d FROM lg, lim), a AS (SELECT src AS x, dst AS y, d FROM dd UNION ALL SELECT dst, src, d FROM dd), r(x, y, d, n) AS (SELECT x, y, d, 1 FROM a UNION ALL SELECT x, y, min(d), n + 1 FROM (SELECT r.x, a.y, r.d + a.d AS d, r.n FROM r JOIN a ON a.x = r.y WHERE r.n < 5 AND r.x <> a.y UNION ALL SELECT x, y, d, n FROM r WHERE n < 5) GROUP BY x, y, n) SELECT x AS src, y AS dst, round(min(d), 6) AS distance FROM r WHERE x < y GROUP BY ALL")
def people_paths(spark, d):
    return paths.paths_of_pairs(_community(spark, d)[1]).select("src", "dst", F.round("distance", 6).alias("distance"))


_SQUARES = _EDGES + ", lim AS (SELECT min(weight) AS lo, max(weight) AS hi FROM edges), e0 AS (SELECT src, dst, 2 - 19e-1 * (weight - lo) / (hi - lo) AS d FROM edges, lim), d0 AS MATERIALIZED (SELECT src AS x, dst AS y, d FROM e0 UNION ALL SELECT dst, src, d FROM e0 UNION ALL SELECT person_id, person_id, 0 FROM p)"
for _k in range(1, 4):
    _SQUARES += f", d{_k} AS MATERIALIZED (SELECT a.x, b.y, min(a.d + b.d) AS d FROM d{_k - 1} a JOIN d{_k - 1} b ON a.y = b.x GROUP BY a.x, b.y)"


@query(f"WITH {_SQUARES} SELECT x AS src, y AS dst, round(d, 6) AS distance FROM d3 WHERE x < y")
def all_people_paths(spark, d):
    """Shortest paths between all people, without a table of pairs; the SQL squares the matrix three times (paths of up to eight edges)."""
    return paths.paths_of_pairs(_graph(spark, d)).select("src", "dst", F.round("distance", 6).alias("distance"))


@query()
def people_layout(spark, d):
    return layout.stress_layout_of_pairs(_community(spark, d)[1])


@query()
def people_subgroups(spark, d):
    _, inner = _community(spark, d)
    groups = written(subgraph.subgroups_of_pairs(inner), "groups")
    return subgraph.strength_of_blocks(inner.inner(groups), groups)


_BY_LABEL = f"{_EDGES}, pl AS (SELECT person_id AS node, label AS community FROM p)"


@query(f"WITH {_BY_LABEL}, i AS (SELECT a.community, sum(weight) AS t, avg(weight) AS strength FROM edges JOIN pl a ON a.node = src JOIN pl b ON b.node = dst AND a.community = b.community GROUP BY 1), n AS (SELECT community, count(*) AS size FROM pl GROUP BY 1 HAVING count(*) >= 3) SELECT community::BIGINT AS community, size, round(coalesce(t, 0) / (size * (size - 1) / 2), 8) AS density, round(coalesce(strength, 0), 8) AS strength, row_number() OVER (ORDER BY round(coalesce(strength, 0), 12) DESC, community)::INTEGER AS place FROM n LEFT JOIN i USING (community)")
def subgroup_strength(spark, d):
    return subgraph.strength_of_blocks(_graph(spark, d).inner(_membership(spark, d)), _membership(spark, d)).select("community", "size", *_r("density", "strength"), "place")


@query("SELECT c_custkey AS node, c_name, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def member_list(spark, d):
    who = _t(spark, d, "customer")
    members = _t(spark, d, "orders").select(F.col("o_custkey").alias("node")).distinct()
    return subgraph.member_list(subgraph.present(members, who, "c_custkey"), who, ["c_name", "c_mktsegment"], "c_custkey")


@query("SELECT DISTINCT o_custkey AS node FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def absent_nodes(spark, d):
    nodes = _t(spark, d, "orders").select(F.col("o_custkey").alias("node")).distinct()
    return subgraph.absent(nodes, _t(spark, d, "customer").where("c_nationkey < 20"), "c_custkey")


@query(f"WITH {_EDGES} SELECT 'N' || src AS source, 'N' || dst AS target, round(weight, 8) AS weight FROM edges WHERE src % 3 <> 0 AND dst % 3 <> 0")
def named_edges(spark, d):
    who = _people(spark, d).where("person_id % 3 <> 0").select("person_id", F.concat(F.lit("N"), "person_id").alias("name"))
    return subgraph.named_edges(_edges(spark, d), who, "name").select("source", "target", *_r("weight"))


@query("WITH o AS (SELECT o_custkey % 5 AS m, o_orderpriority AS c, count(*) AS n, avg(o_totalprice) / 1e6 AS r FROM orders GROUP BY ALL) SELECT 'm' || m AS method, 'm' || m || ': ' || count(*) || ' communities (sizes: [' || string_agg(n::VARCHAR, ', ' ORDER BY n DESC) || ']), modularity: ' || printf('%.3f', m / 8e0) || ', avg cohesion: ' || printf('%.3f', avg(r)) AS summary FROM o GROUP BY m")
def community_summary(spark, d):
    o = _t(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("m"), F.col("o_orderpriority").alias("community")).agg(F.count("*").alias("size"), (F.avg("o_totalprice") / 1e6).alias("cohesion_ratio"))
    return subgraph.community_summary(o.select(F.concat(F.lit("m"), "m").alias("method"), "community", "size", "cohesion_ratio", (F.col("m") / 8.0).alias("modularity")))


@query(
    f"WITH RECURSIVE {_PEEL}, f AS (SELECT min(step) AS step FROM peel WHERE size >= 3 AND density >= 40e-2), nd AS (SELECT node FROM left_ JOIN f USING (step)), s AS (SELECT s.*, e.weight FROM scored s JOIN edges e ON e.src = s.i AND e.dst = s.j SEMI JOIN nd ON nd.node = s.i SEMI JOIN nd n2 ON n2.node = s.j), l AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, c_{f} AS c, weight, ({SIMILARITY_WEIGHTS[f]!r}::DOUBLE * (1 - c_{f} + 1e-1) + {COMPLEMENTARITY_WEIGHTS[f]!r}::DOUBLE * c_{f}) / {SIMILARITY_WEIGHTS[f] + COMPLEMENTARITY_WEIGHTS[f]!r}::DOUBLE AS part, {SIMILARITY_WEIGHTS[f]!r} > {COMPLEMENTARITY_WEIGHTS[f]!r} AS sim FROM s" for f in FEATURES)
    + ") SELECT feature, CASE WHEN any_value(sim) THEN 'similarity' ELSE 'complementarity' END AS dominant, count(*)::BIGINT AS edges, round(sum(part * weight) / greatest(sum(weight), 1e-3) * 100, 6) AS percentage, round(avg(c), 6) AS average, round(max(c), 6) AS highest, round(min(c), 6) AS lowest FROM l GROUP BY feature"
)
def subgraph_report_scalars(spark, d):
    """The whole subgraph's figures by feature, on the peeled subgraph."""
    every = _graph(spark, d)
    inner = every.only(peel.dense_prefix(peel.order(every), 0.4))
    sums = written(inner.importance(), "sums")
    own = inner.feature_importance(sums).select("feature", "percentage", "dominant", "edges")
    patterns = sums.select("feature", (F.col("c") / F.col("n")).alias("average"), F.col("c_high").alias("highest"), F.col("c_low").alias("lowest"))
    return own.join(patterns, "feature").select("feature", "dominant", "edges", F.round("percentage", 6).alias("percentage"), F.round("average", 6).alias("average"), F.round("highest", 6).alias("highest"), F.round("lowest", 6).alias("lowest"))


@query("WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id FROM embeddings WHERE vec_id % 2 = 0), n AS (SELECT count(*) AS n FROM v) SELECT id, vec_id FROM v UNION ALL SELECT row_number() OVER (ORDER BY vec_id) - 1 + n, vec_id FROM embeddings, n WHERE vec_id % 2 = 1")
def vector_append(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    first = dense_id(e.where("vec_id % 2 = 0"), ["vec_id"], "id")
    path = f"{folder(spark)}/vectors-{uuid.uuid4().hex}"
    vector_store.save(vector_store.appended(first, e.where("vec_id % 2 = 1"), ["vec_id"]), path)
    return vector_store.load(spark, path).select("id", "vec_id")


@query("WITH v AS (SELECT vec_id, embedding FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id")
def inner_products(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector_store.inner_products(rows).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def text_search(spark, d):
    from kinloom.plans.plugins import HashedWords, embedded

    parts = dense_id(_t(spark, d, "part").select("p_name").distinct(), ["p_name"], "id")
    rows = parts.join(embedded(parts.select(F.col("p_name").alias("tag")), HashedWords(64)).withColumnRenamed("tag", "p_name"), "p_name").select("id", "p_name", F.col("vec").alias("vector"))
    return vector_store.text_search(rows, parts.where("id % 20 = 0").select(F.col("p_name").alias("query")), HashedWords(64), 3)


@query("WITH f AS (SELECT DISTINCT p_brand AS category, 's' || (p_size % 10) AS profile FROM part), s AS (SELECT DISTINCT p_brand AS category, 's' || (p_size % 10) AS target, 's' || (p_size % 7) AS comparison, (p_size % 7) / 7e0 AS score FROM part) SELECT s.category, target, comparison, score FROM s SEMI JOIN f a ON a.category = s.category AND a.profile = s.target SEMI JOIN f b ON b.category = s.category AND b.profile = s.comparison")
def live_scores(spark, d):
    p = _t(spark, d, "part")
    own = p.select(F.col("p_brand").alias("feature"), F.concat(F.lit("s"), F.col("p_size") % 10).alias("profile"))
    scores = p.select(F.col("p_brand").alias("category"), F.concat(F.lit("s"), F.col("p_size") % 10).alias("target"), F.concat(F.lit("s"), F.col("p_size") % 7).alias("comparison"), (F.col("p_size") % 7 / 7.0).alias("score")).distinct()
    return insights.live_scores(scores, own).select("category", "target", "comparison", "score")


@query("WITH f AS (SELECT DISTINCT p_brand AS category, 's' || (p_size % 10) AS profile FROM part), s AS (SELECT DISTINCT p_brand AS category, 's' || (p_size % 10) AS target, 's' || (p_size % 7) AS comparison, (p_size % 7) / 7e0 AS score FROM part), m AS (SELECT a.category, a.profile AS target, b.profile AS comparison FROM f a JOIN f b USING (category)), x AS (SELECT m.*, coalesce(score, 0) AS score FROM m LEFT JOIN s USING (category, target, comparison)), r AS (SELECT category, min(score) AS lo, max(score) AS hi FROM x GROUP BY 1) SELECT category, target, comparison, round(score, 8) AS score, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 5e-1 END, 8) AS scaled FROM x JOIN r USING (category)")
def filled_scores(spark, d):
    p = _t(spark, d, "part")
    own = p.select(F.col("p_brand").alias("feature"), F.concat(F.lit("s"), F.col("p_size") % 10).alias("profile"))
    scores = p.select(F.col("p_brand").alias("category"), F.concat(F.lit("s"), F.col("p_size") % 10).alias("target"), F.concat(F.lit("s"), F.col("p_size") % 7).alias("comparison"), (F.col("p_size") % 7 / 7.0).alias("score")).distinct()
    return insights.filled_scores(scores, own).select("category", "target", "comparison", *_r("score", "scaled"))


@query("WITH v AS (SELECT o_custkey::VARCHAR AS file_id, o_orderkey::VARCHAR AS version_id, o_orderkey AS version_number FROM orders), n AS (SELECT c_custkey::VARCHAR AS file_id, 'new' || c_custkey AS version_id FROM customer WHERE c_custkey % 3 = 0), m AS (SELECT file_id, max(version_number) AS l FROM v GROUP BY 1), u AS (SELECT * FROM v UNION ALL SELECT n.file_id, n.version_id, coalesce(l, 0) + 1 FROM n LEFT JOIN m USING (file_id)) SELECT * FROM u WHERE file_id::BIGINT % 5 <> 0")
def file_writes(spark, d):
    versions = _versions(spark, d).select("file_id", "version_id", "version_number")
    files = _files(spark, d)
    new = files.where("file_id % 3 = 0").select("file_id", F.concat(F.lit("new"), "file_id").alias("version_id"))
    _, left = catalog.without_files(files, catalog.with_version(versions, new), versions.unionByName(new, allowMissingColumns=True).where("file_id % 5 = 0"))
    return left


@query("SELECT o_custkey::VARCHAR AS file_id, o_orderkey::VARCHAR AS version_id, o_orderkey AS version_number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS place FROM orders")
def versions_ascending(spark, d):
    return catalog.versions_in_order(_versions(spark, d)).select("file_id", "version_id", "version_number", "place")


# --- reports --------------------------------------------------------------------------------------

_CENTROID = _VECS + ", e AS (SELECT feature, unnest(vec) AS x, unnest(range(10)) AS k FROM vecs), c AS (SELECT feature, list(x ORDER BY k) AS c FROM (SELECT feature, k, avg(x) AS x FROM e GROUP BY ALL) GROUP BY feature)"


@query(f"WITH {_CENTROID} SELECT feature, list_transform(c, lambda x: round(x, 8)) AS vec FROM c")
def centroid(spark, d):
    return report.centroids(_vectors(spark, d)).select("feature", F.transform("vec", lambda x: F.round(x, 8)).alias("vec"))


@query(f"WITH {_CENTROID}, s AS (SELECT feature, person_id, list_cosine_similarity(vec, c) AS cosine FROM vecs JOIN c USING (feature)) SELECT feature, rank, person_id, round(cosine, 8) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY cosine DESC, person_id)::INTEGER AS rank FROM s) WHERE rank <= 5")
def centroid_top5(spark, d):
    return report.closest(_vectors(spark, d)).select("feature", "rank", "person_id", *_r("cosine"))


@query(f"WITH {_RAW}{_LONG.replace('{}', 'raw')} SELECT feature, round(avg(comp), 8) AS average, max(comp) AS highest, min(comp) AS lowest, any_value(wc) AS weight, round(any_value(wc) * avg(comp), 8) AS weighted_average, count(*)::BIGINT AS pairs FROM long GROUP BY feature")
def complementarity_patterns(spark, d):
    sums = _graph(spark, d).sums().select("feature", (F.col("c") / F.col("n")).alias("average"), F.col("c_high").alias("highest"), F.col("c_low").alias("lowest"), F.col("n").alias("pairs"))
    out = report.patterns_of_means(sums, COMPLEMENTARITY_WEIGHTS)
    return out.select("feature", *_r("average"), "highest", "lowest", "weight", *_r("weighted_average"), "pairs")


@query(f"WITH {_RAW}{_LONG.replace('{}', 'raw')} SELECT feature, rank, i, j, comp FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY comp DESC, i, j)::INTEGER AS rank FROM long) WHERE rank <= 5")
def complementarity_top_pairs(spark, d):
    return report.top_pairs(_graph(spark, d).top_pairs(5))


@query(f"WITH {_RAW}{_LONG.replace('{}', 'raw')}, h AS (SELECT feature, avg(sim) AS s, avg(comp) AS c, any_value(ws) AS ws, any_value(wc) AS wc FROM long GROUP BY feature) SELECT feature, round(s, 8) AS sim_mean, round(c, 8) AS comp_mean, round((ws * s + wc * c) / (ws + wc), 8) AS hybrid_mean, round(ws * s / greatest(wc * c, 1e-2), 8) AS balance_ratio, round(abs(1 - ws * s / greatest(wc * c, 1e-2)), 8) AS imbalance FROM h")
def hybrid_patterns(spark, d):
    means = _graph(spark, d).sums().select("feature", (F.col("s") / F.col("n")).alias("sim_mean"), (F.col("c") / F.col("n")).alias("comp_mean"))
    return report.hybrid_of_means(means, SIMILARITY_WEIGHTS, COMPLEMENTARITY_WEIGHTS).select("feature", *_r("sim_mean", "comp_mean", "hybrid_mean", "balance_ratio", "imbalance"))


_IMPORTANCE = _EDGES + _LONG.replace("{}", "scored") + ", k AS (SELECT feature, ws, wc, comp, weight, weight * (ws * (1 - comp + 1e-1) + wc * comp) / (ws + wc) AS t FROM long JOIN edges ON src = i AND dst = j), g AS (SELECT feature, any_value(ws) AS ws, any_value(wc) AS wc, sum(t) AS t, sum(weight) AS w, avg(1 - comp + 1e-1) AS s, avg(comp) AS c, count(*) AS edges FROM k GROUP BY feature), fi AS (SELECT *, CASE WHEN ws > wc THEN 'similarity' ELSE 'complementarity' END AS dominant, row_number() OVER (ORDER BY t DESC, feature)::INTEGER AS rank FROM g)"


def _importance(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).feature_importance()


@query(f"WITH {_IMPORTANCE} SELECT feature, round(t, 6) AS contribution, round(t / greatest(w, 1e-3) * 100, 8) AS percentage, round(s, 8) AS average_similarity, round(c, 8) AS average_complementarity, edges, dominant, round(greatest(ws, wc) / least(ws, wc), 8) AS dominance_ratio, rank FROM fi")
def feature_importance(spark, d):
    return _importance(spark, d).select("feature", F.round("contribution", 6).alias("contribution"), *_r("percentage", "average_similarity", "average_complementarity"), "edges", "dominant", *_r("dominance_ratio"), "rank")


@query(f"WITH {_IMPORTANCE}, n AS (SELECT arg_min(feature, rank) AS top_contributor, count(*) FILTER (dominant = 'similarity')::BIGINT AS n_similarity, count(*) FILTER (dominant = 'complementarity')::BIGINT AS n_complementarity FROM fi) SELECT *, CASE WHEN n_similarity > n_complementarity THEN 'similarity' ELSE 'complementarity' END AS primary_mechanism, abs(n_similarity - n_complementarity) / 6e0 AS balance_score FROM n")
def dominance_split(spark, d):
    return report.dominance_split(_importance(spark, d))


@query(f"WITH {_TAGS} SELECT tag, count(DISTINCT person_id)::BIGINT AS people FROM tags GROUP BY tag HAVING count(DISTINCT person_id) >= greatest(1, 1e-2 * (SELECT count(*) FROM part)) ORDER BY people DESC, tag LIMIT 20")
def common_keywords(spark, d):
    return report.keywords(_tag_rows(spark, d), _t(spark, d, "part").count(), 0.01)


@query(f"WITH {_TAGS}, c AS (SELECT feature, tag, count(*) AS mentions FROM tags GROUP BY ALL) SELECT feature, rank, tag, mentions, round(mentions / (SELECT count(DISTINCT person_id) FROM tags)::DOUBLE * 100, 8) AS percentage FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY mentions DESC, tag)::INTEGER AS rank FROM c) WHERE rank <= 5 AND mentions > 1")
def shared_values_top5(spark, d):
    return report.shared_values(_tag_rows(spark, d)).select("feature", "rank", "tag", "mentions", *_r("percentage"))


@query("WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS s FROM part), e AS (SELECT p_partkey, len(s) AS n, unnest(s) AS g FROM t), j AS (SELECT count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE AS j FROM e a JOIN e b ON a.g = b.g AND a.p_partkey < b.p_partkey GROUP BY a.p_partkey, b.p_partkey), u AS (SELECT count(DISTINCT g) / count(*)::DOUBLE AS u FROM e), n AS (SELECT count(*) AS n FROM t), x AS (SELECT u, 1 - (SELECT sum(j) FROM j) / (n * (n - 1) / 2) AS f FROM u, n) SELECT round(u, 8) AS unique_ratio, round(f, 8) AS mean_distance, round(u * f, 8) AS diversity FROM x")
def jaccard_diversity(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("person_id"), ft.tags(F.col("p_name"), " ").alias("tags"))
    return report.diversity(p).select(*_r("unique_ratio", "mean_distance", "diversity"))


@query(f"WITH {_VECS}, s AS (SELECT a.feature, a.person_id, any_value(a.ws) * avg(list_cosine_similarity(a.vec, b.vec)) AS score FROM vecs a JOIN vecs b ON a.feature = b.feature AND a.person_id <> b.person_id GROUP BY a.feature, a.person_id) SELECT feature, rank, person_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(score, 12) DESC, person_id)::INTEGER AS rank FROM s) WHERE rank <= 3")
def matrix_champions(spark, d):
    return report.champions(_vectors(spark, d), SIMILARITY_WEIGHTS, n=3).select("feature", "rank", "person_id", *_r("score"))


@query(f"WITH {_RAW}{_LONG.replace('{}', 'raw')}, s AS (SELECT feature, person_id, any_value(wc) * avg(comp) AS score FROM (SELECT feature, i AS person_id, comp, wc FROM long UNION ALL SELECT feature, j, comp, wc FROM long) GROUP BY ALL) SELECT feature, rank, person_id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(score, 12) DESC, person_id)::INTEGER AS rank FROM s) WHERE rank <= 3")
def complementarity_champions(spark, d):
    return report.champions_of_means(_graph(spark, d).complements(), COMPLEMENTARITY_WEIGHTS, 3).select("feature", "rank", "person_id", *_r("score"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    """Six features weighted by the mean size and tax of nations' lines: any bounded table of weights serves."""
    n = _t(spark, d, "nation").where("n_nationkey < 6")
    return n.select(F.get(F.array(*map(F.lit, FEATURES)), F.col("n_nationkey").cast("int")).alias("feature"), (F.col("n_regionkey") * F.lit(0.5)).alias("w_s"), (F.col("n_nationkey") * F.lit(0.3)).alias("w_c"))


_WEIGHTS = "fw AS (SELECT [" + ", ".join(f"'{f}'" for f in FEATURES) + "][n_nationkey::INTEGER + 1] AS feature, n_regionkey * 5e-1 AS w_s, n_nationkey * 3e-1 AS w_c FROM nation WHERE n_nationkey < 6)"
_SELECT = _WEIGHTS + ", sel AS (SELECT feature, CASE WHEN w_c > w_s THEN 'complementarity' ELSE 'similarity' END AS matrix, w_s + w_c AS impact, greatest(w_s, w_c) / greatest(least(w_s, w_c), 1e-1) AS dominance, row_number() OVER (ORDER BY w_s + w_c DESC, feature)::INTEGER AS priority FROM fw)"


@query(f"WITH {_SELECT} SELECT feature, matrix, round(impact, 8) AS impact, round(dominance, 8) AS dominance, priority FROM sel")
def matrix_selection(spark, d):
    return report.selections(_weights(spark, d)).select("feature", "matrix", *_r("impact", "dominance"), "priority")


@query(f"WITH {_SELECT} SELECT feature, matrix AS dominant, round(impact, 8) AS impact, round(dominance, 8) AS dominance, priority, round(w_s / nullif(w_s + w_c, 0), 8) AS similarity_share, round(w_c / nullif(w_s + w_c, 0), 8) AS complementarity_share FROM sel JOIN fw USING (feature)")
def feature_priorities(spark, d):
    return report.priorities(_weights(spark, d)).select("feature", "dominant", *_r("impact", "dominance"), "priority", *_r("similarity_share", "complementarity_share"))


@query(f"WITH {_VECS}, {_SELECT}, s AS (SELECT a.feature, a.person_id, any_value(a.ws) * avg(list_cosine_similarity(a.vec, b.vec)) AS score FROM vecs a JOIN vecs b ON a.feature = b.feature AND a.person_id <> b.person_id GROUP BY a.feature, a.person_id), c AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(score, 12) DESC, person_id) AS rank FROM s), v AS (SELECT feature, person_id, score * impact * CASE WHEN matrix = 'complementarity' THEN 12e-1 ELSE 1e0 END AS value FROM c JOIN sel USING (feature) WHERE rank = 1) SELECT feature, person_id, round(value, 8) AS value, row_number() OVER (ORDER BY round(value, 12) DESC, feature, person_id)::INTEGER AS place FROM v")
def replication_rank(spark, d):
    return report.candidate_rank(report.champions(_vectors(spark, d), SIMILARITY_WEIGHTS), _weights(spark, d)).select("feature", "person_id", *_r("value"), "place")


@query(f"WITH {_P} SELECT person_id, " + ", ".join(f"p_{f} AS {f}, length(p_{f})::INTEGER AS length_{f}" for f in FEATURES) + " FROM p")
def member_profiles(spark, d):
    wide = _people(spark, d).select("person_id", *[F.col(f"p_{f}").alias(f) for f in FEATURES])
    out = report.member_profiles(wide, FEATURES)
    return out.select("person_id", *[x for k, f in enumerate(FEATURES) for x in (F.col("profiles")[k]["raw"].alias(f), F.col("profiles")[k]["length"].alias(f"length_{f}"))])


# --- catalogue, caches, search --------------------------------------------------------------------


@query(f"WITH {_JOBS} SELECT job_id, status, progress, updated_at, created_at, started_at, completed_at, duration FROM job")
def latest_job_status(spark, d):
    return catalog.job_state(_job_events(spark, d))


@query(f"WITH {_JOBS} SELECT job_id, status FROM job WHERE status IN ('pending', 'queued', 'running')")
def active_jobs(spark, d):
    return catalog.active(_jobs(spark, d)).select("job_id", "status")


@query(f"WITH {_JOBS} SELECT job_id, created_at FROM job WHERE status IN ('completed', 'failed', 'cancelled') AND created_at < TIMESTAMP '2030-01-01' - INTERVAL 30 DAY")
def old_finished_jobs(spark, d):
    return catalog.old_finished(_jobs(spark, d), F.lit("2030-01-01").cast("timestamp"), 30).select("job_id", "created_at")


@query(f"WITH {_JOBS} SELECT user_id, count(*)::BIGINT AS total, count(*) FILTER (status = 'completed')::BIGINT AS completed, count(*) FILTER (status = 'failed')::BIGINT AS failed, count(*) FILTER (status = 'running')::BIGINT AS running, round(sum(duration) FILTER (duration <> 0), 6) AS total_duration, round(avg(duration) FILTER (duration <> 0), 6) AS average_duration FROM job GROUP BY user_id")
def job_stats_by_user(spark, d):
    return catalog.job_stats(_jobs(spark, d), "user_id").withColumns({c: F.round(c, 6) for c in ("total_duration", "average_duration")})


@query(f"WITH {_JOBS} SELECT job_id, c_name AS filename FROM job LEFT JOIN customer ON c_custkey::VARCHAR = user_id")
def jobs_with_file(spark, d):
    return catalog.with_file(_jobs(spark, d), _files(spark, d)).select("job_id", "filename")


@query("SELECT c_custkey::VARCHAR AS file_id, arg_max(o_orderkey, o_orderkey)::VARCHAR AS current_version_id, arg_max(floor(o_totalprice)::BIGINT, o_orderkey) AS file_size FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def files_with_current_size(spark, d):
    versions = _versions(spark, d)
    current = catalog.current_versions(versions).select("file_id", F.col("version_id").alias("current_version_id"))
    return catalog.with_current_size(_files(spark, d).join(current, "file_id", "left"), versions).select("file_id", "current_version_id", "file_size")


@query(f"WITH {_JOBS}, j AS (SELECT user_id AS file_id, count(*) AS n FROM job GROUP BY 1), v AS (SELECT o_custkey::VARCHAR AS file_id, count(*) AS n, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes, max(o_orderkey) AS last FROM orders GROUP BY 1) SELECT c_custkey::VARCHAR AS file_id, coalesce(v.n, 0)::BIGINT AS total_versions, coalesce(bytes, 0)::BIGINT AS storage_used, coalesce(last, 0)::BIGINT AS last_version, coalesce(j.n, 0)::BIGINT AS total_jobs FROM customer LEFT JOIN v ON v.file_id = c_custkey::VARCHAR LEFT JOIN j ON j.file_id = c_custkey::VARCHAR")
def file_stats(spark, d):
    return catalog.file_stats(_files(spark, d), _versions(spark, d), _jobs(spark, d))


@query(f"WITH {_JOBS}, v AS (SELECT o_custkey, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bytes FROM orders GROUP BY 1), f AS (SELECT c_nationkey::VARCHAR AS user_id, count(*)::BIGINT AS total_files, sum(bytes)::BIGINT AS storage_used FROM customer LEFT JOIN v ON o_custkey = c_custkey GROUP BY 1), j AS (SELECT user_id, count(*)::BIGINT AS total_jobs, count(*) FILTER (status = 'completed')::BIGINT AS total_analyses, max(updated_at) AS last_activity FROM job GROUP BY 1) SELECT user_id, coalesce(total_files, 0) AS total_files, coalesce(storage_used, 0) AS storage_used, coalesce(total_jobs, 0) AS total_jobs, coalesce(total_analyses, 0) AS total_analyses, last_activity FROM f FULL JOIN j USING (user_id)")
def user_stats(spark, d):
    return catalog.user_stats(_files(spark, d), _versions(spark, d), _jobs(spark, d))


@query(f"WITH {_JOBEV}, l AS (SELECT job_id, max({{'tm': tm, 'status': status, 'progress': progress}}) AS x, count(*)::BIGINT AS events FROM ev GROUP BY job_id) SELECT job_id, x.tm AS at, x.status AS status, x.progress AS progress, events FROM l")
def job_status_stream(spark, d):
    """The events as a stream: each batch delivers the jobs that changed, the last delivery of a job is its state."""
    table = _t(spark, d, "events")
    stream = jobs.event_stream(spark, f"{d}/events.parque[t]", table.schema)  # as a pattern, the table may be one file or a folder
    root = f"{folder(spark)}/delivered-{uuid.uuid4().hex}"
    timed = _as_job_events(stream).withColumn("at", F.col("at").cast("timestamp"))  # watermarks take no other type
    changed = jobs.latest_status(timed).select("job_id", F.col("at").cast(table.schema["ts"].dataType).alias("at"), "status", "progress", "events")
    jobs.deliver(changed, lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/state/batch={number}"), f"{root}/checkpoint").awaitTermination()
    rows = spark.read.schema(changed.schema).parquet(f"{root}/state/batch=*")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("at", "status", "progress", "events"), "events").alias("last")).select("job_id", "last.*")


@query("SELECT count(*) FILTER (o_orderkey % 10 <> 0)::BIGINT AS old_rows, count(*) FILTER (o_orderkey % 9 <> 0)::BIGINT AS new_rows, ['note'] AS added_columns, ['o_orderpriority'] AS removed_columns FROM orders")
def version_diff(spark, d):
    o = _t(spark, d, "orders")
    return catalog.version_diff(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 9 <> 0").drop("o_orderpriority").withColumn("note", F.lit("")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'added' WHEN o_orderkey % 9 = 0 THEN 'removed' ELSE 'modified' END AS change FROM orders WHERE (o_orderkey % 10 = 0 AND o_orderkey % 9 <> 0) OR (o_orderkey % 10 <> 0 AND o_orderkey % 9 = 0) OR (o_orderkey % 10 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 7 = 0)")
def keyed_diff(spark, d):
    o = _t(spark, d, "orders")
    new = o.where("o_orderkey % 9 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return catalog.keyed_diff(o.where("o_orderkey % 10 <> 0"), new, "o_orderkey")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("source <> 'src0'").select(ft.content_key(F.col("text")).alias("key"), F.lit(1).alias("hit")).distinct()


_CACHE = "cache AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE source <> 'src0')"


@query(f"WITH {_CACHE} SELECT doc_id FROM documents JOIN cache ON key = md5(text)")
def cache_hits(spark, d):
    return store.hits(_t(spark, d, "documents").select("doc_id", "text"), _cache(spark, d)).select("doc_id")


@query(f"WITH {_CACHE} SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT key FROM cache)")
def cache_misses(spark, d):
    return store.misses(_t(spark, d, "documents").select("doc_id", "text"), _cache(spark, d)).select("doc_id")


@query("SELECT split_part(p_type, ' ', 1) AS prefix, count(*)::BIGINT AS entries FROM part WHERE p_brand NOT LIKE 'Brand#1%' GROUP BY 1")
def cache_prefix_stats(spark, d):
    entries = _t(spark, d, "part").select(F.concat_ws(":", F.split("p_type", " ")[0], "p_brand").alias("key"))
    return store.prefix_stats(store.without_keys(entries, "*:Brand#1*"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id HAVING arg_max(ts, (ts, event_id)) > (SELECT min(ts) FROM events) + INTERVAL 1 DAY")
def keyed_upsert(spark, d):
    e = _t(spark, d, "events").select("user_id", "value", "ts", "event_id")
    path = f"{folder(spark)}/keyed-{uuid.uuid4().hex}"
    order = [F.desc("ts"), F.desc("event_id")]
    store.save_keyed(store.upserted(e.where("event_id % 2 = 0"), e.limit(0), ["user_id"], order), path, ["user_id"])
    store.upsert_keyed(spark, path, e.where("event_id % 2 = 1"), ["user_id"], order)
    last = store.load_keyed(spark, path)
    start = e.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("from"))
    return last.crossJoin(F.broadcast(start)).where("ts > from").select("user_id", "value")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return dense_id(_t(spark, d, "embeddings"), ["vec_id"], "id").select("id", F.col("embedding").cast("array<double>").alias("vector"))


_KNN = "v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.id AS query_id, b.id, list_inner_product(a.v, b.v) AS score FROM v a JOIN v b ON a.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s)"


@query(f"WITH {_KNN} SELECT query_id, rank, id, round(score, 8) AS score FROM k WHERE rank <= 5")
def knn_top5(spark, d):
    rows = written(_rows(spark, d), "rows")
    return search.nearest(rows, rows, 5).select("query_id", "rank", "id", *_r("score"))


@query(f"WITH {_KNN} SELECT query_id, rank, id, round(score, 8) AS score FROM k WHERE rank <= 5 AND score >= 0.3")
def knn_threshold(spark, d):
    rows = written(_rows(spark, d), "rows")
    return search.nearest(rows, rows, 5, 0.3).select("query_id", "rank", "id", *_r("score"))


@query()
def ivf_knn(spark, d):
    rows = written(_rows(spark, d), "rows")
    return search.ivf_nearest(rows.where("id % 20 = 0"), rows, 5)


# Rows in order of id: one leads if none of its near predecessors does.
_LEAD = (
    "v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
    ", near AS (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 5e-1)"
    ", nb AS (SELECT v.id, coalesce(list(i) FILTER (i IS NOT NULL), []) AS l FROM v LEFT JOIN near ON j = v.id GROUP BY v.id)"
    ", r(k, lead) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT k + 1, CASE WHEN len(list_intersect(lead, l)) = 0 THEN list_append(lead, k + 1) ELSE lead END FROM r JOIN nb ON nb.id = k + 1)"
    ", f AS (SELECT arg_max(lead, k) AS lead FROM r)"
)


@query(f"WITH RECURSIVE {_LEAD} SELECT id, coalesce(list_min(list_intersect(lead, l)), id) AS leader FROM nb, f")
def dedup_mapping(spark, d):
    rows = written(_rows(spark, d), "rows")
    near = pairs.near(rows.withColumnRenamed("id", "person_id"), "vector", 0.5)
    return search.leaders(rows.select("id"), near)


@query("SELECT user_id, event_type AS member FROM events WHERE event_id % 3 <> 0 GROUP BY ALL HAVING count(*) FILTER (event_id % 5 = 0) = 0 AND max(ts) > (SELECT min(ts) + INTERVAL 2 DAY FROM events)")
def set_members(spark, d):
    """A stored set table: members are added, some removed, and those not seen for long expire by compaction."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("member"), "event_id", F.col("ts").alias("expires_at"))
    path = f"{folder(spark)}/sets-{uuid.uuid4().hex}"
    added = e.where("event_id % 3 <> 0").groupBy("key", "member").agg(F.max("expires_at").alias("expires_at"))
    store.save_keyed(store.set_remove(added, e.where("event_id % 3 <> 0 and event_id % 5 = 0").select("key", "member")), path, ["key", "member"])
    now = F.lit(e.agg(F.min("expires_at") + F.expr("INTERVAL 2 DAY")).first()[0])
    store.expire_keyed(spark, path, now)
    return store.load_keyed(spark, path).select(F.col("key").alias("user_id"), "member")


_MAP = "mp AS (SELECT DISTINCT tag, substr(tag, 1, 3) AS umbrella FROM tags WHERE length(tag) > 4)"


@query(f"WITH {_TAGS}, {_MAP}, x AS (SELECT person_id, tag, coalesce(umbrella, tag) AS u FROM tags LEFT JOIN mp USING (tag)), q AS (SELECT count(*) AS n, count(DISTINCT u) AS m, max((u <> tag)::INTEGER) AS h FROM x GROUP BY person_id) SELECT sum(n)::BIGINT AS instances_before, sum(m)::BIGINT AS instances_after, sum(h)::BIGINT AS people_affected, (SELECT count(DISTINCT tag) FROM x) AS tags_before, (SELECT count(DISTINCT u) FROM x) AS tags_after, round(1 - sum(m) / sum(n)::DOUBLE, 8) AS reduction FROM q")
def dedup_stats(spark, d):
    tags = _tag_rows(spark, d)
    mapping = tags.where("length(tag) > 4").select("tag", F.substring("tag", 1, 3).alias("umbrella")).distinct()
    return search.dedup_stats(tags, mapping).withColumn("reduction", F.round("reduction", 8))


@query(f"WITH {_TAGS}, c AS (SELECT feature, tag, count(*) AS n FROM tags GROUP BY ALL) SELECT feature, arg_min(tag, (-n, length(tag), tag)) AS umbrella FROM c GROUP BY feature")
def umbrella_tags(spark, d):
    return search.umbrella(_tag_rows(spark, d), ["feature"])


@query("SELECT event_id, 5e-1 AS a, (event_id % 10) / 10e0 AS b FROM events")
def llm_reply_parse(spark, d):
    from kinloom.functions.replies import parsed_scores

    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 10 / 10).cast("string").alias("s"))
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('Here: ```json\n{"b": '), "s", F.lit("}\n```"))).otherwise(F.concat(F.lit("- b: "), "s"))
    found = e.select("event_id", parsed_scores(said, F.array(F.lit("a"), F.lit("b"))).alias("m"))
    return found.select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


_LIFE = (
    "c AS (SELECT c_custkey, 'job' || c_custkey AS job_id, c_custkey % 4 AS way FROM customer)"
    ", life AS (SELECT job_id, CASE way WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN way = 1 THEN least(1e2, greatest(0e0, c_acctbal / 50)) ELSE 0e0 END AS progress"
    ", CASE way WHEN 2 THEN 'stopped at ' || c.c_custkey END AS error_message, CASE way WHEN 3 THEN '{\"id\":' || c.c_custkey || '}' END AS result_data FROM c JOIN customer USING (c_custkey) WHERE c.c_custkey % 10 <> 0)"
)


@query(f"WITH {_LIFE} SELECT * FROM life")
def job_lifecycle(spark, d):
    """Jobs are created, run and report progress, fail with a message or complete with a result; some are deleted with their results."""
    c = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("job"), "c_custkey").alias("job_id"), "c_acctbal", (F.col("c_custkey") % 4).alias("way"))
    at = lambda hour: F.lit(f"2030-01-01 0{hour}:00:00").cast("timestamp")
    events = catalog.created(c.select("job_id"), at(0))
    state = events.select("job_id", "status", "progress")
    running = catalog.moved(state, c.where("way = 1").select("job_id", F.lit("running").alias("status"), F.lit("ignored").alias("message")), at(1))
    failed = catalog.moved(state, c.where("way = 2").select("job_id", F.lit("failed").alias("status"), F.concat(F.lit("stopped at "), "c_custkey").alias("message")), at(1))
    ahead = catalog.progressed(running.select("job_id", "status"), c.where("way = 1").select("job_id", (F.col("c_acctbal") / 50).alias("progress")), at(2))
    none = c.limit(0).select("job_id", F.lit("").alias("result_data"))
    done, results = catalog.with_results(state, c.where("way = 3").select("job_id", F.to_json(F.struct(F.col("c_custkey").alias("id"))).alias("result_data")), none, at(1))
    events = running.unionByName(failed).unionByName(ahead, True).unionByName(done, True).unionByName(events, True).withColumn("seq", F.lit(0))
    events, results = catalog.without_jobs(written(events, "events"), results, c.where("c_custkey % 10 = 0"))
    messages = events.where("error_message is not null").select("job_id", "error_message")
    return catalog.job_state(events).join(messages, "job_id", "left").join(results, "job_id", "left").select("job_id", "status", "progress", "error_message", "result_data")


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status = 'failed' THEN 'queued' ELSE 'cancelled' END AS status FROM job WHERE status IN ('pending', 'queued', 'running', 'failed')")
def job_writes(spark, d):
    at = F.lit("2030-01-01").cast("timestamp")
    state = written(_jobs(spark, d), "jobs")
    return catalog.cancelled(state, at).unionByName(catalog.restarted(state, at)).select("job_id", "status")
