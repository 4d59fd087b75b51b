"""The ten operators against brute force, round trips and held-out accuracy, and their edge cases."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import brown, chat, decontaminate, flat, language_id, licenses, neardup, pieces, pii, queries, secrets, topk
from kinloom.llm.common import table
from kinloom.operators import components

SPACE = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, sig string, label long, g long"


def words(text):
    return SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi"]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, near copies, clashing extra columns."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, base.upper(), "en", None, None), (3, base.upper(), "en", None, None),
        (4, None, "en", "s", 0), (5, "", "fr", "s", 0), (6, " \t\n", None, "s", 3), (7, "one two", "fr", "s", 7), (8, "ONE  two", "fr", "s", 8),
        (9, prose(2, 60000), "en", "s", 1), (None, prose(3, 30), "de", "s", 1), (10, "é ü 日本語 🎉 ß", "de", "s", 9), (11, "12345 !!!", "en", "s", 9),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", 7, 8) for r in rows], SCHEMA).cache()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets[i] = shingle_set(t)
    at = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]) and at[b] < at[a]:
                    at[a], changed = at[b], True
    return sets, at


# --- 1 ---


def test_decontamination_brute_force(spark, sf):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(docs, bench).collect()}
    items = {r.item_id: words(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        w = words(r.text)
        for k, own in items.items():
            bag = Counter(" ".join(own[i : i + 5]) for i in range(len(own) - 4))
            if not (shingle_set(r.text) & set(bag)):
                continue
            best = 0
            for s in range(len(w)):
                win = w[s : s + len(own)]
                c = Counter(" ".join(win[i : i + 5]) for i in range(max(1, len(win) - 4)))
                both = sum((c & bag).values())
                best = max(best, both / (sum(c.values()) + sum(bag.values()) - both))
            if best >= 0.75:
                want[r.doc_id, k] = round(best, 9)
    assert want and got == want
    left = {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_decontamination_of_truncated_copies(spark, sf):
    bench = table(spark, sf, "benchmark")
    items, texts = {r.item_id: words(r.text) for r in bench.collect()}, []
    for k, own in items.items():
        for cut in (len(own) * 15 // 100, len(own) * 20 // 100, len(own) * 24 // 100):
            texts += [own[cut:], own[: len(own) - cut], own[cut // 2 : len(own) - cut // 2], words(prose(k, 50)) + own[: len(own) - cut], own[cut:] + words(prose(k, 50))]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    want = {}
    for i, w in enumerate(texts):
        grams = [" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))]
        for k, own in items.items():
            bag = Counter(" ".join(own[j : j + 5]) for j in range(len(own) - 4))
            if not set(grams) & set(bag):
                continue
            best = 0
            for s in range(len(grams)):
                c = Counter(grams[s : s + len(own) - 4])
                both = sum((c & bag).values())
                best = max(best, both / (sum(c.values()) + sum(bag.values()) - both))
            if best >= 0.75:
                want[i, k] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want) > 200 and got == want
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_decontamination_edges(spark, odd):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, prose(1, 40)), (4, prose(1, 40)), (5, prose(3, 30))], "item_id long, text string")
    got = decontaminate.contaminated(odd, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in got) == [(-1, 5), (1, 4), (1, 4), (2, 4), (2, 4), (3, 4), (3, 4), (3, 4), (3, 4), (7, 1), (8, 1)]
    empty = odd.limit(0)
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_with_many_indexes(spark, odd, monkeypatch):
    """A benchmark cut into indexes by bytes finds what one index finds."""
    bench = spark.createDataFrame([(k, prose(k, 20 + 7 * k)) for k in range(1, 9)] + [(20, prose(1, 120)), (21, prose(3, 30))], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(odd, bench).collect()), key=repr)
    clean = decontaminate.without_leaks(odd, bench).count()
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 50_000)
    assert sum(1 for _ in decontaminate.indexes(bench)) > 3
    assert sorted(map(tuple, decontaminate.contaminated(odd, bench).collect()), key=repr) == whole and whole
    assert decontaminate.without_leaks(odd, bench).count() == clean


def test_decontamination_items_of_many_lines(spark, monkeypatch):
    """Items parted by line feeds and tabs count their words, and indexes of them keep to their size."""
    items = [(i, "\n".join(f"{prose(i, 1)}{j}" if j % 3 else f"{prose(i, 1)}{j}\tx" for j in range(300))) for i in range(6)]
    assert [decontaminate.n_words(x) for _, x in items] == [len(words(x)) for _, x in items]
    size = decontaminate.index_bytes(400) + 5000
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2 * size)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [len(x.ids) for x in decontaminate.indexes(bench)] == [2, 2, 2]
    docs = spark.createDataFrame([(10 + i, "before this " + x.replace("\n", " ") + " and after") for i, x in items] + [(99, prose(77, 500))], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(10 + i, i) for i, _ in items]
    assert [r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()] == [99]


def test_simhash_blocks_find_all_within_radius():
    r = np.random.default_rng(1)
    c = decontaminate.SizeClass(20, 1, r.integers(0, 1 << 63, 50).astype(np.uint64), np.zeros(50, np.int32), np.zeros(50, np.int32))
    c.enter()
    probes = []
    for p in c.prints:
        for n in range(14):
            x = int(p)
            for b in r.choice(64, n, replace=False):
                x ^= 1 << int(b)
            probes.append(x)
    probes = np.array(probes, np.uint64)
    want = {(i, j) for i in range(len(probes)) for j in range(50) if bin(int(probes[i]) ^ int(c.prints[j])).count("1") <= decontaminate.RADIUS}
    assert set(zip(*(x.tolist() for x in c.near(probes)), strict=True)) == want


# --- 2 ---


def test_brown_against_direct_counts(spark, sf, monkeypatch):
    monkeypatch.setattr(brown, "BROADCAST_WORDS", 700)  # so that most words go through the join
    got = {r.doc_id: r for r in queries.op2_brown_lm(spark, sf).collect()}
    rows = table(spark, sf, "documents").collect()
    tokens = lambda x: [*words(x), None]
    c = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    for r in rows:
        t, own = tokens(r.text), got[r.doc_id]
        assert (own.held_out, own.n_tokens, own.n_known, own.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(own.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_brown_probabilities_sum_to_at_most_one(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    model, vocabulary = brown.fit(spark, docs)
    v = vocabulary.toPandas()
    hashes = v["hash"].to_numpy().view(np.uint64)
    place = model.frequent(hashes)
    of = model.class_of[np.where(place >= 0, place, model.frequent.n + v["tail"].to_numpy())].astype(int)
    emit = (v["c"].to_numpy() + brown.DELTA) / 10 ** model.log_size[of]
    for before in range(brown.CLASSES):
        total = (10 ** model.log_move[before, of] * emit).sum() + 10 ** (model.log_move[before, model.class_of[-1]] + model.end_log - model.log_size[model.class_of[-1]])
        assert 0.9 < total <= 1 + 1e-9


def test_brown_score_is_the_class_models(spark, sf, monkeypatch):
    """score against a plain walk over each text's words, with words beyond the broadcast ones in their groups' classes."""
    monkeypatch.setattr(brown, "BROADCAST_WORDS", 900)
    docs = table(spark, sf, "documents").select("doc_id", F.lit(False).alias("held_out"), "text")
    model, vocabulary = brown.fit(spark, docs.select("text"))
    v = {r["hash"]: (r["c"], r["tail"]) for r in vocabulary.collect()}
    got = {r.doc_id: r.score for r in brown.scored(spark, docs, model, vocabulary).collect()}
    end = int(model.class_of[-1])
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    for i, text in texts.items():
        hashes, tail, _ = brown.tokens(next(flat.texts(pa.array([text]))))
        before, want = end, 0.0
        for h, g in zip(hashes, tail.tolist(), strict=True):
            place = int(model.frequent(np.array([h]))[0])
            of = int(model.class_of[place if place >= 0 else model.frequent.n + g])
            want += model.log_move[before, of] + math.log10(v[int(np.int64(h.view(np.int64)))][0] + brown.DELTA) - model.log_size[of]
            before = of
        want += model.log_move[before, end] + model.end_log - model.log_size[end]
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_brown_frequent_words_at_a_tie(spark):
    r = random.Random(8)
    rows = spark.createDataFrame([(r.randrange(-(1 << 63), 1 << 63), 0, 9 if k < 5 else 2) for k in range(300)], "hash long, tail int, c long")
    for most in (3, 5, 100, 200, 300, 400):
        top = brown.frequent(rows, most)
        assert min(most, 300) * (0.9 if most > 5 else 0) <= len(top) <= most and list(top["c"]) == sorted(top["c"], reverse=True)
        assert len(top) < 5 or list(top["c"])[:5] == [9] * 5


def test_brown_words_go_where_their_neighbours_are_likely(spark, monkeypatch):
    """Rare words of two kinds, told apart only by what stands beside them."""
    monkeypatch.setattr(brown, "HEAD", 8)
    monkeypatch.setattr(brown, "UNITS", 8 + brown.TAILS + 1)
    monkeypatch.setattr(brown, "END_UNIT", 8 + brown.TAILS)
    monkeypatch.setattr(brown, "CLASSES", 10)
    r, rows = random.Random(6), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    nouns, verbs = [word() for _ in range(60)], [word() for _ in range(60)]
    for _ in range(1500):
        rows.append((f"the {r.choice(['red', 'old'])} {r.choice(nouns)} sat on {r.choice(verbs)} quickly",))
    model, _ = brown.fit(spark, spark.createDataFrame(rows, "text string"))
    of = lambda w: int(model.class_of[int(model.frequent(brown.tokens(next(flat.texts(pa.array([w]))))[0])[0])])
    a, b = Counter(map(of, nouns)), Counter(map(of, verbs))
    assert sum(min(a[k], b[k]) for k in a) <= 6


def test_brown_exchange_raises_likelihood():
    r = np.random.default_rng(2)
    counts = np.zeros((21, 21))
    for a in range(20):
        counts[a, (a // 10) * 10 + r.integers(0, 10, 30)] += 5
    counts[20, 0], counts[5, 20] = 3, 3

    def likelihood(of):
        g = np.eye(3)[of].T @ counts @ np.eye(3)[of]
        return brown._xlogx(g).sum() - brown._xlogx(g.sum(axis=0)).sum() - brown._xlogx(g.sum(axis=1)).sum()

    of = brown.exchange(counts, 3, 8)
    start = np.arange(21) % 2
    start[20] = 2
    assert likelihood(of) > likelihood(start) and of[20] == 2


def test_brown_edges(spark, odd):
    docs = odd.selectExpr("doc_id", "false AS held_out", "text")
    model, vocabulary = brown.fit(spark, docs.select("text"))
    got = brown.scored(spark, docs, model, vocabulary).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    twice = [r for r in got if r.doc_id == 3]
    assert len(twice) == 2 and math.isclose(twice[0].score, twice[1].score) and math.isclose(twice[0].base_score, twice[1].base_score) and twice[0].n_known == twice[1].n_known
    none, vocabulary = brown.fit(spark, docs.select("text").limit(0))
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in brown.scored(spark, docs, none, vocabulary).collect())
    assert brown.scored(spark, docs.limit(0), model, vocabulary).count() == 0


# --- 3 ---


def test_neardup_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    sets, at = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(spark, table(spark, sf, "documents")).collect()}
    assert got == {i: (len(sets[i]), at[i], at[i] == i) for i in sets}


def test_neardup_hot_classes(spark):
    """Many texts without words, and one text with many copies: each in one class, with or without ids of their own."""
    many, base = 20_000, prose(9, 40)
    rows = spark.range(3 * many).select(F.col("id").alias("doc_id"), F.when(F.col("id") < many, F.lit(" ")).when(F.col("id") < 2 * many, F.lit(base)).otherwise(F.concat(F.lit("own words of number "), F.col("id"), F.lit(" here"))).alias("text"))
    got = neardup.classes(spark, rows).groupBy("kept", (F.col("component_id") == many).alias("hot")).count().collect()
    assert {(r.kept, r.hot): r["count"] for r in got} == {(True, False): 2 * many, (True, True): 1, (False, True): many - 1}
    none = rows.withColumn("doc_id", F.when(F.col("doc_id") >= 2 * many, F.col("doc_id")))
    kept = neardup.deduplicated(spark, none).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in kept} == {None: many + 1} | {i: 1 for i in range(2 * many, 3 * many)}


@pytest.mark.parametrize("hub", [4, 1024])
def test_neardup_groups_in_many_tiles(spark, monkeypatch, hub):
    """A base with copies that meet only through it, and chains, cut into tiles far smaller than the group."""
    monkeypatch.setattr(neardup, "TILE", 7)
    monkeypatch.setattr(components, "HUB_ROWS", hub)
    r, rows = random.Random(4), []
    base = prose(5, 60).split()
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(prose(6, 80).split()[2 * i : 2 * i + 40])) for i in range(20)]
    sets, at = brute_components(rows)
    got = {x.doc_id: x.component_id for x in neardup.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == at


def test_neardup_edges(spark, odd):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.classes(spark, odd).collect())
    assert [x[2] for x in got if x[0] in (1, 2, 3)] == [1, 1, 1, 1]
    assert [x for x in got if x[0] in (4, 5, 6)] == [(4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert [x for x in got if x[0] in (7, 8)] == [(7, 1, 7, True), (8, 1, 7, False)]
    assert neardup.classes(spark, odd.limit(0)).count() == 0
    kept = neardup.deduplicated(spark, odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 9, 10, 11]


def test_bbit_estimate_is_unbiased():
    values = flat.mix(np.arange(4000, dtype=np.uint64))
    a, b = np.sort(values[:2400]), np.sort(values[400:2800])
    true = 2000 / 2800
    sig = [neardup.packed(neardup.minima(x, np.array([0, len(x)]))) for x in (a, b)]
    assert abs(neardup.estimate(sig[0], sig[1])[0] - true) < 0.1


# --- 4 ---


def plain_base(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_base_spans(spark, sf):
    for r in queries.op4_secret_scan(spark, sf).join(table(spark, sf, "documents"), "doc_id").collect():
        base = plain_base(r.text)
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in secrets.KINDS]
        assert set(map(str, base)) <= {str((k, int(s), int(e))) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}


def test_secret_patterns_on_random_strings():
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice(["token", "Secret", "apikey", "api_key", "=", ":", " ", "'", '"', "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "é", "ſ", "x"]) for _ in range(r.randrange(12)))
        assert secrets.scan(text)[0] == plain_base(text)


@pytest.mark.parametrize("wrap", [
    lambda s: quote(s), lambda s: quote(quote(s)), lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(s.encode())).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: quote(base64.b64encode(s.encode()).decode()), lambda s: base64.b64encode("".join(f"\\x{ord(c):02x}" for c in s).encode()).decode(), lambda s: base64.urlsafe_b64encode(gzip.compress(quote(s).encode())).decode(),
])
def test_secret_layers(wrap):
    text = "é before " + wrap("api_key = hunter2hunter2") + " after"
    base, spans = secrets.scan(text)
    assert not base and any(k == "assign" and s >= 9 and e <= len(text) - 6 for k, s, e in spans)
    assert secrets.redact(text).startswith("é before ") and secrets.MASK in secrets.redact(text) and secrets.scan(secrets.redact(text))[1] == []


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(gzip.compress(gzip.compress(s))).decode(), lambda s: base64.b64encode(zlib.compress(gzip.compress(zlib.compress(s)))).decode(), lambda s: base64.b64encode(b"\xff\xfe " + s + b" \x80").decode(),
    lambda s: base64.b64encode(bytes(range(128, 256)) + b" " + s).decode(), lambda s: quote(gzip.compress(s)), lambda s: quote(b"\xff " + s + b" \x80"), lambda s: "".join(f"\\x{c:02x}" for c in zlib.compress(gzip.compress(s))), lambda s: repr(gzip.compress(s))[2:-1],
])
def test_secret_layers_of_bytes(wrap):
    text = "é before " + wrap(b"api_key = hunter2hunter2") + " after"
    spans = secrets.scan(text)[1]
    assert any(k == "assign" and s >= 9 and e <= len(text) - 6 for k, s, e in spans)
    assert secrets.MASK in secrets.redact(text) and secrets.scan(secrets.redact(text))[1] == []


@pytest.mark.parametrize("put", [
    lambda s: "/cfg/" + base64.b64encode(s).decode(), lambda s: "id_" + base64.b64encode(s).decode(), lambda s: "x-" + base64.b64encode(s).decode(), lambda s: "ab/" + base64.b64encode(gzip.compress(s)).decode(),
    lambda s: base64.encodebytes(b"x" * 45 + s + b"y" * 60).decode(), lambda s: base64.encodebytes(gzip.compress(prose(1, 60).encode() + b" " + s + b" " + prose(2, 60).encode())).decode().replace("\n", "\r\n  "),
])
def test_secret_layers_in_longer_and_wrapped_runs(put):
    text = "é before " + put(b"password = hunter2hunter2") + " after"
    assert any(k == "assign" and s >= 9 and e <= len(text) - 6 for k, s, e in secrets.scan(text)[1])
    assert secrets.MASK in secrets.redact(text) and secrets.scan(secrets.redact(text))[1] == []


def test_secret_large_layers_and_members(monkeypatch):
    """No member and no layer is dropped, whatever it unpacks to."""
    import bz2

    import zstandard

    key, filler = b"password = hunter2222", b"nothing here "
    box = lambda raw: "see " + base64.b64encode(raw).decode() + " end"
    found = lambda text: [s for s in secrets.scan(text)[1] if s[0] == "assign"]
    for pack in (gzip.compress, bz2.compress, zlib.compress, zstandard.compress):
        many = pack(filler * 9) + pack(filler * 5) + pack(key)
        assert found(box(many)), pack
        assert found(box(pack(pack(filler) + pack(filler + key)))), pack
    assert found(box(gzip.compress(key + b"\0" * (70 << 20)))) and found(box(gzip.compress(b"x " * (35 << 20) + key)))
    assert found(box(gzip.compress(gzip.compress(filler * 100 + key)[:-9])))  # cut short
    monkeypatch.setattr(secrets, "BLOCK", 256)
    monkeypatch.setattr(secrets, "STEP", 16)
    monkeypatch.setattr(secrets, "OVERLAP", 64)
    for n in range(40):
        text = filler * 30 + b"y" * n + b" secret" + b" " * (3 * n) + b"= abcdef" + filler * 30
        assert found(box(zlib.compress(text))), n
        inner = base64.b64encode(filler + key) + b" "
        assert found(box(zlib.compress(filler * 20 + b"z" * n + b" " + inner + filler * 40))), n
    assert not found(box(zlib.compress(filler * 500)))


def _nested(r, packs, depth, key):
    """The key inside `depth` layers of any kind, each with something before and behind it, members of sizes around the steps."""
    data = key
    for _ in range(depth):
        kind = r.choice(["pack", "base64", "url", "hex"])
        if kind == "pack":
            pack = r.choice(packs)
            before = r.choice([b"", b"header line\n", r.randbytes(r.randrange(40)), pack(b"member " * r.randrange(40)), b"-" * r.choice([16381, 16382, 16383, 16384, 3])])
            data = before + pack(r.choice([b"", b"text "]) + data) + r.choice([b"", b"\0", b" tail", pack(b"more")])
        else:
            # what is no text is carried by base64; a separator keeps neighbours out of the run
            if kind == "base64" or not data.isascii() or b"\0" in data:
                data = b"see " + base64.b64encode(data) + b" end"
            elif kind == "url":
                data = "".join(f"%{c:02x}" for c in data).encode()
            else:
                data = b"x='" + "".join(f"\\x{c:02x}" for c in data).encode() + b"'"
    return data if data.isascii() and b"\0" not in data else b"at " + base64.b64encode(data) + b" to"


def test_secret_random_nests():
    """URL, escapes, base64 and all compressors in any order, in archives inside archives."""
    import bz2
    import lzma

    import zstandard

    packs, key = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress], b"password = hunter2222"
    r = random.Random(21)
    for n in range(150):
        text = _nested(r, packs, r.randrange(1, 6), key).decode()
        assert any(k == "assign" for k, *_ in secrets.scan(text)[1]), (n, text[:200])


def test_secret_members_that_end_near_a_step():
    import bz2

    key = b"password = hunter2222"
    for size in (16380, 16381, 16382, 16383, 16384, 16385):
        over = len(gzip.compress(b"0" * 16000, 0)) - 16000
        member = gzip.compress(random.Random(size).randbytes(size - over), 0)
        assert len(member) == size
        for pack in (bz2.compress, gzip.compress, zlib.compress):
            text = base64.b64encode(pack(member + gzip.compress(key))).decode()
            assert any(k == "assign" for k, *_ in secrets.scan(f"a {text} b")[1]), (size, pack)
    split = gzip.compress(b"x password = hun") + gzip.compress(b"ter2222 y")
    assert any(k == "assign" for k, *_ in secrets.scan(base64.b64encode(split).decode())[1])  # members are one stream


BOMB = """
import base64, bz2, lzma, resource, sys, zlib
import zstandard
from kinloom.llm import secrets
key, many = b" password = hunter2222 ", b"\\0" * (1 << 20)
tools = {"gzip": (zlib.compressobj(9, zlib.DEFLATED, 31), 20), "xz": (lzma.LZMACompressor(preset=0), 20), "bz2": (bz2.BZ2Compressor(), 200), "zstd": (zstandard.ZstdCompressor().compressobj(), 200)}
tool, n = tools[sys.argv[1]]
data = b"".join([*(tool.compress(many) for _ in range(n)), tool.compress(key), *(tool.compress(many) for _ in range(n)), tool.flush()])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = secrets.scan("at " + base64.b64encode(data).decode())[1]
print({s[0] for s in found}, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


@pytest.mark.parametrize("pack", ["gzip", "xz", "bz2", "zstd"])
def test_secret_bombs_take_little_memory(pack):
    """Up to 400 MB from a few hundred bytes, in one block after another."""
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", BOMB, pack], capture_output=True, text=True, check=True).stdout.split()
    assert out[0] == "{'assign'}" and int(out[1]) < 100, out


def test_secret_cycles_and_deep_nests_end():
    data = b"password = hunter2222"
    for _ in range(400):
        data = gzip.compress(data, 9)
    assert any(k == "assign" for k, *_ in secrets.scan(base64.b64encode(data).decode())[1])


@pytest.mark.parametrize("code", ["utf-16", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"])
def test_secret_wide_text(code):
    text = "x = '" + base64.b64encode("prefix é password = hunter2222 suffix".encode(code)).decode() + "'"
    got = secrets.scan(text)[1]
    assert [k for k, *_ in got] == ["assign"] and got[0][1] > 5 and got[0][2] < len(text) - 1
    plain = "é " + "password = hunter2222".encode(code).decode("latin-1")
    assert any(k == "assign" for k, *_ in secrets.scan(plain)[1])


def test_secret_zip_members():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "nothing " * 500)
        z.writestr("b/c.txt", "line\npassword = hunter2222\n" * 3)
    assert any(k == "assign" for k, *_ in secrets.scan("z " + base64.b64encode(out.getvalue()).decode())[1])


def test_secret_words_are_decoded_too():
    """Base64 that looks like one word or number."""
    text = "token=aaaaaa"
    assert base64.b64encode(text.encode()).decode() == "dG9rZW49YWFhYWFh"
    for word in ("dG9rZW49YWFhYWFh", "/path/dG9rZW49YWFhYWFh"):
        assert any(k == "assign" for k, *_ in secrets.scan(f"a {word} b")[1])


def test_secret_edges(spark, odd):
    got = secrets.scanned(odd, ["doc_id"])
    assert got.count() == odd.count() and {r.spans for r in got.collect()} == {""}
    assert secrets.redacted(odd).collect() == odd.collect() and secrets.scanned(odd.limit(0), ["doc_id"]).count() == 0
    assert secrets.scan("%25%32%35" * 50)[1] == [] and secrets.scan("a" * 200_000)[1][0][2] == 200_000


# --- 5 ---


def test_license_alignment_is_the_lcs():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = r.integers(0, 4, r.integers(1, 9)).astype(np.uint64)
        b = r.integers(0, 4, r.integers(1, 9)).astype(np.uint64)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (a[i] == b[j]))
        total, first, last = licenses.align(a, b, 0)
        assert total == best[-1, -1] and (not total or 0 <= first < last <= len(b))


LICENSE_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def test_license_words_equal_a_pattern():
    texts = ["", "Version 2.0.", "a.b..c .d e. f", "x_y-z", "É ü.ñ 日本.語 12.5%", ".", "one", "end.", ".start", "a" * 50 + "." + "B" * 9]
    t = next(flat.texts(pa.array(texts)))
    hashes, starts, ends, first = licenses.words_of(t)
    seen = {}
    for r, text in enumerate(texts):
        want = [(m.start(), m.end()) for m in LICENSE_WORD.finditer(text)]
        own = slice(first[r], first[r + 1])
        assert list(zip(starts[own].tolist(), ends[own].tolist(), strict=True)) == want, text
        for (s, e), h in zip(want, hashes[own].tolist(), strict=True):
            assert seen.setdefault(text[s:e].lower(), h) == h
    assert len(set(seen.values())) == len(seen)


def brute_license(text, templates, threshold):
    """Templates of which a stretch of the text holds enough words in order: longest common subsequence against every stretch."""
    w = [x.lower() for x in LICENSE_WORD.findall(text)]
    out = set()
    for name, template in templates.items():
        v = [x.lower() for x in LICENSE_WORD.findall(template)]
        best = 0
        for s in range(max(1, len(w))):
            part, row = w[s : s + len(v) + 3], [0] * (len(v) + 1)
            for x in part:
                before = 0
                for j, y in enumerate(v):
                    row[j + 1], before = max(row[j + 1], row[j], before + 1 if x == y else 0), row[j + 1]
            best = max(best, row[-1])
        if best >= threshold * len(v):
            out.add(name)
    return out


def test_license_query_equals_brute_force(spark):
    """Whole, edited, cut and foreign texts; templates that don't overlap in one place, so that each found one is reported."""
    r, templates = random.Random(12), {f"t{n}": " ".join(f"{c}{n}" for c in prose(50 + n, 12 + 5 * n).split()) for n in range(6)}
    rows = []
    for i in range(60):
        parts = [prose(200 + i, 8)]
        for n in r.sample(range(6), r.randrange(3)):
            w = templates[f"t{n}"].split()
            for _ in range(r.randrange(len(w) // 8 + 1)):
                k, act = r.randrange(len(w)), r.randrange(3)
                if act == 0:
                    w[k] = "other"
                elif act == 1 and len(w) > 4:
                    del w[k]
                else:
                    w.insert(k, "more")
            parts += [" ".join(w), prose(300 + i, 9)]
        rows.append((i, " ".join(parts)))
    got = {(x.doc_id, x.license) for x in licenses.licensed(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    want = {(i, name) for i, text in rows for name in brute_license(text, templates, 0.75)}
    clear = {(i, name) for i, text in rows for name in brute_license(text, templates, 0.85)}
    assert clear <= got <= want and len(clear) > 20 and len(want - got) <= 0.1 * len(want)


def test_licenses_found_whole_and_edited(spark, sf, odd):
    index = licenses.Index.of(licenses.TEMPLATES)
    for n, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        got = index.matches(f"some words {text.upper()} and more", 0.75)
        assert any(m[0] == n and m[1] == 1.0 and m[3] == 11 or len(index.words[m[0]]) > len(index.words[n]) and m[3] == 11 for m in got), name
    edited = licenses.TEMPLATES["mit"].replace("free of charge, ", "").replace("sublicense", "sub-license")
    assert index.names[index.matches(edited, 0.75)[0][0]] == "mit"
    got = licenses.licensed(table(spark, sf, "documents")).collect()
    want = {(r.doc_id, k) for r in table(spark, sf, "documents").collect() for k, t in licenses.TEMPLATES.items() if t in r.text}
    assert want and want <= {(r.doc_id, r.license) for r in got}
    assert licenses.licensed(odd).count() == 0 and licenses.licensed(odd.limit(0)).count() == 0


# --- 6 ---


def brute_top(rows, k, step):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_topk_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "TILE_QUERIES", 2)
    monkeypatch.setattr(topk, "TILE_ROWS", 64)
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, queries.op6_exact_topk(spark, sf).collect())) == brute_top(rows, 10, 100)


def test_topk_of_unequal_lengths(spark, monkeypatch):
    """Short and very long vectors, sparse ones among them, in tiles and blocks bounded by bytes."""
    r = random.Random(9)
    rows = [(i, [r.choice([0.0, 0.0, r.uniform(-2, 2)]) for _ in range(r.choice([0, 1, 2, 3, 17, 600 if i % 9 else 5000]))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    want = brute_top(rows, 10, 10)
    for bytes_ in (topk.QUERY_BYTES, 3000):
        monkeypatch.setattr(topk, "QUERY_BYTES", bytes_)
        assert sorted(map(tuple, topk.nearest(spark, df.where("id % 10 = 0"), df).collect())) == want
    found = [m.shape for _, m in topk.rows_of(pa.array([[1.0, 2.0]] * 999 + [[1.0] * 20_000]))]
    assert sum(a * b for a, b in found) == 999 * 2 + 20_000


def test_topk_is_exact_at_many_dimensions(spark):
    """Components at the limit in 1,536 dimensions, beyond what float64 and 64 bits hold, against whole Python numbers."""
    r = random.Random(4)
    for size, scale in ((1536, 4096.0), (1536, 2.0**30), (40, 2.0**45), (3, 1.0)):
        rows = [(i, [scale - r.random() * (i + 1) for _ in range(size)]) for i in range(30)]
        whole = [[math.floor(1024 * x) for x in v] for _, v in rows]
        df = spark.createDataFrame(rows, "id long, vector array<double>")
        want = []
        for q in range(0, 30, 10):
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(30) if i != q)[:10]
            want += [(q, k, i, min(-s, 2**63 - 1)) for k, (s, i) in enumerate(scores, 1)]
        got = sorted(map(tuple, topk.nearest(spark, df.where("id % 10 = 0"), df).collect()))
        assert [(q, s) for q, _, _, s in got] == [(q, s) for q, _, _, s in want]
        if scale < 2.0**30:
            assert got == want


def test_topk_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (100, [1e12, -1e12]), (7, [0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted(map(tuple, topk.nearest(spark, df.where("id % 100 = 0"), df, 10).collect()))
    assert got == brute_top(rows, 10, 100)
    assert topk.nearest(spark, df.limit(0), df).count() == 0 and topk.nearest(spark, df, df.limit(0)).count() == 0


# --- 7 ---


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_patterns_on_random_strings():
    r = random.Random(11)
    for _ in range(5000):
        text = "".join(r.choice(list("a1.@-+ 5(") + ["4111111111111111", "+1 555", "1.2.3.4", "x@y.z", "é"]) for _ in range(r.randrange(16)))
        assert pii.patterns(text) == plain_pii(text), text


def test_pii_long_runs_are_linear():
    run = "9" * 300_000
    assert pii.patterns(run) == []
    assert pii.patterns(f"{run}.1.2.3 10.0.0.1") == [("ip", len(run) + 7, len(run) + 15)]
    assert [(k, s) for k, s, _ in pii.patterns("1.2.3.4.5.6.7.8")] == [("ip", 0), ("ip", 8)]


def test_pii_decoding_does_not_depend_on_blocks(monkeypatch):
    tagger = pii.Tagger.fresh(3)  # untrained: its tags change at every window
    texts = ["", "no digits here", "call 555-123-4567 " * 40, "a@b.co", "1" * 500, "x" * 400 + " 1.2.3.4"]
    monkeypatch.setattr(pii, "plausible", lambda kind, value: True)
    whole = pii.detect(tagger, texts)
    monkeypatch.setattr(pii, "DECODED", 3)
    assert pii.detect(tagger, texts) == whole
    assert [x[0] for x in whole] == [pii.patterns(t) for t in texts]
    assert any(len(spans) > len(base) for base, spans in whole)


def test_pii_query_and_tagger(spark, sf, odd):
    for r in queries.op7_pii(spark, sf).join(table(spark, sf, "documents"), "doc_id").collect():
        base = plain_pii(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
    tagger = pii.default_tagger()
    text = "call (555) 123-4567 today " + "x " * 90 + "or write to ann@example.org now"
    found = pii.detect(tagger, [text])[0][1]
    assert ("phone", 5, 19) in found and ("email", text.index("ann"), text.index(" now")) in found
    assert pii.scanned(odd, ["doc_id"]).count() == odd.count() and pii.scanned(odd.limit(0), ["doc_id"]).count() == 0


def test_pii_windows_cover_whole_texts():
    for n in (0, 1, 90, pii.WINDOW, pii.WINDOW + 1, 2 * pii.STRIDE + 5, 5000):
        read = np.zeros(n, int)
        found = list(pii.windows("x" * n))
        for s, e in found:
            read[s:e] += 1
        assert read.all() and all(e - s <= pii.WINDOW for s, e in found)
        assert all(b[0] - a[0] == pii.STRIDE for a, b in zip(found, found[1:], strict=False))


def test_pii_held_out_spans_in_long_texts():
    """Labelled spans of sentences that were not trained on, joined to texts of many windows, and no span in plain prose."""
    r, hit, wrong, all_ = random.Random(5), 0, 0, 0
    texts, wants = [], []
    for n in range(20):
        text, want = "", set()
        for part, spans in pii.examples(40, 900 + n):
            want |= {(k, len(text) + s, len(text) + e) for k, s, e in spans if e <= len(part)}
            text += part + "\n"
        texts.append(text)
        wants.append(want)
    tagger = pii.default_tagger()
    for text, want in zip(texts, wants, strict=True):
        read, some = pii.Reconciled(text), list(pii.windows(text))
        for s, e in some:
            read.add(s, e, tagger.decode(pii.symbols(text[s:e])[None], np.array([e - s]))[0])
        got = set(read.spans())
        hit, wrong, all_ = hit + len(got & want), wrong + len(got - want), all_ + len(want)
    assert all_ > 1000 and hit >= 0.95 * all_ and wrong <= 0.05 * all_
    plain = [" ".join(r.choice("the on grado venir strasse élan über niño".split()) for _ in range(400)) for _ in range(5)]
    assert pii.detect(tagger, plain) == [([], [])] * 5


def test_pii_decoding_is_the_best_path():
    """Ragged rows against Viterbi over the training pass's emissions."""
    r, t = np.random.default_rng(2), pii.Tagger.fresh(4)
    sizes = np.array([40, 33, 33, 10, 2, 1])
    x = r.integers(1, pii.SYMBOLS, (6, 40))
    got = t.decode(x.astype(np.uint8), sizes)
    for k, n in enumerate(sizes):
        scores = t.emissions(x[k : k + 1, :n])[0][:, 0]
        best, ways = scores[0], [[j] for j in range(pii.TAGS)]
        for s in scores[1:]:
            reach = best[:, None] + t.moves
            ways = [[*ways[int(reach[:, j].argmax())], j] for j in range(pii.TAGS)]
            best = reach.max(axis=0) + s
        assert ways[int(best.argmax())] == got[k, :n].tolist()


def test_pii_gradients():
    r = np.random.default_rng(1)
    t = pii.Tagger.fresh(3)
    x, y = r.integers(0, pii.SYMBOLS, (3, 7)), r.integers(0, pii.TAGS, (3, 7))

    def loss():
        s, *_ = t.emissions(x)
        s = s.astype(np.float64)
        a = s[0]
        for n in range(1, len(s)):
            a = pii._logsumexp(a[:, :, None] + t.moves, 1) + s[n]
        gold = sum(s[n, i, y[i, n]] for n in range(7) for i in range(3)) + sum(t.moves[y[i, n - 1], y[i, n]] for n in range(1, 7) for i in range(3))
        return (pii._logsumexp(a, 1).sum() - gold) / 3

    for p, g in zip(t.parameters(), t.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_operators_beside_columns_of_their_own_names(spark, odd):
    model = language_id.fit(spark, odd.select("g", "text", "lang").withColumnRenamed("g", "key"))
    names = ["n_email", "spans", "SPANS_", "ids", "lang_pred", "score", "n_hex", "_text", "doc_id"]
    df = odd.select("text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for got, mine in (
        (pii.scanned(df, names), ["n_email_", "n_ip", "n_card", "n_phone", "base_sha256", "spans__"]),
        (secrets.scanned(df, names), ["n_assign", "n_access", "n_hex_", "base_sha256", "spans__"]),
        (pieces.encoded(df, pieces.load(), names), ["ids_", "n_pieces", "n_bytes", "exact"]),
        (language_id.predict(df, model, dict.fromkeys(names, "int")), ["lang_pred_", "score_"]),
    ):
        assert got.columns == [*names, *mine] and got.count() == odd.count()
        assert got.select(*names).distinct().collect() == [tuple(range(len(names)))]


# --- 8 ---


def test_chat_round_trip(spark, sf):
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, sf).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [*(tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()), (-1, 0, "user", said), (-1, 1, "assistant", said)]
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(c, []).append((role, text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_trees_and_edges(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "a\\<|b\\\\|", 1.0), (1, 3, 1, "assistant", "c", 2.0), (1, 4, 2, "user", None, 5.0), (1, 5, 3, "user", "<\\|x", 3.0),
        (2, 1, 99, None, "orphan", None), (2, 2, 3, "user", "cycle", 9.0), (2, 3, 2, "user", "cycle", 9.0), (None, 1, None, "we\nird<|", "t", 1.0), (3, 1, None, "user", "tie", 0.0), (3, 2, 1, "assistant", "l", 1.0), (3, 3, 1, "assistant", "r", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    on = {(r.tree_id, r.leaf_id): [] for r in chat.paths(spark, df).collect()}
    for r in chat.paths(spark, df).collect():
        on[r.tree_id, r.leaf_id].append((r.up, r.msg_id))
    assert {k: [m for _, m in sorted(v)] for k, v in on.items()} == {(1, 4): [4, 2, 1], (1, 5): [5, 3, 1], (2, 1): [1], (None, 1): [1], (3, 2): [2, 1], (3, 3): [3, 1]}
    out = chat.conversations(spark, df, 2)
    best = {(r.tree_id, r.branch_rank): r.leaf_id for r in out.collect()}
    assert best == {(1, 1): 4, (1, 2): 5, (2, 1): 1, (None, 1): 1, (3, 1): 2, (3, 2): 3}
    back = {(r.tree_id, r.leaf_id): [(t.role, t.text) for t in r.turns] for r in out.select("tree_id", "leaf_id", chat.parsed(out.formatted).alias("turns")).collect()}
    assert back[1, 4] == [("user", "root"), ("assistant", "a\\<|b\\\\|"), ("user", "")] and back[1, 5][-1] == ("user", "<\\|x") and back[None, 1] == [("we\nird<|", "t")]
    assert chat.conversations(spark, df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, 1, "user", "x"), (1, 1, "user", "x"), (1, None, None, None), (None, 2, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.conversations(spark, chat.linear_tree(same))).collect()} == {1: 3, None: 1}


def test_chat_leaves_off_a_cycle_and_repeated_ids(spark):
    rows = [(1, 1, 3, "user", "c1", 1.0), (1, 2, 1, "user", "c2", 1.0), (1, 3, 2, "user", "c3", 1.0), (1, 4, 3, "user", "off", 9.0), (1, 5, 4, "user", "further off", 9.0), (2, 1, 1, "user", "its own parent", 0.0), (2, 2, 1, "user", "below", 0.0)]
    rows += [(3, n, n - 1 if n > 1 else None, "user", f"t{n}", 0.0) for n in range(1, 14)] + [(3, 20, 6, "assistant", "branch", 0.5)]
    rows += [(4, 1, None, "user", "first", 0.0), (4, 1, None, "user", "also first", 0.0), (4, 2, 1, "assistant", "b", 0.0), (4, 2, 1, "assistant", "b", 0.0), (4, None, 1, "user", "no id", 5.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "tree_id long, msg_id long, parent_id long, role string, text string, score double, t string, m long")
    on = chat.paths(spark, df.where("tree_id < 4"))
    assert on.count() == 13 + 7 and {r.tree_id for r in on.collect()} == {3}
    out = chat.conversations(spark, df, 5)
    back = {(r.tree_id, r.branch_rank): [t.text for t in r.turns] for r in out.select("tree_id", "branch_rank", chat.parsed(out.formatted).alias("turns")).collect()}
    assert back == {(3, 1): [*(f"t{n}" for n in range(1, 7)), "branch"], (3, 2): [f"t{n}" for n in range(1, 14)], (4, 1): ["also first", "b"]}


def test_chat_enumerates_chosen_branches_only(spark):
    """A spine with a leaf on each message: path rows are those of the chosen branches, not of all."""
    n = 60
    rows = [(1, i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(n)] + [(1, 1000 + i, i, "assistant", f"l{i}", 2.5 if i == 7 else 100.0 if i == 20 else 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    for branches in (1, 3):
        got = chat.paths(spark, df, branches).collect()
        score = {1000 + i: i + 1 + rows[n + i][5] for i in range(n)}
        best = sorted(score, key=lambda x: (-score[x], x))[:branches]
        assert {(r.leaf_id, r.branch_rank) for r in got} == {(x, k) for k, x in enumerate(best, 1)}
        for leaf in best:
            own = sorted((r.up, r.msg_id) for r in got if r.leaf_id == leaf)
            assert own == [(0, leaf)] + [(k + 1, leaf - 1000 - k) for k in range(leaf - 999)]
        assert len(got) == sum(leaf - 998 for leaf in best)


def test_chat_is_native(spark, sf):
    plan = queries.op8_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 9 ---


def brute_pieces(v, text):
    if not text:
        return []
    x = "▁" + text.replace(" ", "▁")
    known = {v.bytes_of[int(i)].decode(): (int(i), v.scores[n]) for n, i in enumerate(v.ids)}
    best = [(0.0, 0, [])] + [(-math.inf, 0, [])] * len(x)
    for e in range(1, len(x) + 1):
        for s in range(max(0, e - v.longest), e):
            w = x[s:e]
            if w in known:
                score, ids = known[w][1], [known[w][0]]
            elif e - s == 1:
                score, ids = v.byte_score * len(w.encode()), [int(v.byte_ids[b]) for b in w.encode()]
            else:
                continue
            if best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, s, ids)
    out, e = [], len(x)
    while e:
        out = best[e][2] + out
        e = best[e][1]
    return out


def test_pieces_are_the_best_paths_and_decode_back():
    v, r = pieces.load(), random.Random(6)
    texts = ["hello world", "  two  spaces \n tab\t x", "", "日本語 und äöü ß 🎉🎉", "a", " lead", "trail ", " ", "x" * 300] + ["".join(r.choice(["the ", "Größe", "naïve", "12345", "; ", "  ", "é", "🎈", "\r\n", "ing"]) for _ in range(r.randrange(30))) for _ in range(40)]
    decode, held = pieces.Decoder(v), pieces.Held()
    for t in flat.texts(pa.array(texts), 200):
        ids, at = pieces.encode(v, t, held)
        alone = pieces.encode(v, t)
        assert np.array_equal(ids, alone[0]) and np.array_equal(at, alone[1])
        data, bounds = decode(ids, at)
        for k in range(len(t)):
            text = texts[t.first + k]
            assert ids[at[k] : at[k + 1]].tolist() == brute_pieces(v, text)
            assert data[bounds[k] : bounds[k + 1]].tobytes().decode() == text
    assert not [k for k in v.bytes_of.values() if pieces.MARK in k.lstrip(pieces.MARK)]


def test_pieces_of_long_segments(monkeypatch):
    """A segment walked alone in blocks has the ids that all segments walked together have."""
    v, r = pieces.load(), random.Random(3)
    for _ in range(30):
        text = "".join(r.choice("abcdefgh the ing tion é 日 🎉 xx 12".replace(" ", "") + "aaaa") for _ in range(r.randrange(1, 300)))
        data = np.frombuffer(text.encode(), np.uint8)
        want, _ = pieces.viterbi(v, data, np.array([0, len(data)]))
        for block in (1, 7, 1 << 16):
            assert pieces.long_viterbi(v, data, block).tolist() == want.tolist()
    texts = ["one two", "x" * 50 + "antidisestablishmentarianism" * 9, "", "short " * 4, "tail" * 40]
    t = next(flat.texts(pa.array(texts)))
    whole = [x.tolist() for x in pieces.encode(v, t)]
    monkeypatch.setattr(pieces, "LONG_SEGMENT", 20)
    assert [x.tolist() for x in pieces.encode(v, t)] == whole


def test_pieces_query(spark, sf, odd):
    got = queries.op9_sentencepiece(spark, sf)
    assert got.count() == table(spark, sf, "documents").count() and got.where("not exact").count() == 0
    back = pieces.decoded(pieces.encoded(odd, pieces.load(), ["doc_id"]), pieces.load(), ["doc_id"])
    assert sorted(((r.doc_id or 0, r.text) for r in back.collect()), key=repr) == sorted(((r.doc_id or 0, r.text) for r in odd.collect()), key=repr)
    assert pieces.encoded(odd.limit(0), pieces.load(), ["doc_id"]).count() == 0


# --- 10 ---


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_labels_are_bounded_and_keys_may_be_null(spark, monkeypatch):
    rows = [(None, f"text number {i} of many words", "en" if i % 2 else "fr") for i in range(400)]
    df = spark.createDataFrame(rows, "key long, text string, lang string")
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    assert language_id.fit(spark, df, 20).languages == ["en", "fr"]
    model = language_id.fit(spark, df, 20)
    assert 0.3 < np.exp(model.log_prior).max() < 0.8
    with pytest.raises(ValueError):
        language_id.fit(spark, df.union(spark.createDataFrame([(1, "mot", "de")], df.schema)))


def test_language_scores_equal_direct_bayes(spark, sf, odd):
    docs = table(spark, sf, "documents").selectExpr("doc_id AS key", "text", "lang")
    m = language_id.fit(spark, docs)
    text = "Das ist ein kurzer Text, 123!"
    t = next(flat.texts(pa.array([text])))
    total = m.log_prior + sum(m.log_prob[:, idx].sum(axis=1, dtype=float) for idx, _ in language_id.features(t))
    best, score = m.predict(t)
    assert best[0] == total.argmax() and math.isclose(score[0], 1 / np.exp(total - total.max()).sum(), rel_tol=1e-3, abs_tol=1e-3)
    got = {r.doc_id: r for r in language_id.predict(odd, m, {"doc_id": "long"}).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 11))
    kept = language_id.keep_identified(odd, m)
    assert kept.columns == odd.columns and {4, 5, 6, 11}.isdisjoint(r.doc_id for r in kept.collect())
    none = language_id.fit(spark, docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, none, {"doc_id": "long"}).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), m, {"doc_id": "long"}).count() == 0


def test_texts_of_megabytes(spark, monkeypatch):
    """One text of over two million characters, and one such run without a space, through every operator that reads texts."""
    monkeypatch.setattr(language_id, "GATHERED", 1 << 18)
    words_ = prose(4, 300_000)
    key = "password = hunter2hunter2 ann@example.org " + licenses.TEMPLATES["mit-line"]
    rows = [(1, f"{words_} {key}", "en"), (2, f"{words_} {key} more", "en"), (3, "xy" * 1_000_000, "de"), (4, "short text", "en"), (6, "kurz und gut", "de")]
    docs = spark.createDataFrame([r for r in rows], "doc_id long, text string, lang string").repartition(5, "doc_id")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(spark, docs).collect()}
    assert found[1] == (len(shingle_set(rows[0][1])), 1) and found[2][1] == 1 and found[3] == (1, 3)
    own = {r.doc_id: r for r in secrets.scanned(docs, ["doc_id"]).collect()}
    assert own[1].n_assign == 1 and own[1].spans == f"assign:{len(words_) + 1}:{len(words_) + 26}" and own[3].spans == ""
    got = {r.doc_id: r for r in pii.scanned(docs, ["doc_id"]).collect()}
    assert [got[i].n_email for i in (1, 2, 3)] == [1, 1, 0]
    assert {(r.doc_id, r.license) for r in licenses.licensed(docs).collect()} == {(1, "mit-line"), (2, "mit-line")}
    back = {r.doc_id: r for r in pieces.encoded(docs, pieces.load(), ["doc_id"]).collect()}
    assert all(r.exact for r in back.values()) and len(back) == 5
    bench = spark.createDataFrame([(7, " ".join(words_.split()[150_000:150_040]))], "item_id long, text string")
    assert {(r.doc_id, r.first_word) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 150_000), (2, 150_000)}
    model = language_id.fit(spark, docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    said = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model, {"doc_id": "long"}).collect()}
    assert said[1] == said[2] == "en" and said[3] == "de"
    model, vocabulary = brown.fit(spark, docs.select("text"))
    scored = {r.doc_id: r.n_tokens for r in brown.scored(spark, docs.select("doc_id", F.lit(False).alias("held_out"), "text"), model, vocabulary).collect()}
    assert scored[3] == 2 and scored[1] == len(words(rows[0][1])) + 1
