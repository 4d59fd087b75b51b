"""Filter audit, importance resampling and WARC revisits against plain Python, and their edge cases."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from kinloom.llm import audit, flat, queries, resample, warc
from kinloom.llm.common import table
from kinloom.operators import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- filter audit ---


def brute_audit(docs, labels):
    """docs (id, text, part), labels (id, quality, toxic): every order run row by row."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, part in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, removed_by = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(now)
                out[part, "".join(order), step] = [len(left), len(now), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in own), sum(r[2] for r in now), sum(r[3] for r in now)]
                gone += now
        for (p, order, step), found in out.items():
            if p == part:
                found.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df, labels):
    rows = audit.audit(df, labels, {"quality": "good_lost", "toxic": "toxic_lost"}).collect()
    found = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_query_equals_every_order_row_by_row(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()]
    labels = [tuple(r) for r in table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    got = {tuple(r[:3]): tuple(r[3:]) for r in queries.op11_filter_audit(spark, sf).collect()}
    assert got == brute_audit(docs, labels)


def test_audit_edges(spark):
    """Nulls everywhere, null ids, rows that repeat, ids with several texts and labels, columns of the operator's own names."""
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "a"), (1, long, "a"), (2, long, "a"), (3, long.upper(), None), (4, None, "b"), (5, "", "b"), (6, "$ x x x x", "a"), (6, "other", "b"), (None, long, "a"), (None, long, "a"), (None, None, None), (7, "a\nb\tc d" * 9000, "b")]
    labels = [(1, 1, 0), (1, None, 1), (2, 0, 0), (None, 1, 1), (6, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", True) for r in docs], "doc_id long, text string, source string, mask int, n int, id int, digest string, quality boolean")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(docs, labels)
    assert audited(df, lab) == want
    assert len(want) == 3 * 600
    assert audited(df.limit(0), lab) == {}
    assert audited(df, lab.limit(0)) == brute_audit(docs, [])


def test_audit_cells_are_the_masks(spark):
    r = random.Random(3)
    rows = [(i, r.choice("pq"), r.randrange(32), r.randrange(1, 4), r.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, part string, mask int, n long, good boolean")
    want = Counter()
    for _, part, mask, n, good in rows:
        want[part, mask, False] += n
        want[part, mask, True] += n * good
    for row in audit.cells(audit.walsh_sums(df, 5, ["good"]), 5, ["good"]).collect():
        assert list(row["all"]) == [want[row["part"], m, False] for m in range(32)]
        assert list(row["good"]) == [want[row["part"], m, True] for m in range(32)]


# --- importance resampling ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute_drawn(docs, target, share=5, least=20):
    have, want = Counter(), Counter()
    for _, text in docs:
        have.update(plain_features(text)[0])
    for text in target:
        want.update(plain_features(text)[0])
    s_all, t_all = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s_all + 10000) / ((have[b] + 1) * (t_all + 10000))))
    out, enough = [], []
    for i, text in docs:
        found, n = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        row = [i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if n >= least:
            enough.append(row)
    for k, row in enumerate(sorted(enough, key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))[: share * len(enough) // 100], 1):
        row[4] = k
    return sorted(map(tuple, out), key=repr)


def test_resampling_query_equals_plain_python(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    target = [r.text for r in table(spark, sf, "benchmark").collect()]
    assert sorted(map(tuple, queries.op12_importance_resampling(spark, sf).collect()), key=repr) == brute_drawn(docs, target)


@pytest.mark.parametrize("hub", [1024, 3])
def test_resampling_edges(spark, monkeypatch, hub):
    """Hot and rare texts, null ids and texts, repeated rows, ties, very long texts and words, an empty target."""
    monkeypatch.setattr(components, "HUB_ROWS", hub)
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(["Alpha", "beta", "né", "日本", "x1", "z" * r.randrange(1, 200)]) for _ in range(n))
    copy = prose(40)
    docs = [(i, copy) for i in range(60)] + [(100 + i, prose(r.randrange(0, 60))) for i in range(60)]
    docs += [(None, prose(30)), (None, None), (5, copy), (5, copy), (7, prose(25)), (900, ""), (901, "--- ..."), (902, prose(30000)), (903, "q" * 100_000)]
    target = [prose(50), None, ""]
    df = spark.createDataFrame([(*x, 1, b"x") for x in docs], "doc_id long, text string, copies int, digest binary").repartition(3)
    goal = spark.createDataFrame([(x, 1) for x in target], "text string, copies int")
    got = lambda d, g, **k: sorted(map(tuple, resample.drawn(spark, d, g, **k).collect()), key=repr)
    assert got(df, goal) == brute_drawn(docs, target)
    assert got(df, goal.limit(0), share=50) == brute_drawn(docs, [], 50)
    assert got(df.limit(0), goal) == []


def test_feature_hashes_equal_crc32():
    r = random.Random(1)
    texts = ["Hello World foo", "", "é ü日本 x-y 12ab", "a" * 500 + " b " + "c" * 130 + " d", "one", "..", "X Y", "e" * 64 + " " + "f" * 65 + "-" + "g" * 128] + [" ".join("".join(r.choice("abcdéZ9") for _ in range(r.randint(1, 150))) for _ in range(30)) for _ in range(50)]
    for chunk in (0, 100):
        for t in flat.texts(pa.array(texts), chunk):
            at, owner, n = resample.features(t, 10000)
            for i in range(len(t)):
                want, words = plain_features(texts[t.first + i])
                assert sorted(at[owner == i].tolist()) == sorted(want) and n[i] == words


def test_gains_of_whole_numbers():
    have, want = np.array([0, 5, 10**9]), np.array([3, 0, 7])
    for b, g in enumerate(resample.gains(have, want).tolist()):
        assert g == math.floor(1000 * math.log((want[b] + 1) * (have.sum() + 3) / ((have[b] + 1) * (want.sum() + 3))))


# --- WARC ---


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_query_equals_plain_python(spark, sf):
    pages = [(r.page_id, (r.html or "").encode()) for r in table(spark, sf, "pages").collect()]
    last = {}
    for i, html in pages:
        last[html] = max(i, last.get(html, i))
    want = sorted((i, len(html), sha1(html), "response" if last[html] == i else "revisit", None if last[html] == i else last[html]) for i, html in pages)
    assert sorted(map(tuple, queries.op13_warc_revisits(spark, sf).collect())) == want


PAGES = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (9, "http://c/", "<p>one</p>"), (3, "http://d/\r\nWARC-Type: x", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (4, None, None), (5, "", ""), (6, "http://é/", "日本" * 40_000), (7, "u", "\r\n\r\n"), (8, "v", "\x00\x01\x1f"), (None, "n", "<p>one</p>"), (None, "m", "alone"), (9, "http://c/", "<p>one</p>"), (10, "w", "twice"), (10, "x", "other")]


def payload_of(html):
    return (html or "").encode()


def linked_rows(spark, df, least=0):
    records = warc.archived(spark, warc.captures(df, "page_id", "url", "html"), least)
    return sorted(map(tuple, records.select("key", "payload_bytes", "payload_digest", "record_type", "refers_key").collect()), key=repr)


def brute_warc(pages, least=0):
    last = {}
    for i, _, html in pages:
        p = payload_of(html)
        last[p] = max((x for x in (i, last.get(p)) if x is not None), default=None)
    again = lambda i, p: len(p) >= least and last[p] != i
    return sorted(((i, len(p), sha1(p), "revisit" if again(i, p) else "response", last[p] if again(i, p) else None) for i, p in ((i, payload_of(h)) for i, _, h in pages)), key=repr)


@pytest.mark.parametrize("hub", [1024, 3])
def test_warc_edges(spark, monkeypatch, hub):
    """Null keys, payloads and URIs, repeated rows and keys, payloads that look like records, columns of the operator's own names."""
    monkeypatch.setattr(components, "HUB_ROWS", hub)
    pages = [(*p, "x", 1) for p in [*PAGES, *((100 + i, "h", "") for i in range(40))]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string, key int").repartition(3)
    plain = [p[:3] for p in pages]
    want = brute_warc(plain)
    got = linked_rows(spark, df)
    assert got == sorted((w for w in want), key=repr)
    assert linked_rows(spark, df, 6) == brute_warc(plain, 6)
    assert linked_rows(spark, df.limit(0)) == []


def test_warc_archives_are_standard_records(spark, tmp_path):
    """Read with nothing but the format's rules: fields, lengths, digests, HTTP blocks, profiles; and payloads come back."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = warc.deduplicate(spark, warc.captures(df, "page_id", "url", "html", "2024-05-06T07:08:09Z"), str(tmp_path / "a.warc"))
    seen, ids = Counter(), set()
    for f in sorted((tmp_path / "a.warc").glob("part-*.gz")):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            block, data = rest[:n], rest[n:]
            assert first == "WARC/1.1" and data[:4] == b"\r\n\r\n" and fields["WARC-Date"] == "2024-05-06T07:08:09Z"
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
            data = data[4:]
            http, _, body = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK")
            seen[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "response":
                assert fields["WARC-Payload-Digest"] == "sha1:" + sha1(body)
                ids.add(fields["WARC-Record-ID"])
            else:
                assert not body and fields["WARC-Profile"] == warc.PROFILE and fields["WARC-Refers-To-Target-URI"] == "http://c/" or fields["WARC-Refers-To-Target-URI"] == ""
    want = brute_warc(PAGES)
    assert seen == Counter(r[3] for r in want)
    back = warc.read(spark, path, payloads=True).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in back} == {payload_of(h) for *_, h in PAGES} and {f"<{r.record_id}>" for r in back} == ids


def test_warc_reader_takes_members_blocks_and_torn_ends(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 7)
    record = lambda n: f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    sizes = [0, 1, 5, 300, 0]
    for data in (b"".join(map(record, sizes)), gzip.compress(b"".join(map(record, sizes))), b"".join(gzip.compress(record(n)) for n in sizes), gzip.compress(b"") + gzip.compress(record(3)[:20]) + gzip.compress(record(3)[20:])):
        found = [len(block) for _, block in warc.parsed(memoryview(data))]
        assert found == (sizes if len(found) > 1 else [3])
    with pytest.raises(ValueError):
        list(warc.parsed(memoryview(record(9)[:-8])))
    with pytest.raises(ValueError):
        list(warc.parsed(memoryview(b"no archive\r\n\r\n")))
    assert list(warc.parsed(memoryview(b""))) == []
