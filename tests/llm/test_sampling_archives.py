"""Importance resampling, web archives and whitening, against plain Python."""

import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnline.llm import importance, queries, warc, whitening
from tarnline.llm.common import Staged

SF = "/root/testdata/sf0.001"


def features(text):
    small = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(f, buckets):
    return zlib.crc32(f.encode()) % buckets


LONG = " ".join(f"word{i % 700} É{i}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "One TWO"), (6, "a b c d e f g h i j k l m n o p q r s t"), (7, "ÀÉ é İ ß x\x00y \x7f z 😀 " * 9), (8, LONG), (None, "no id " * 12), (6, "a b c d e f g h i j k l m n o p q r s t"), (10, "a b c d e f g h i j k l m n o p q r s"), (11, "A,b;C" * 20)]


def sample_by_hand(docs, target, buckets, least, percent):
    s, t = (Counter(bucket(f, buckets) for x in rows for f in features(x)[1]) for rows in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        w, f = features(text)
        weight = sum(gain[bucket(x, buckets)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for i, r in enumerate(enough[: percent * len(enough) // 100]):
        r[5] = i + 1
    return Counter(map(tuple, rows))


@pytest.mark.parametrize(("buckets", "least", "percent"), [(10_000, 20, 60), (7, 1, 100), (50, 20, 5)])
def test_importance(spark, buckets, least, percent):
    target = ["one two three", None, "z é " * 30]
    docs = spark.createDataFrame([(*x, "w", 1) for x in TEXTS], "doc_id long, text string, weight string, made int")
    goal = spark.createDataFrame([(x, "b") for x in target], "text string, buckets string")
    got = importance.importance(docs, goal, Staged(spark, "t"), least_words=least, percent=percent, buckets=buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == sample_by_hand(TEXTS, target, buckets, least, percent)
    ids = {r.doc_id for r in got.filter("rank is not null").collect()} - {None}
    assert {r.doc_id for r in importance.drawn(docs, got).collect()} == ids


def test_importance_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert importance.importance(none, some, Staged(spark, "t")).count() == 0
    got = importance.importance(some, none, Staged(spark, "t"), percent=60)
    assert Counter(map(tuple, got.collect())) == sample_by_hand(TEXTS, [], 10_000, 20, 60)


def test_ranks_run_over_many_ranges(spark):
    rows = [(i, 20 + i % 3, 0, 0, (i * 7919) % 50, i) for i in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, uid long").repartition(13)
    got = importance.ranked(scored, Staged(spark, "t"), "doc_id", least_words=21, percent=50)
    want = sorted((r for r in rows if r[1] >= 21), key=lambda r: (-r[4], r[0]))
    assert [r.doc_id for r in got.filter("rank is not null").orderBy("rank").collect()] == [r[0] for r in want[: len(want) // 2]]
    assert got.count() == 3000


def test_gains_are_one_literal(spark):
    df = spark.createDataFrame([([0, 3, 3],)], "b array<int>").select(importance.weight(F.col("b"), [5, 0, 0, -7]).alias("w"))
    assert df.first().w == -9
    assert "split" not in df._jdf.queryExecution().optimizedPlan().toString()


PAGES = [(5, "http://a/x y", "<p>é😀</p>" * 30), (2, "http://b", "<p>é😀</p>" * 30), (9, None, "<p>é😀</p>" * 30), (1, "u", None), (3, "u\r\nX: y", ""), (4, "u", "z" * 99), (6, "u", "z" * 99), (7, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50 + "WARC/1.1\r\n"), (8, "u", "0\r\n\r\n" * 9000), (2, "http://b", "<p>é😀</p>" * 30), (None, "n", "q" * 200), (10, "n", "q" * 200), (None, "n", "r" * 200)]


def pages_by_hand(rows):
    least = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None and len(p) >= 100:
            least[p] = min(i, least.get(p, i))
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        again = p in least and i != least[p]
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least[p] if again else None))
    return Counter(out)


@pytest.mark.parametrize(("segment", "chunk", "compression", "most"), [(16_384, 4_096, "none", 100_000), (37, 5, "none", 0), (1000, 100_000, "gzip", 0)])
def test_archives_round_trip(spark, tmp_path, monkeypatch, segment, chunk, compression, most):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most)
    pages = spark.createDataFrame([(*x, "clash") for x in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path, Staged(spark, "t"), segment_bytes=segment, chunk_bytes=chunk, compression=compression)
    got = warc.read_pages(spark, path, Staged(spark, "t"))
    assert got.filter("not whole").count() == 0
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.select(names).collect())) == pages_by_hand(PAGES)
    if segment == 37:
        assert warc.read_records(spark, path).filter("kind = 'continuation'").count() > 1000


def test_archive_of_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path, Staged(spark, "t"))
    assert warc.read_pages(spark, path, Staged(spark, "t")).count() == 0


def test_a_hot_payload_is_not_joined_by_its_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 1)
    rows = [(i, "u", "hot " * 40 if i % 3 else f"page {i // 2 * 2} " * 20) for i in range(900)]
    path = f"file://{tmp_path}/w"
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, Staged(spark, "t"))
    got = warc.read_pages(spark, path, Staged(spark, "t"))
    assert Counter(tuple(r)[0:1] + tuple(r)[3:4] + (r.payload_digest, r.record_type, r.refers_to) for r in got.select("page_id", "uri", "whole", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == Counter((r[0], r[1], r[2], r[3], r[4]) for r in pages_by_hand(rows).elements())


def record(kind, block, **more):
    pairs = {"WARC-Type": kind, "WARC-Record-ID": more.pop("id"), "Content-Length": more.pop("length", len(block))} | {k.replace("_", "-"): v for k, v in more.items()}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding:\r\n gzip,\r\n chunked\r\n\r\n5;x=1\r\nabcde\r\n1\r\nf\r\n0\r\nTrailer: t\r\n\r\n"
    plain = b"HTTP/1.0 200 OK\r\n\r\nplain\r\n\r\n"
    seg = dict(WARC_Segment_Origin_ID="<s>")
    parts = [
        record("warcinfo", b"software: x\r\n", id="<i>"), record("response", http, id="<a>", X_Page_ID=1), record("response", plain, id="<b>", X_Page_ID=2),
        record("continuation", plain[30:], id="<s3>", WARC_Segment_Number=3, WARC_Segment_Total_Length=len(plain), **seg), record("response", plain[:9], id="<s>", WARC_Segment_Number=1, X_Page_ID=3), record("continuation", plain[9:30], id="<s2>", WARC_Segment_Number=2, **seg),
        record("response", plain[:9], id="<m>", WARC_Segment_Number=1, X_Page_ID=4), record("continuation", plain[9:], id="<m3>", WARC_Segment_Number=3, WARC_Segment_Total_Length=len(plain), WARC_Segment_Origin_ID="<m>"),
        record("response", plain[:9], id="<t>", WARC_Segment_Number=1, X_Page_ID=5), record("continuation", plain[9:], id="<t2>", WARC_Segment_Number=2, WARC_Segment_Total_Length=99, WARC_Segment_Origin_ID="<t>"),
        record("response", plain, id="<c>", length=4000, X_Page_ID=6), record("response", http[:-20], id="<d>", X_Page_ID=7),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", id="<r>", X_Page_ID=8, WARC_Payload_Digest="sha256:" + hashlib.sha256(b"abcdef").hexdigest()), record("revisit", b"", id="<q>", X_Page_ID=9, WARC_Payload_Digest="sha256:00"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = {r.page_id: r for r in warc.read_pages(spark, f"file://{tmp_path}/w", Staged(spark, "t")).collect()}
    assert {i: (r.payload_bytes, r.whole) for i, r in got.items()} == {1: (6, True), 2: (9, True), 3: (9, True), 4: (None, False), 5: (None, False), 6: (None, False), 7: (None, False), 8: (6, True), 9: (None, True)}
    assert (got[8].refers_to, got[9].refers_to, got[2].payload_digest) == (1, None, hashlib.sha256(b"plain\r\n\r\n").hexdigest())


def test_remainders():
    moduli = whitening.primes(1 << 200)
    assert math.prod(moduli) > 1 << 200 and all(p < 1 << 20 for p in moduli) and len(set(moduli)) == len(moduli)
    for v in (0, 1, -1, (1 << 198) + 12345, -(1 << 198)):
        assert whitening.remainders_to_whole([v % p for p in moduli], moduli) == v


@pytest.mark.parametrize("size", [5, 300, 1 << 40])
def test_scatter_is_exact(spark, size):
    rng = np.random.default_rng(7)
    rows = [[int(v) for v in rng.integers(-size, size, 6)] for _ in range(700)]
    xs = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(5)
    got = whitening.scatter(xs, 6, whitening.primes(2 * len(rows) * size * size + 1))
    own = [[1, *r] for r in rows]
    assert got == [[sum(a[i] * a[j] for a in own) for j in range(7)] for i in range(7)]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 8)) * np.array([3, 2.5, 2, 1.5, 1, 0.5, 0.2, 0.1]) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    rows = [(i, [float(np.float32(v)) for v in r], 1.0) for i, r in enumerate(base)]
    rows += [(1000 + i, rows[0][1], 1.0) for i in range(200)] + [(None, rows[1][1], 0.0), (1, [-0.0] * 8, 0.0)]
    odd = [(2000, None, 0.0), (2001, [None] * 8, 0.0), (2002, [float("nan")] * 8, 0.0), (2003, [1.0] * 7 + [float("-inf")], 0.0), (2004, [1.0] * 5, 0.0), (2005, [], 0.0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n double").repartition(5)
    got = whitening.whiten(df, Staged(spark, "t")).toPandas()
    x = {tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v, _ in rows}
    fit = np.array(sorted(x), object)
    n, s = len(fit), fit.sum(axis=0)
    dev = n * fit - s
    cover = (dev.T @ dev / (n * n)) / n
    values, vectors = np.linalg.eigh(cover.astype(float))
    order = np.argsort(-values)[:4]
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    by = {tuple(r): (int(sum(int(v) ** 2 for v in n * np.array(r, object) - s)), (np.array(n * np.array(r, object) - s, float) / n) @ vectors[:, order] / np.sqrt(values[order])) for r in map(tuple, fit)}
    signs = {}
    ids = {}
    for i, v, _ in rows:
        ids.setdefault(i, []).append(tuple(math.floor(256 * float(np.float32(c))) for c in v))
    for r in got.itertuples():
        key = None if r.vec_id != r.vec_id else int(r.vec_id)
        if len(ids[key]) > 1:
            continue
        deviation, white = by[ids[key][0]]
        w = white[r.component - 1]
        assert r.deviation == deviation and abs(abs(r.whitened) - abs(w)) < 1e-9
        if abs(w) > 1e-6:
            signs.setdefault(r.component, set()).add(r.whitened * w > 0)
        assert abs(r.explained - values[order[r.component - 1]] / np.trace(cover.astype(float))) < 1e-9
    assert all(len(x) == 1 for x in signs.values())


def test_whitening_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema), Staged(spark, "t")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema), Staged(spark, "t")).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), Staged(spark, "t")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema), Staged(spark, "t")).toPandas()
    assert abs(line[line.component == 1].explained - 1).max() < 1e-12 and (line[line.component == 2].whitened == 0).all() and line.identity_error.max() < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(itertools.product((-(2**21), 2**21 + 1), (3, 2**20)))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Staged(spark, "t")).toPandas()
    x = [[256 * int(v) for v in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * v - t) ** 2 for v, t in zip(r, s, strict=True)) for i, r in enumerate(x)}
    assert {int(r.vec_id): int(r.deviation) for r in got.itertuples()} == want
    with pytest.raises(Exception, match="too large|no long"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>"), Staged(spark, "t")).count()


def test_whitening_of_the_given_table(spark):
    got = queries.op13_whitening(spark, SF)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert got.count() == 4 * vectors and got.select("identity_error").first()[0] < 1e-9
