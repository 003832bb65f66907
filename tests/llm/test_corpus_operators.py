"""The operators that look across documents, against brute force."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnline.llm import imatch, neardup, suffixdedup
from tarnline.llm.common import Staged

SCHEMA = "doc_id long, text string, id long, a string"


def shingles(text, k):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        own = own.replace(c, " ")
    own = [w for w in own.split(" ") if w]
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def brute_components(rows, k, percent):
    sets_ = [shingles(t, k) for _, t in rows]
    where = {}
    for i, s in enumerate(sets_):
        for x in s:
            where.setdefault(x, []).append(i)
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(sets_):
        both = Counter(j for x in s for j in where[x] if j < i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets_[j]) - n):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(sets_[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_near_duplicates(spark):
    own = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    for i in range(90):  # a group over the size of a small node: a hub, and copies that differ from each other
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(120)] = f"v{rng.randint(0, 10**6)}"
        own.append((10000 + i, " ".join(copy)))
    own += [(20000, " ".join(base)), (20001, None), (20002, ""), (20003, " \n"), (20004, "a b"), (20005, "A\tB"), (20006, "a b c"), (20005, "A\tB"), (20007, "lone " * 30000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in own], SCHEMA)
    got = neardup.near_duplicates(docs, Staged(spark, "t"), words=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(own, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = neardup.drop_near_duplicates(docs, Staged(spark, "t"))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute_components(own, 5, 80)})


def test_near_duplicates_in_crowded_nodes(spark):
    rng = random.Random(7)
    shared, own = [f"s{i}" for i in range(400)], []
    for i in range(300):  # pairs at about 0.81, all of them at about 0.68 to each other: nodes stay large for many levels, no hub joins them
        tail = [f"t{rng.randint(0, 10**9)}" for _ in range(90)]
        own += [(2 * i, " ".join(shared + tail)), (2 * i + 1, " ".join(shared + tail[:43] + [f"t{rng.randint(0, 10**9)}" for _ in range(47)]))]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in own], SCHEMA), Staged(spark, "t")).collect()
    want = brute_components(own, 5, 80)
    assert sum(r.kept for r in got) == 300 and Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**9)}"
    common, own, planted = [word() for _ in range(60)], [], 0
    for i in range(400):  # pairs just over 0.8 that share a passage with all others, and long texts of many different shingles
        body = [word() for _ in range(540 if i % 50 else 30_000)]
        changed = list(body)
        for at in rng.sample(range(20, len(body) - 20), 1):
            n = int(0.095 * len(body))
            changed[at : at + n] = [word() for _ in range(len(body[at : at + n]))]
        a, b = " ".join(common + body), " ".join(common + changed)
        x, y = shingles(a, 5), shingles(b, 5)
        planted += 100 * len(x & y) >= 80 * len(x | y)
        own += [(2 * i, a), (2 * i + 1, b)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in own], SCHEMA), Staged(spark, "t")).collect()}
    found = sum(got[2 * i + 1] == 2 * i for i in range(400))
    assert planted >= 350 and 0.99 * planted <= found <= planted


def test_near_duplicates_of_odd_tables(spark):
    rows = [(None, "a b c d e f", 1, ""), (1, "a b c d e f", 1, ""), (1, "other words in this row here", 1, ""), (2, "a b c d e f", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, Staged(spark, "t")).collect())
    assert got == Counter([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)])
    assert neardup.near_duplicates(docs.limit(0), Staged(spark, "t")).count() == 0
    assert neardup.drop_near_duplicates(docs, Staged(spark, "t")).count() == 3


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(links, Staged(spark, "t")).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100}


@pytest.mark.parametrize("many", [True, False])
def test_fingerprints(spark, many):
    rows = [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] if many else []
    rows += [(1, None), (2, ""), (3, "é😀 one two"), (3, "é😀 one two"), (9000, "x" * 50000), (5, "three")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = imatch.fingerprint_with_edits(docs).collect()
    ordered = sorted((d, t or "") for d, t in rows)
    want = Counter()
    for i, (doc, text) in enumerate(ordered):
        following, half = ordered[(i + 1) % len(ordered)][1], len(text) // 2
        want[(doc, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = {d: t or "" for d, t in rows}
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    if many:
        own = [r for r in got if r.n_chars > 200 and r.doc_id != 9000]
        assert sum(r.near_edited > r.near_next for r in own) > 0.9 * len(own)
        assert sum(r.near_next for r in own) / len(own) < 0.05
    assert imatch.fingerprint_with_edits(docs.limit(0)).count() == 0
    one = imatch.fingerprint_with_edits(docs.filter("doc_id = 5")).first()
    assert one.near_next == 1.0


def signed(n):
    return n - 2**64 if n >= 2**63 else n


def hashed(values, seed=42):
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", int(v))
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def test_fingerprints_by_hand(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.randint(0, 40)))) for i in range(300)]
    terms = {d: sorted({w for w in re.split(r"[^a-z0-9]+", t) if w}) for d, t in rows}
    df = Counter(w for own in terms.values() for w in own)
    band = {w for w, n in df.items() if 2 <= n <= 30}

    def fingerprint(own):
        known = sorted(hashed([w]) for w in own if w in band)
        if not known:
            return "x" + f"{hashed(own) & (2**64 - 1):x}"
        out, subsets = [f"{hashed(known) & (2**64 - 1):x}"], [known] * imatch.SEEDS
        for r in range(1, imatch.RATES + 1):
            subsets = [[h for h in x if (hashed([h, np.int32(s)]) & (2**64 - 1)) >> 2 * r & 3 == 0] for s, x in enumerate(subsets)]
            out += ["" if not x else f"{hashed(x) & 0xFFFF:x}" for x in subsets]
        return "-".join(out)

    def alike(a, b):
        if a == b or "x" in (a[0], b[0]):
            return float(a == b)
        pairs = [(x, y) for x, y in zip(a.split("-"), b.split("-"), strict=True) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs)

    got = imatch.fingerprint_with_edits(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    want = {d: fingerprint(own) for d, own in terms.items()}
    assert len(got) == 300 and {r.doc_id: r.fingerprint for r in got} == want
    for r in got:
        assert r.near_next == pytest.approx(alike(want[r.doc_id], want[(r.doc_id + 1) % 300]))
        assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint))


@pytest.mark.parametrize("range_bytes", [150, 1000, 10**6])
def test_next_in_order_over_ranges(spark, range_bytes):
    ids = [*range(0, 90, 3), 5, 5, 5, *range(100, 140)]
    rows = [(i, f"text {i} {k}") for k, i in enumerate(ids)]
    got = imatch.next_in_order(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", range_bytes).filter("ghost = 0").collect()
    order = sorted(rows)
    assert {r.text: r.next_text for r in got} == {order[i][1]: order[(i + 1) % len(order)][1] for i in range(len(order))} and len(got) == len(rows)


def test_fingerprint_order_with_null_ids(spark):
    docs = spark.createDataFrame([(None, "first one", 1, ""), (1, "second", 1, ""), (2, "last word", 1, "")], SCHEMA)
    got = {r.doc_id: r.edited_sha256 for r in imatch.fingerprint_with_edits(docs).collect()}
    assert got[2] == hashlib.sha256(b"last firs").hexdigest() and got[None] == hashlib.sha256(b"firstseco").hexdigest()


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, "all " + ("some " if i % 20 == 0 else "") + f"only{i}", 1, "") for i in range(400)], SCHEMA)
    band = {r.h for r in imatch.lexicon(docs).collect()}
    assert band == {spark.range(1).select(F.xxhash64(F.lit("some"))).first()[0]}


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randint(1, 150), rng.choice([1, 2, 3, 8])
        s = [rng.randint(1, k) for _ in range(n)] + [0]
        assert suffixdedup.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n + 1), key=lambda i: s[i:])  # noqa: B023


def test_suffix_arrays_of_many_names():
    rng = random.Random(5)
    for n, k in ((60000, 250), (30000, 4)):  # the first has over 3000 different leftmost-smaller substrings, so its reduced string a large alphabet
        body = bytes(rng.randrange(k) for _ in range(n)) * 2
        s = np.append(np.frombuffer(body, np.uint8).astype(np.int64) + 1, 0)
        raw = s.astype(">u2").tobytes()
        array = suffixdedup.suffix_array(s)
        assert sorted(array.tolist()) == list(range(len(s)))
        assert all(raw[2 * a :] < raw[2 * b :] for a, b in zip(array[:-1:7].tolist(), array[1::7].tolist(), strict=False))


def test_every_window_has_one_anchor():
    rng = random.Random(4)
    for text in (b"ab" * 90, b"z" * 200, bytes(rng.randrange(256) for _ in range(900)), bytes(rng.randrange(2) for _ in range(400)), b"x" * 60 + bytes(range(70)) + b"x" * 60, b"q" * 50):
        b = np.frombuffer(text, np.uint8)
        at, first, last, gram, _ = suffixdedup.anchors(b)
        h = suffixdedup.substring_hashes(b, suffixdedup.GRAM)
        span = suffixdedup.LENGTH - suffixdedup.GRAM + 1
        want = [i + int(h[i : i + span].argmin()) for i in range(len(text) - suffixdedup.LENGTH + 1)]
        got = {w: (int(p), int(g)) for p, a, z, g in zip(at, first, last, gram, strict=True) for w in range(a, z + 1)}
        assert got == {w: (p, int(h[p])) for w, p in enumerate(want)} and first[0] == 0 and (first[1:] == last[:-1] + 1).all()


@pytest.mark.parametrize("hot", [5000, 3])
def test_repeated_bytes(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    own = [(r.doc_id + 10, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    rng = random.Random(2)
    line = "".join(rng.choices("abcdef é", k=75))
    own += [(1000 + i, "".join(rng.choices("uvwxyz ", k=rng.randint(0, 90))) + line + "".join(rng.choices("uvwxyz ", k=rng.randint(0, 90)))) for i in range(60)]
    own += [(1, None), (2, ""), (3, line[:20]), (9, "z" * 49), (8, "z" * 3000), (7, "z" * 60), (2000, line[10:]), (2001, line[:-10]), (2001, line[:-10]), (2001, "other " + line[5:65] + " end"), (None, line), (2002, "ab" * 400), (2003, "b" + "ab" * 30)]
    own += [(3000 + i, "".join(rng.choices("uvwxyz ", k=40)) + "the same words, always" + "".join(rng.choices("mn", k=9)) * 3) for i in range(80)]  # a gram in many texts that differ
    docs = spark.createDataFrame([(*r, 1, "x") for r in own], SCHEMA)
    first = {}
    for doc, text in own:
        b = (text or "").encode()
        for i in range(len(b) - 49) if doc is not None else ():
            first[b[i : i + 50]] = min(doc, first.get(b[i : i + 50], doc))
    want = Counter()
    for doc, text in own:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49) if doc is not None else ():
            if first[b[i : i + 50]] < doc:
                gone[i : i + 50] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        want[(doc, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g))] += 1
    got = suffixdedup.remove_repeats(docs, Staged(spark, "t")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert sum(k[2] > 0 for k in want) > 40
    assert suffixdedup.remove_repeats(docs.limit(0), Staged(spark, "t")).count() == 0
