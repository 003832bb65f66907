"""Benchmark decontamination by sparse suffix arrays over shards of the training text.

Every task cuts its documents into shards of bounded bytes. A shard's words become integers of the test
vocabulary (0: any other word), its suffixes that can start a test window are sorted into a suffix array,
and every test suffix is binary-searched in it word by word, all test suffixes at once in numpy. The hits
give the covered words, the items and, extended to both ends, the longest verbatim match and its place.
Nothing is shuffled: a document's result is made where its row is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import add_struct, free_name

#: Words of a window.
WINDOW = 10
#: Bytes of test text searched in one pass; a larger benchmark takes more narrow passes over the same rows.
BLOCK_BYTES = 4_000_000
#: Bytes to what they are as word characters: letters A-Z in lower case, what is in no word a space.
_AS_WORD = bytes((b + 32) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RESULT = StructType([
    StructField("n_words", LongType()),
    StructField("hit_starts", ArrayType(LongType())),
    StructField("hit_ends", ArrayType(LongType())),
    StructField("items", ArrayType(StringType())),
    StructField("longest_words", LongType()),
    StructField("longest_item", StringType()),
    StructField("longest_at", LongType()),
])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_AS_WORD).split() if text else []


class TestSuffixes:
    """A block of test items as integers, with one entry for every suffix that holds a window."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        tokens, start, need, item, left = [0], [], [], [], []
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not own:
                continue
            k, at = min(window, len(own)), len(tokens)
            for i in range(len(own) - k + 1):
                start.append(at + i)
                need.append(k)
                item.append(len(self.ids))
                left.append(len(own) - i)
            tokens += [*own, 0]
            self.ids.append(name)
        self.tokens = np.array(tokens + [0] * window, np.int64)
        self.start, self.need, self.item, self.left = (np.array(x, np.int64) for x in (start, need, item, left))
        self.base = len(self.vocabulary) + 1
        self.shortest = int(self.need.min()) if start else 0
        self.deepest = int(self.need.max()) if start else 0
        self.heads = [np.unique(self._code(self.tokens, self.start, k)) for k in range(1, min(self.shortest, 3) + 1)]

    def _code(self, tokens: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        code = tokens[at]
        for j in range(1, k):
            code = code * self.base + tokens[at + j]
        return code

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Positions of a shard where a window can start: their first words start one."""
        at = np.flatnonzero(tokens[: len(tokens) - self.deepest])
        for k, known in enumerate(self.heads, 1):
            if k > 1 and len(at):
                code = self._code(tokens, at, k)
                found = np.searchsorted(known, code)
                at = at[known[np.minimum(found, len(known) - 1)] == code]
            elif k == 1 and len(at):
                first = np.zeros(self.base, bool)
                first[known] = True
                at = at[first[tokens[at]]]
        return at

    def suffix_array(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places in the order of their suffixes, compared over as many words as the longest window has."""
        if not len(at):
            return at
        per = max(1, int(40 // max(1, np.log2(self.base + 1))))
        rank = np.zeros(len(at), np.int64)
        order = np.arange(len(at))
        for d in range(0, self.deepest, per):
            k = min(per, self.deepest - d)
            code = self._code(tokens, at + d, k)
            order = np.lexsort((code, rank))
            moved = np.empty(len(at), bool)
            moved[0] = False
            r, c = rank[order], code[order]
            moved[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
            new = np.empty(len(at), np.int64)
            new[order] = np.cumsum(moved)
            rank = new
            if moved[1:].all():
                break
        return at[order]

    def search(self, tokens: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every test suffix whose window occurs: its number and its interval in the suffix array."""
        query = np.arange(len(self.start))
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(array), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(self.deepest + 1):
            over = self.need[query] == d
            if over.any():
                done.append((query[over], low[over], high[over]))
                query, low, high = query[~over], low[~over], high[~over]
            if not len(query):
                break
            word = self.tokens[self.start[query] + d]
            bounds = []
            for right in (False, True):
                a, b = low.copy(), high.copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    seen = tokens[array[np.minimum(mid, len(array) - 1)] + d]
                    up = open_ & ((seen <= word) if right else (seen < word))
                    a = np.where(up, mid + 1, a)
                    b = np.where(open_ & ~up, mid, b)
                bounds.append(a)
            some = bounds[0] < bounds[1]
            query, low, high = query[some], bounds[0][some], bounds[1][some]
        if not done:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))  # type: ignore[return-value]


def scan_shard(test: TestSuffixes, texts: list[str | None]) -> list[tuple[int, list[int], list[int], list[int], int, int, int]]:
    """Of each text: its words, starts and ends of the covered word runs, item numbers, and the longest match: words, item, word position."""
    get, parts, sizes = test.vocabulary.get, [], []
    for text in texts:
        own = words(text)
        sizes.append(len(own))
        parts.append(np.fromiter(map(get, own, repeat(0)), np.int64, len(own)))
        parts.append(np.zeros(1, np.int64))
    tokens = np.concatenate([np.zeros(1, np.int64), *parts, np.zeros(test.deepest + 1, np.int64)])
    begins = 1 + np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)[:-1]])
    blank: list = [(n, [], [], [], 0, -1, -1) for n in sizes]
    if not len(test.start):
        return blank
    array = test.suffix_array(tokens, test.places(tokens))
    if not len(array):
        return blank
    query, low, high = test.search(tokens, array)
    count = high - low
    if not count.sum():
        return blank
    which = np.repeat(np.arange(len(query)), count)
    at = array[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    query = query[which]
    need, doc = test.need[query], np.searchsorted(begins, at, "right") - 1
    cover = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + need, -1)
    covered = (np.cumsum(cover) > 0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], covered, [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # longest verbatim matches: hits that the word before doesn't extend, carried on to the right
    first = ~((tokens[at - 1] != 0) & (tokens[at - 1] == test.tokens[test.start[query] - 1]))
    a, q, d = at[first], query[first], doc[first]
    length = test.need[q].copy()
    live = np.flatnonzero(length < test.left[q])
    while len(live):
        n = length[live]
        same = (tokens[a[live] + n] == test.tokens[test.start[q[live]] + n]) & (tokens[a[live] + n] != 0)
        live = live[same]
        length[live] += 1
        live = live[length[live] < test.left[q[live]]]
    best: dict[int, tuple[int, int, int]] = {}
    for i in np.lexsort((test.item[q], a, -length, d)):
        best.setdefault(int(d[i]), (int(length[i]), int(test.item[q[i]]), int(a[i] - begins[d[i]])))
    pairs = np.unique(doc * len(test.ids) + test.item[query])
    owner, run_owner = pairs // len(test.ids), np.searchsorted(begins, starts, "right") - 1
    for i in map(int, np.unique(doc)):
        x, y = np.searchsorted(run_owner, [i, i + 1])
        p, r = np.searchsorted(owner, [i, i + 1])
        blank[i] = (sizes[i], (starts[x:y] - begins[i]).tolist(), (ends[x:y] - begins[i]).tolist(), (pairs[p:r] % len(test.ids)).tolist(), *best.get(i, (0, -1, -1)))
    return blank


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The test items in blocks of bounded bytes, read one partition at a time."""
    block, size = [], 0
    for name, body in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).orderBy(F.col(item_id), F.col(text)).toLocalIterator():
        if block and size + len(body or "") > block_bytes:
            yield block
            block, size = [], 0
        block.append((name, body))
        size += len(body or "")
    yield block


def annotate(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column: n_words, hit_starts, hit_ends (word runs inside any occurrence of a test window), items, and the longest match.

    A null or wordless text has no words and no hits. Repeated rows each get their result. Items without words
    occur nowhere; a null item_id counts as the empty string; items with one id count once. An empty benchmark
    hits nothing. The other columns of docs pass through, whatever their names.
    """
    out, before = docs, None
    for i, items in enumerate(item_blocks(benchmark, item_id, item_text, block_bytes)):
        made = free_name(out, f"{name}_{i}")
        out = add_struct(out, text, made, RESULT, _scanner(TestSuffixes(items, window)))
        if before:
            merged = _merged(F.col(before), F.col(made))
            out = out.withColumn(made, merged).drop(before)
        before = made
    return out.withColumnRenamed(before, name)


def _scanner(test: TestSuffixes) -> Callable:
    def make() -> Callable[[list], dict]:
        def score(texts: list[str | None]) -> dict:
            found = scan_shard(test, texts)
            cols = list(zip(*found, strict=True)) if found else [[]] * 7
            named = [sorted({test.ids[i] for i in own}) for own in cols[3]]
            return {"n_words": cols[0], "hit_starts": cols[1], "hit_ends": cols[2], "items": named, "longest_words": cols[4], "longest_item": [test.ids[i] if i >= 0 else None for i in cols[5]], "longest_at": cols[6]}

        return score

    return make


def _merged(a: F.Column, b: F.Column) -> F.Column:
    """The results of two blocks of items as one; runs may then overlap."""
    longer = b["longest_words"] > a["longest_words"]
    pick = lambda k: F.when(longer, b[k]).otherwise(a[k]).alias(k)
    return F.struct(a["n_words"].alias("n_words"), F.concat(a["hit_starts"], b["hit_starts"]).alias("hit_starts"), F.concat(a["hit_ends"], b["hit_ends"]).alias("hit_ends"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"), pick("longest_words"), pick("longest_item"), pick("longest_at"))


def n_hit(result: F.Column) -> F.Column:
    """Words covered by the runs of a result, also where runs of several blocks overlap."""
    runs = F.array_sort(F.arrays_zip(result["hit_starts"].alias("s"), result["hit_ends"].alias("e")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), r["e"] - F.greatest(r["s"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], r["e"]).alias("upto"))
    return F.aggregate(runs, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those in which a window of a test item occurs; the columns stay."""
    name = free_name(docs, "decontamination")
    return annotate(docs, benchmark, name, text, **options).filter(F.size(F.col(name)["hit_starts"]) == 0).drop(name)
