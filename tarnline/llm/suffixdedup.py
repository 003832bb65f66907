"""Removal of byte strings that start in an earlier document, by suffix arrays over shards.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id. To find all places
of a string in one shard, every window of LENGTH bytes names its anchor: the first of its grams of GRAM bytes with the
least hash. Equal windows have equal anchors, so documents that share a window share an anchor, and the surroundings of
equal grams (all windows of the anchor) meet in one shard, with the first document of each. The shard builds a
suffix array over them by induced sorting (suffixes are classified, leftmost-smaller substrings sorted and named, the
reduced string sorted, and all suffixes induced from its order in linear time, bucket by bucket in numpy), computes the
permuted common prefixes of the windows, and so the least document of every window, from which the runs to remove follow.

Two kinds of places never reach a shard. Anchors of one document alone, the most by far, end before any text is moved. And
surroundings that are equal as a whole, under one gram, are one class: only the class's first document goes to a shard. All
windows of its later documents start in that first one, so these go entirely; that is decided by the class, not by a
suffix array, and the class by two hashes of 64 bits, of the gram and of all surroundings, without a look at the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, release, slices

LENGTH, GRAM = 50, 20
#: Bytes of shard text that one suffix array covers at least, unless the task has less; a gram's texts stay together.
SHARD_BYTES = 1_000_000
#: Places of one gram beyond which its texts are split by the bytes next to it.
HOT = 50_000
#: Different texts that rows of one id may have; their number is part of a packed place.
MOST_VERSIONS = 1 << 20
_P = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P[2]
    return h ^ (h >> np.uint64(29))


def _powers(b: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Hashes of all substrings of 1, 2, 4, ... bytes, as long as they are no longer than n."""
    out, size, h = [], 1, (b.astype(np.uint64) + np.uint64(1)) * _P[1]
    while True:
        out.append((size, h))
        if 2 * size > n or len(h) <= size:
            return out
        h = _mix(h[:-size] * _P[0] + h[size:])
        size *= 2


def substring_hashes(b: np.ndarray, n: int, known: list | None = None) -> np.ndarray:
    """Hash of the n bytes from every position."""
    total, at = np.zeros(max(0, len(b) - n + 1), np.uint64), 0
    for size, h in reversed(known or _powers(b, n)):
        while n - at >= size and len(total):
            total = _mix(total * _P[0] + h[at : at + len(total)])
            at += size
    return total


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over every n values in a row."""
    size = 1
    while 2 * size <= n:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _least_places(h: np.ndarray, n: int) -> np.ndarray:
    """Where the least of every n values in a row is, the leftmost of equal ones."""
    place, size = np.arange(len(h)), 1
    while size < n:
        step = min(size, n - size)
        right = h[step:] < h[: len(h) - step]
        h = np.where(right, h[step:], h[: len(h) - step])
        place = np.where(right, place[step:], place[: len(place) - step])
        size += step
    return place


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor its position, its hash, and the first and last window it is the anchor of: the leftmost of the window's grams with the least hash. Also the hashes of 16 bytes from every position."""
    if len(b) < LENGTH:
        return *(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2))
    known = _powers(b, GRAM)
    h = substring_hashes(b, GRAM, known)
    span = LENGTH - GRAM + 1
    least, pad = _slide(h, span, np.minimum), np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), span, np.maximum) == h)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    if len(at) != len(first):  # a window has its least gram more than once
        place = _least_places(h, span)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        at = place[first]
    return at, first, np.append(first[1:], len(least)) - 1, h[at], known[4][1]


def _packed(version: int, start: np.ndarray, lead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for 20 bits of version, where the surroundings start, the bytes before the anchor, and all their bytes."""
    return version << 43 | start << 12 | lead << 7 | size


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, bytes before the anchor, and size."""
    return place >> 12 & 0x7FFFFFFF, place >> 7 & 31, place & 127


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Of every anchor: doc, place (where its surroundings are, packed), gram and around (hashes)."""

    kinds = ("doc", "place", "gram", "around")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            cols: list[list[np.ndarray]] = [[] for _ in kinds]
            for doc, version, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
                at, start, last, gram, prefix = anchors(b)
                if not len(at):
                    continue
                stop = last + LENGTH
                around = _mix(np.uint64(1) * (stop - start).astype(np.uint64) * _P[1] + (at - start).astype(np.uint64))
                for k in range(0, LENGTH + LENGTH - GRAM, 16):  # 16-byte hashes cover the surroundings; the last ones end with them
                    around = _mix(around * _P[0] + prefix[np.minimum(start + k, stop - 16)])
                for c, x in zip(cols, (np.full(len(at), doc), _packed(version, start, at - start, stop - start), gram.view(np.int64), around.view(np.int64)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=list(kinds))

    return docs.mapInArrow(run, "doc long, place long, gram long, around long")


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last character must be the least, once."""
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    n = len(step)
    following = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    return np.append(np.append(step, -1)[following] > 0, True)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All suffixes from leftmost-smaller ones in order: larger suffixes bucket by bucket upwards, then smaller ones downwards."""
    n, heads = len(s), np.concatenate([[0], ends[:-1]])
    s = s.astype(np.uint16)  # sorted by radix
    array = np.full(n, -1, np.int64)

    def put(items: np.ndarray, fill: np.ndarray, step: int) -> None:
        c = s[items]
        order = np.argsort(c, kind="stable")
        c, items = c[order], items[order]
        new = np.empty(len(c) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(c[1:], c[:-1], out=new[1:-1])
        first = np.flatnonzero(new)
        size, first = first[1:] - first[:-1], first[:-1]
        own = c[first]
        if step > 0:
            array[np.repeat(fill[own] - first, size) + np.arange(len(c))] = items
        else:
            array[np.repeat(fill[own] + first, size) - np.arange(len(c))] = items
        fill[own] += step * size

    fill = ends - 1
    put(lms[::-1], fill, -1)
    tails = fill + 1  # where the leftmost-smaller suffixes of each bucket begin
    fill = heads.copy()
    for c in range(len(ends)):
        done = heads[c]
        while done < fill[c]:
            cur = array[done : fill[c]]
            done = fill[c]
            before = cur[cur > 0] - 1
            if len(before := before[~small[before]]):
                put(before, fill, 1)
        cur = array[tails[c] : ends[c]]
        before = cur[cur > 0] - 1
        if len(before := before[~small[before]]):
            put(before, fill, 1)
    larger = fill
    fill = ends - 1
    for c in range(len(ends) - 1, -1, -1):
        done = ends[c] - 1
        while done > fill[c]:
            cur = array[fill[c] + 1 : done + 1][::-1]
            done = fill[c]
            before = cur[cur > 0] - 1
            if len(before := before[small[before]]):
                put(before, fill, -1)
        cur = array[heads[c] : larger[c]][::-1]
        before = cur[cur > 0] - 1
        if len(before := before[small[before]]):
            put(before, fill, -1)
    array[0] = n - 1
    return array


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers, the last of which is the only 0. Alphabets too large for buckets in numpy are sorted by doubling; only reduced strings have them."""
    n, size = len(s), int(s.max()) + 1
    if n < 3:
        return np.arange(n)[::-1].copy()
    if size > 3000:
        return _by_doubling(s)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ends = np.cumsum(np.bincount(s, minlength=size))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = _induce(s, small, lms, ends)
    order = order[is_lms[order]]
    # names of the sorted substrings from one leftmost-smaller suffix to the next
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (length[a[live]] > k)]
    names = np.cumsum(np.append(0, ~same))
    if names[-1] + 1 < len(lms):
        named = np.zeros(n, np.int64)
        named[order] = names
        order = lms[suffix_array(named[lms])]
    return _induce(s, small, order, ends)


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """By prefix doubling: first as many characters as a whole number holds, then only among suffixes that are still tied."""
    n, bits = len(s), int(s.max()).bit_length()
    k = max(1, 62 // bits)
    padded = np.append(s, np.zeros(k, np.int64))
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key)
    places, key = np.arange(n), key[order]
    rank = np.empty(n, np.int64)
    items = order
    while True:
        new = np.append(True, key[1:] != key[:-1])
        rank[items] = np.maximum.accumulate(np.where(new, places, 0))
        tied = ~(new & np.append(new[1:], True))
        if not tied.any():
            return order
        places, items = places[tied], items[tied]
        after = np.where(items + k < n, rank[np.minimum(items + k, n - 1)] + 1, 0)
        key = rank[items] * (n + 1) + after
        sub = np.argsort(key)
        key, items = key[sub], items[sub]
        order[places] = items
        k *= 2


def common_prefixes(body: np.ndarray, array: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """In text order (permuted), the common prefix of each valid position with the valid one before it in the suffix array, LENGTH at most; eight bytes at a time."""
    w = np.concatenate([body, np.zeros(LENGTH + 14, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | w[k:] << np.uint64(8 * k)
    own = array[valid[array]]
    before = np.full(len(body), -1, np.int64)
    before[own[1:]] = own[:-1]
    out = np.zeros(len(body), np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(0, LENGTH, 8):
        differ = w[live + k] ^ w[before[live] + k]
        some = differ != 0
        low = differ[some]
        out[live[some]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        live = live[~some]
    out[live] = LENGTH
    return np.minimum(out, LENGTH)


def least_documents(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least document of each window of every text, over all texts of the shard, one text after the other; and how many windows each has."""
    sizes = np.array([len(t) for t in texts], np.int64)
    s = np.zeros(sizes.sum() + len(texts) + 1, np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    inside = np.ones(len(s), bool)
    inside[begins + sizes] = False
    inside[-1] = False
    body = np.zeros(len(s), np.uint8)
    body[inside] = np.frombuffer(b"".join(texts), np.uint8)
    s[inside] = body[inside].astype(np.int64) + 2
    s[begins + sizes] = 1
    array = suffix_array(s)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    valid = np.zeros(len(s), bool)
    valid[at] = True
    prefix = common_prefixes(body, array, valid)
    own = array[valid[array]]
    doc_at = np.zeros(len(s), np.int64)
    doc_at[at] = np.repeat(docs, windows)
    first = np.flatnonzero(prefix[own] < LENGTH)
    least = np.minimum.reduceat(doc_at[own], first) if len(own) else np.zeros(0, np.int64)
    found = np.zeros(len(s), np.int64)
    found[own] = np.repeat(least, np.diff(np.append(first, len(own))))
    return found[at], windows


def _runs(removed: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and packed byte runs that removed windows cover. The windows of all rows follow each other; those of a row begin at begins, and its text at starts."""
    opens, closes = removed.copy(), removed.copy()
    opens[1:] &= ~removed[:-1]
    opens[begins] = removed[begins]
    closes[:-1] &= ~removed[1:]
    last = np.append(begins[1:], len(removed)) - 1
    closes[last] = removed[last]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    row = np.searchsorted(begins, a, "right") - 1
    shift = starts[row] - begins[row]
    return row, (a + shift) << 31 | (b + shift + LENGTH)


def _solved(doc: np.ndarray, version: np.ndarray, start: np.ndarray, bodies: list[bytes]) -> pa.RecordBatch:
    """The runs to remove that the suffix array of a shard finds in its texts: doc, version, run. Equal texts are one text with their least document."""
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(b, len(known)) for b in bodies), np.int64, len(bodies))
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    found, windows = least_documents(list(known), least)
    begins = np.concatenate([[0], np.cumsum(windows)[:-1]])
    n = windows[which]
    row_begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    flat = np.repeat(begins[which] - row_begins, n) + np.arange(n.sum())
    row, run = _runs(found[flat] < np.repeat(doc, n), row_begins, start)
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(version[row]), pa.array(run)], names=["doc", "version", "run"])


def shared_anchors(docs: DataFrame, staged: Staged) -> DataFrame:
    """Anchors that more than one document has: doc, place, gram, first (whether no earlier document has these surroundings) and hot. docs: doc, version, text."""
    by_text, by_gram = Window.partitionBy("gram", "around"), Window.partitionBy("gram")
    met = anchor_rows(docs).withColumn("text_doc", F.min("doc").over(by_text)).select("*", F.min("doc").over(by_gram).alias("low"), F.max("doc").over(by_gram).alias("high"), F.count(F.lit(1)).over(by_gram).alias("met"))
    return staged.keep(met.filter("low < high").select("doc", "place", "gram", (F.col("doc") == F.col("text_doc")).alias("first"), (F.col("met") > HOT).alias("hot")))


def repeated_runs(docs: DataFrame, staged: Staged) -> DataFrame:
    """doc, version, runs (packed starts and stops): bytes that earlier documents repeat. docs: doc, version (tells texts of one id apart), text."""
    # the first document of every class of equal surroundings goes to a shard; its later ones go as a whole
    met = shared_anchors(docs, staged)
    version = F.expr("shiftright(place, 43)").alias("version")
    start, size = F.expr("shiftright(place, 12) & 2147483647"), F.expr("place & 127")
    later = met.filter("not first").select("doc", version, (F.shiftleft(start, 31) + start + size).alias("run"))
    wanted = met.filter("first").select("doc", version, "place", "gram", "hot").groupBy("doc", "version").agg(F.collect_list(F.struct("gram", "place", "hot")).alias("a"))
    arounds = wanted.join(docs, ["doc", "version"]).select("doc", "version", "a", "text")
    names, half = ["key", "doc", "version", "start", "body"], (LENGTH - GRAM) // 2

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 3):
            listed = piece.column(2)
            n = pa.compute.list_value_length(listed).to_numpy(zero_copy_only=False)
            gram, place, hot = (listed.flatten().field(k) for k in range(3))
            gram, place, hot = gram.to_numpy(), place.to_numpy(), hot.to_numpy(zero_copy_only=False)
            start, lead, size = _unpacked(place)
            doc, version = (np.repeat(piece.column(k).to_numpy(), n) for k in (0, 1))
            at, bodies = 0, []
            for text, k in zip(piece.column(3).to_pylist(), n.tolist(), strict=True):
                b = text.encode("utf-8", "replace")
                bodies += [b[i:j] for i, j in zip(start[at : at + k].tolist(), (start + size)[at : at + k].tolist(), strict=True)]
                at += k
            # a gram of very many places is split by the bytes next to it: texts go where those on their left are the same, and where those on their right are
            key, again, other = gram.copy(), [], []
            for i in np.flatnonzero(hot).tolist():
                body, k = bodies[i], int(lead[i])
                sides = [xxhash.xxh64_intdigest(x, seed) for seed, x in ((1, body[k - half : k] if k >= half else b""), (2, body[k + GRAM : k + GRAM + half])) if len(x) == half]
                keys = [np.int64((int(gram[i]) ^ h) & (2**63 - 1)) for h in sides]
                key[i] = keys[0] if keys else i  # no window holds this text's gram with half its other bytes on one side
                if len(keys) > 1:
                    again.append(i)
                    other.append(keys[1])
            if again:
                key, doc, version, start = np.append(key, other), *(np.append(x, x[again]) for x in (doc, version, start))
                bodies += [bodies[i] for i in again]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, doc, version, start)), pa.array(bodies, pa.binary())], names=names)

    texts = arounds.mapInArrow(cut_out, "key long, doc long, version long, start long, body binary").repartition(F.col("key")).sortWithinPartitions("key")

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = pa.Table.from_batches(parts).combine_chunks()
            return _solved(*(own.column(k).to_numpy() for k in (1, 2, 3)), own.column(4).to_pylist())

        held, size, last = [], 0, None
        for batch in batches:
            key, place = batch.column(0).to_numpy(), 0
            while place < len(key):
                # a shard ends where a key ends, when it is large enough
                if size > SHARD_BYTES and key[place] != last:
                    yield solved(held)
                    held, size = [], 0
                if size > SHARD_BYTES:
                    end = place + int(np.searchsorted(key[place:], last, "right"))
                else:
                    room = np.cumsum(pa.compute.binary_length(batch.column(4).slice(place)).to_numpy())
                    end = min(len(key), place + int(np.searchsorted(room, SHARD_BYTES - size, "right")) + 1)
                piece = batch.slice(place, end - place)
                held.append(piece)
                size += piece.column(4).nbytes
                last, place = key[end - 1], end
        if held:
            yield solved(held)
        release()

    found = staged.keep(texts.mapInArrow(sort_shard, "doc long, version long, run long"))
    return later.unionByName(found).groupBy("doc", "version").agg(F.collect_list("run").alias("runs"))


def _versions(known: DataFrame) -> DataFrame:
    """doc, version, text: the texts of one id are told apart by version; an id with more texts than a place has numbers for raises."""
    marked = known.withColumn("_h", F.xxhash64("text"))
    several = marked.groupBy("doc").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).filter("lo < hi").select("doc")
    if several.isEmpty():
        return known.select("doc", F.lit(0).cast("long").alias("version"), "text")
    order = Window.partitionBy("doc").orderBy("_h")
    ranks = marked.join(several, "doc", "left_semi").select("doc", "_h").distinct().withColumn("version", (F.row_number().over(order) - 1).cast("long"))
    number = F.when(F.col("version") >= MOST_VERSIONS, F.raise_error(F.lit("an id has too many different texts")).cast("long")).otherwise(F.coalesce("version", F.lit(0)).cast("long"))
    return marked.join(ranks, ["doc", "_h"], "left").select("doc", number.alias("version"), "text")


def remove_repeats(docs: DataFrame, staged: Staged, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes) of every document.

    Null texts are empty. Rows with one id are one document as to each other: they take nothing from one another. Rows
    with a null id take nothing and lose nothing. An empty table gives no rows. Other columns are left out.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = _versions(plain.filter("doc is not null"))
    runs = repeated_runs(known, staged)
    nameless = plain.filter("doc is null").select("doc", "text", F.lit(None).cast("array<bigint>").alias("runs"))
    joined = known.join(runs, ["doc", "version"], "left").select("doc", "text", "runs").unionByName(nameless)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            listed = piece.column(2)
            n = pa.compute.fill_null(pa.compute.list_value_length(listed), 0).to_pylist()
            all_, at, rows = listed.flatten().to_numpy(), 0, []
            for text, k in zip(piece.column(1).to_pylist(), n, strict=True):
                b = text.encode("utf-8", "replace")
                if not k:
                    rows.append((len(b), 0, 0, b))
                    continue
                own = np.sort(all_[at : at + k])
                at += k
                start, upto = own >> 31, np.maximum.accumulate(own & 0x7FFFFFFF)
                opens = np.append(True, start[1:] > upto[:-1])
                begin, end = start[opens].tolist(), upto[np.append(np.flatnonzero(opens)[1:] - 1, k - 1)].tolist()
                kept = b"".join(b[i:j] for i, j in zip([0, *end], [*begin, len(b)], strict=True))
                rows.append((len(b), len(b) - len(kept), len(begin), kept))
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])
        release()

    return joined.mapInArrow(cut, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary")
