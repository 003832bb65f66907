"""Harmonic packing of documents into fixed-capacity token sequences.

A document is cut into full sequences, then into pieces of 1/2, 1/4, ... 1/64 of the capacity, and a rest shorter
than that; piece length L belongs to the reciprocal class k = capacity // L, whose bins hold k pieces. All pieces of
a class are equally long, so a piece's bin and offset follow from its rank in the class alone. Workers number their
own pieces; one small table of counts per worker and class turns these numbers into ranks. The bins that stay
incomplete, less than one per class, are strung together on the driver (one row per class, 70 at most).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import Staged, slices

CAPACITY = 4096
#: The shortest unit fraction that a document is cut into, as a power of two; shorter rests stay whole.
LEAST_CUT = 64
#: Id that ends every document.
END_ID = 2
#: The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(40)]
_END = END_ID.to_bytes(4, "little")
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 250_000

#: Text that has these characters only once it is in lower case is split into words here; any other text goes through the tokenizer whole.
_PLAIN = re.compile(r"[^\t\n\r -~¡-ɏ]")
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼½¾]|[^\s\xa0{_LETTERS}0-9²³¹¼½¾]+")


class WordIds(dict):
    """Token ids of a text, as little-endian 32-bit bytes: words are encoded by the tokenizer once and remembered.

    The vocabulary's words never cross the borders that its own pre-tokenizer draws, so the ids of a text are those of its words.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        self[word] = packed = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        return packed

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        small = text.lower()
        if _PLAIN.search(small) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _WORD.findall(small)))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for a worker process, so that its later tasks know the words already."""
    return WordIds(path)


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST_CUT) -> list[int]:
    """Lengths of the pieces of n tokens, in order: full sequences, unit fractions, the rest."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while size >= least:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return [*out, n] if n else out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, worker, number (in its worker and class), and ids if asked for."""
    fields = [StructField(id_col, LongType())] + [StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "worker", "number")]
    schema = StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * keep_ids)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, worker, seen = word_ids(tokenizer), TaskContext.get().partitionId(), {}
        for piece in slices(batches, 1):
            rows = []
            for doc, body in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                ids = words.ids(body) + _END
                at = 0
                for n in cuts(len(ids) // 4, capacity):
                    own = ids[4 * at : 4 * (at + n)]
                    seen[n] = (k := seen.get(n, -1) + 1)
                    rows.append((doc, at, n, zlib.crc32(own), len(ids) // 4, worker, k) + ((np.frombuffer(own, "<u4").tolist(),) if keep_ids else ()))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text).mapInArrow(run, schema)


def _tail(counts: dict[int, int], capacity: int) -> list[tuple]:
    """Where each class's bins begin, and where the pieces that fill no bin go: by class, up to two runs in the shared last bins."""
    rows, sequence = [], 0
    for length in sorted(counts, reverse=True):
        k = capacity // length
        rows.append([length, k, sequence, counts[length] // k * k])
        sequence += counts[length] // k
    at = 0
    for row in rows:
        length, left = row[0], counts[row[0]] - row[3]
        first = min(left, (capacity - at) // length)
        row += [row[3] + first, sequence, at]
        at += first * length
        if left > first:
            sequence, at = sequence + 1, (left - first) * length
        row += [sequence]
    return [tuple(r) for r in rows]


def pack(docs: DataFrame, tokenizer: str, staged: Staged, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Packs whole documents: one row per piece with its sequence_id and offset (gapless from 0 in every sequence).

    Null and empty texts are documents of the one id 2. Repeated rows are packed each; a null doc_id stays null. An
    empty table gives no rows. Columns other than the id and the text are left out.
    """
    spark = docs.sparkSession
    made = staged.keep(pieces(docs, tokenizer, id_col, text, capacity, keep_ids))
    counts = made.groupBy("worker", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("worker")) - F.col("n")).drop("n")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each class: 70 at most
    names = "length long, per_bin long, first_bin long, in_bins long, in_first long, seq_a long, off_a long, seq_b long"
    classes = F.broadcast(spark.createDataFrame(_tail(totals, capacity), names))
    ranked = made.join(before, ["worker", "length"]).join(classes, "length").withColumn("rank", F.col("number") + F.col("before"))
    full, early = F.col("rank") < F.col("in_bins"), F.col("rank") < F.col("in_first")
    div = F.expr("first_bin + rank div per_bin")
    sequence = F.when(full, div).when(early, F.col("seq_a")).otherwise(F.col("seq_b"))
    offset = F.when(full, F.col("rank") % F.col("per_bin") * F.col("length")).when(early, F.col("off_a") + (F.col("rank") - F.col("in_bins")) * F.col("length")).otherwise((F.col("rank") - F.col("in_first")) * F.col("length"))
    return ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"), *(["ids"] * keep_ids))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Token rows of packed pieces that keep their ids: padded to the capacity, except at a power of two; with the piece lengths for block-diagonal attention."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    whole = F.expr("bit_count(n_tokens) = 1")
    return rows.select("sequence_id", n.alias("n_tokens"), F.transform("p", lambda x: x["length"]).alias("lengths"), ids.alias("raw")).select("sequence_id", "n_tokens", "lengths", F.when(whole, F.col("raw")).otherwise(F.concat("raw", F.array_repeat(F.lit(pad_id), (F.lit(capacity) - F.col("n_tokens")).cast("int")))).alias("ids"))
