"""Web archives (WARC 1.1): pages written as records, and archives read back with their segments put together.

Writing: a page's payload goes into an HTTP response with chunked framing; a block longer than a segment is cut into a
first record and continuation records. Pages with a payload that a page of lesser id has already are revisit records,
which name the digest of their payload and hold none. Spark's text writer puts the records into files of the shared
folder, one for each task, with the blank lines that end a record as its line separator.

Reading: the version line that begins each record is the line separator of Spark's text reader, so files of any size are
read in splits (compressed ones whole). Own archives never hold that line inside a block, since a chunk ends within it;
records of other archives whose length isn't the declared one are marked, not guessed at. Continuation records are
grouped by the identifier of their first record, ordered by segment number, held against the declared total length, and
freed of the chunked framing. Records in one piece aren't shuffled at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .common import Staged, slices

VERSION = "WARC/1.1"
#: Bytes of a record's block; longer ones go on in continuation records.
SEGMENT_BYTES = 16_384
#: Bytes of a chunk of the transfer framing.
CHUNK_BYTES = 4_096
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
#: Repeated digests up to which they are broadcast (under 100 bytes each).
MOST_BROADCAST = 100_000
#: A digest with this share of all rows, or a larger one, is hot: there are at most as many.
HOT_SHARE = 1_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = f"{VERSION}\r\n".encode()
_RECORD = StructType([StructField("record", BinaryType())])
PARSED = StructType([
    StructField("kind", StringType()), StructField("record_id", StringType()), StructField("origin", StringType()), StructField("segment", LongType()), StructField("total", LongType()),
    StructField("page_id", LongType()), StructField("uri", StringType()), StructField("digest", StringType()), StructField("block", BinaryType()), StructField("payload", BinaryType()), StructField("whole", BooleanType()),
])


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing. No chunk holds the line that begins a record, nor do two that adjoin, the framing between them being part of neither."""
    out, at = [], 0
    while at < len(payload):
        end = min(at + size, len(payload))
        if (found := payload.find(_LINE, at, end)) >= 0:
            end = found + len(_LINE) // 2
        out += (b"%x\r\n" % (end - at), payload[at:end], b"\r\n")
        at = end
    return b"".join((*out, b"0\r\n\r\n"))


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds; extensions and trailers are passed over. None if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip()
        if end < 0 or not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        if not (size := int(digits, 16)):
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def fields(head: bytes) -> dict[str, str]:
    """Named fields by their names in lower case; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def http_payload(block: bytes | None) -> bytes | None:
    """The body of an HTTP response without its transfer framing. None if there is no whole response."""
    if block is None or (end := block.find(b"\r\n\r\n")) < 0:
        return None
    body = block[end + 4 :]
    return unchunked(body) if "chunked" in fields(block[:end]).get("transfer-encoding", "").lower() else body


def _head(pairs: list[tuple[str, object]]) -> bytes:
    return _LINE + "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode() + b"\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, date: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of a page, without the blank lines that end them."""
    own = f"<{uuid.uuid4().urn}>"
    common = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", quote(url or "about:blank", safe="!#$&'()*+,/:;=?@[]~%")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if kind == "revisit":
        yield _head([*common, ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(head))]) + head
        return
    block = head + chunked(payload, chunk_bytes)
    n = -(-len(block) // segment_bytes)
    for i in range(n):
        part = block[i * segment_bytes : (i + 1) * segment_bytes]
        if i:
            pairs: list[tuple[str, object]] = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i + 1), ("WARC-Segment-Total-Length", len(block) if i == n - 1 else None)]
        else:
            pairs = [*common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", 1 if n > 1 else None)]
        yield _head([*pairs, ("Content-Length", len(part))]) + part


def _with_hot(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left, with what right (one row a key, with a count n) says of its key, if anything. Few keys, or else the hot ones, are broadcast; the others meet in a join."""
    if right.count() <= MOST_BROADCAST:
        return left.join(F.broadcast(right), key, "left")
    hot = F.broadcast(right.filter(F.col("n") * HOT_SHARE >= rows))  # at most HOT_SHARE of them
    out = left.join(hot.select(key, F.lit(True).alias("is_hot")), key, "left")
    there = out.filter("is_hot").drop("is_hot").join(hot, key, "left")
    return there.unionByName(out.filter("is_hot is null").drop("is_hot").join(right.filter(F.col("n") * HOT_SHARE < rows), key, "left"))


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def write_pages(pages: DataFrame, path: str, staged: Staged, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, compression: str = "none") -> None:
    """Writes a record for each row into files under path, which must not exist yet.

    A null html is the empty payload, a null url about:blank. Of equal payloads of at least LEAST_REVISIT bytes those of
    the least id are responses (all of them, where rows of that id repeat; rows without an id count last) and all others
    revisits. An empty table gives files without records. Other columns are left out, whatever their names.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), _payload(html).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = own.filter(F.length("payload") >= LEAST_REVISIT).select("digest", "page_id")
    counted = long.groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = staged.keep(counted.filter("n > 1"))
    rows = repeated.agg(F.sum("n")).first()[0] or 0
    marked = _with_hot(own, repeated, "digest", rows)
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    todo = marked.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "digest", F.when(again, "revisit").otherwise("response").alias("kind"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2):
            made = [r for row in zip(*(c.to_pylist() for c in piece.columns), strict=True) for r in records(row[0], row[1], row[2] or b"", row[3], row[4], date, segment_bytes, chunk_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    todo.mapInArrow(make, _RECORD).select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
    staged.drop(repeated)


def read_records(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """One row for each record of the archives under path: kind, record_id, origin (the first record's identifier, for continuations), segment, total, page_id, uri, digest (as named), block (of records in several segments, and of kinds other than responses), payload (of responses in one piece) and whole (the length is the declared one and the framing intact)."""
    arrow = to_arrow_schema(PARSED)

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdecimal() else None

    def parse(record: bytes) -> tuple:
        head, _, block = record.partition(b"\r\n\r\n")
        f = fields(head)
        n = number(f.get("content-length"))
        whole = n is not None and len(block) >= n and not block[n:].strip(b"\r\n")
        block = block[: n or 0]
        kind, segment = f.get("warc-type"), number(f.get("warc-segment-number"))
        single = kind == "response" and segment is None
        payload = http_payload(block) if single and whole else None
        digest = f.get("warc-payload-digest", "")
        return kind, f.get("warc-record-id"), f.get("warc-segment-origin-id"), segment, number(f.get("warc-segment-total-length")), number(f.get("x-page-id")), f.get("warc-target-uri"), digest.removeprefix("sha256:") or None, None if single else block, payload, whole and not (single and payload is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 0):
            if rows := [parse(x) for x in piece.column(0).to_pylist() if x.strip(b"\r\n")]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    lines = spark.read.schema("value string").option("lineSep", f"{version}\r\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, PARSED)


def reassembled(found: DataFrame) -> DataFrame:
    """Responses that were cut into segments, as rows like the others of read_records, with their payload: the segments of an origin in order. A missing or doubled segment, a wrong total length or broken framing leaves the payload null and whole false."""
    parts = found.filter("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block", "whole"))).alias("parts"), F.max("total").alias("total"), *(first(c) for c in ("kind", "page_id", "uri", "digest")))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.length(p["block"]))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.transform("parts", lambda p, i: (i + 1).cast("long"))
    checked = grouped.withColumn("good", F.coalesce(in_order & (length == F.col("total")) & F.forall("parts", lambda p: p["whole"]), F.lit(False)))
    at = PARSED.names
    arrow = to_arrow_schema(PARSED)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                payload = http_payload(b"".join(row.pop("parts"))) if row.pop("good") else None
                row |= {"record_id": row["origin"], "segment": None, "block": None, "payload": payload, "whole": payload is not None}
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], f.type) for n, f in zip(at, arrow, strict=True)], schema=arrow)

    blocks = F.transform("parts", lambda p: p["block"]).alias("parts")
    return checked.select("origin", "total", "kind", "page_id", "uri", "digest", blocks, "good").mapInArrow(join, PARSED)


def read_pages(spark: SparkSession, path: str, staged: Staged) -> DataFrame:
    """One row for each response or revisit of the archives under path: page_id, uri, record_type, payload_bytes and payload_digest (both of the full payload), refers_to (for revisits, the page of the response with their digest; the least id of several) and whole.

    Payloads that can't be read whole have null bytes and digest; revisits of payloads that the archives don't hold keep
    the named digest, without bytes. An archive without records gives no rows.
    """
    measured = [F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")]
    narrow = ["kind", "page_id", "uri", "digest", "whole"]
    found = staged.keep(read_records(spark, path).select(*narrow, "record_id", "origin", "segment", "total", "block", *measured))
    single = found.filter("segment is null and kind = 'response'").select(*narrow, "payload_bytes", "payload_digest")
    responses = single.unionByName(reassembled(found).select(*narrow, *measured))
    responses = staged.keep(responses.withColumn("whole", F.col("whole") & F.coalesce(F.col("digest") == F.col("payload_digest"), F.lit(True))))
    revisits = found.filter("kind = 'revisit'").select("page_id", "uri", "digest", "whole")
    # a revisit asks for few columns of one response; only digests that revisits name go on
    counted = revisits.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    held = responses.filter("payload_digest is not null").groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    referred = staged.keep(held.join(counted, "digest"))
    resolved = _with_hot(revisits, referred, "digest", revisits.count())
    out = ["page_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "whole"]
    first = responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).select(out)
    return first.unionByName(resolved.withColumn("record_type", F.lit("revisit")).withColumnRenamed("digest", "payload_digest").select(out))
