"""Chat formatting of typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into one text with ordered placeholders
and records each attachment with its reference and the number of tokens its placeholder stands for. Every turn
becomes one formatted chunk, so that a conversation of any length is written and read back as a stream of rows:
no task ever holds a whole conversation.

Template: <|role|>ROLE<|text|>TEXT<|end|>. Control strings inside roles and texts get one backslash after their
first character (and one more if they have some already); reading back takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string: own marks, and the marks of common other templates.
_CONTROL = re.compile(r"(<|\[)(\\*)(?=\||/?s>|</?SYS>>|/?INST\]|/?SYSTEM_PROMPT\]|/?AVAILABLE_TOOLS\]|/?TOOL_RESULTS\]|TOOL_CALLS\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(?=\||/?s>|</?SYS>>|/?INST\]|/?SYSTEM_PROMPT\]|/?AVAILABLE_TOOLS\]|/?TOOL_RESULTS\]|TOOL_CALLS\])")

PART = StructType([
    StructField("type", StringType()), StructField("text", StringType()), StructField("ref", StringType()),
    StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("seconds", DoubleType()), StructField("pages", IntegerType()),
])
ATTACHMENT = StructType([StructField("ordinal", LongType()), StructField("type", StringType()), StructField("ref", StringType()), StructField("tokens", LongType())])
CHUNK = StructType([
    StructField("conv_id", LongType()), StructField("ordinal", LongType()), StructField("chunk", StringType()),
    StructField("loss_start", LongType()), StructField("loss_end", LongType()), StructField("attachments", ArrayType(ATTACHMENT)),
])
DIGEST = StructType([
    StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
    StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType()), StructField("n_attachments", LongType()), StructField("attachment_tokens", LongType()),
])


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


class PartVisitor:
    """Flattens content parts in order. first: the ordinal of the next attachment in the conversation.

    Texts that adjoin are escaped as one, so that no control string arises between them.
    """

    def __init__(self, first: int = 0, patch: int = 14, tokens_a_second: float = 25.0, tokens_a_page: int = 1024) -> None:
        self.out: list[str] = []
        self.plain: list[str] = []
        self.attachments: list[dict] = []
        self.first, self.patch, self.tokens_a_second, self.tokens_a_page = first, patch, tokens_a_second, tokens_a_page

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.plain.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach(part, ceil((part.get("width") or 0) / self.patch) * ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, ceil((part.get("seconds") or 0.0) * self.tokens_a_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.tokens_a_page)

    def visit_unknown(self, part: dict) -> None:
        """Unknown types keep their text, if any; their type is part of it, so that nothing is lost unseen."""
        self.plain.append(f"({part['type']}) {part.get('text') or ''}")

    def _attach(self, part: dict, tokens: int) -> None:
        n = self.first + len(self.attachments)
        self.attachments.append({"ordinal": n, "type": part["type"], "ref": part.get("ref"), "tokens": tokens})
        self._settle()
        self.out.append(f"<|{part['type']}:{n}|>")

    def _settle(self) -> None:
        self.out.append(escape("".join(self.plain)))
        self.plain.clear()

    def flattened(self) -> str:
        self._settle()
        return "".join(self.out)


def text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a parts column of one text part made from a plain text column (null: empty)."""
    null = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    one = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(null(f) for f in PART.fields[2:]))
    return df.withColumn("parts", F.array(one))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted chunks of conversations: conv_id, ordinal (from 0), chunk, loss_start, loss_end, attachments.

    turns: conv_id, turn, role, parts (array of PART); other columns are left out. loss_start and loss_end bound, in
    code points of the chunk, the escaped text under the loss mask (assistant turns; null elsewhere). Turns come by
    turn, nulls first; ties by role, then parts. Null roles and parts are empty. Null conv_id: one conversation of its own.
    Rows stay sorted by conversation inside each partition.
    """
    arrow = to_arrow_schema(CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ordinal, seen = object(), 0, 0
        for batch in batches:
            for piece in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                rows = []
                for c, role, parts in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                    if c != conv:
                        conv, ordinal, seen = c, 0, 0
                    visitor = PartVisitor(seen)
                    for part in parts or []:
                        visitor.visit(part)
                    seen += len(visitor.attachments)
                    head, body = f"{ROLE}{escape(role or '')}{TEXT}", visitor.flattened()
                    mask = (len(head), len(head) + len(body)) if role == "assistant" else (None, None)
                    rows.append((c, ordinal, f"{head}{body}{END}", *mask, visitor.attachments))
                    ordinal += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "parts").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "parts").select("conv_id", "role", "parts")
    return ordered.mapInArrow(run, CHUNK)


def read_chunk(chunk: str) -> tuple[str, str]:
    """Role and text of a formatted chunk."""
    role, _, rest = chunk.removeprefix(ROLE).partition(TEXT)
    return unescape(role), unescape(rest.removesuffix(END))


def read_back(chunks: DataFrame) -> DataFrame:
    """One digest row per conversation, made from the formatted chunks alone (in the order format_conversations left)."""
    arrow = to_arrow_schema(DIGEST)

    class Reader:
        def __init__(self, conv: int | None) -> None:
            self.conv, self.n, self.turns, self.loss = conv, 0, hashlib.sha256(), hashlib.sha256()
            self.loss_chars = self.chars = self.attachments = self.tokens = 0

        def read(self, chunk: str, start: int | None, end: int | None, attachments: list[dict]) -> None:
            role, text = read_chunk(chunk)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            self.chars += len(chunk)
            if start is not None:
                masked = unescape(chunk[start:end])
                self.loss.update(masked.encode("utf-8", "replace"))
                self.loss_chars += len(masked)
            self.attachments += len(attachments)
            self.tokens += sum(a["tokens"] for a in attachments)

        def row(self) -> tuple:
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.attachments, self.tokens

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader = None
        for batch in batches:
            for c, _, chunk, start, end, attachments in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if reader is None or reader.conv != c:
                    if reader:
                        yield reader.row()
                    reader = Reader(c)
                reader.read(chunk, start, end, attachments)
        if reader:
            yield reader.row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
        for row in rows(batches):
            held.append(row)
            if len(held) == 5000:
                yield pack()
                held = []
        if held:
            yield pack()

    return chunks.mapInArrow(run, DIGEST)
