"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Text bytes that a Python worker handles at once; longer batches are sliced.
SLICE_BYTES = 8_000_000
#: Bytes of an Arrow batch on its way to a Python worker; a batch ends with the row that passes this. Not changed where the session names its own.
BATCH_BYTES = "16m"
#: The session's switch by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. A session on one machine (tests) that names none gets a folder of its own; a cluster that names none raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def bound_batches(spark: SparkSession) -> None:
    """Texts reach Python workers in batches of bounded bytes, whatever the number of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, BATCH_BYTES)


class Staged:
    """Intermediate tables of one query in the shared folder. A table cuts the lineage: its readers survive lost executors, and the shuffles that made it are deleted at once."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added while the frame has such a column already (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Gives memory that Arrow and the C library hold free back; workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text column of each piece has at most SLICE_BYTES, or is one row."""
    for batch in batches:
        if batch.column(column).nbytes <= SLICE_BYTES:
            if batch.num_rows:
                yield batch
            continue
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)


def add_struct(df: DataFrame, text: str, name: str, fields: StructType, make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """df with a struct column made in Python from the text column, in Arrow batches; all other columns pass through untouched.

    make() is called once per task and returns a function from the texts of a slice (null: None) to a dict of
    equally long lists, one for each field.
    """
    schema = StructType([*df.schema.fields, StructField(name, fields, True)])
    arrow = to_arrow_schema(fields)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for piece in slices(batches, at):
            out = score(piece.column(at).to_pylist())
            made = pa.StructArray.from_arrays([pa.array(out[f.name], f.type) for f in arrow], fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*piece.schema.names, name])
        del score
        release()

    return df.mapInArrow(run, schema)


def sha256_hex(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)
