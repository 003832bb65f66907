"""Tables of places stored along a space-filling curve, with the bounds of each file, so that a box reads few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.functions import zorder

#: Runs of codes that a box is turned into at most.
RUNS = 64


def write(rows: DataFrame, path: str, x: str = "x", y: str = "y", files: int | None = None) -> None:
    """Writes rows with a column z (their code), dealt out and sorted by it, under path/rows, and the bounds of every file under path/files. Rows without a place have the least code. files: how many, or as many as the shuffle has partitions."""
    box = rows.agg(F.min(x).alias("x"), F.min(y).alias("y"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("side")).first()
    west, south, side = box.x or 0.0, box.y or 0.0, (box.side or 0.0) * (1 + 1e-9) or 1.0
    coded = rows.withColumn("z", zorder.code(F.col(x), F.col(y), west, south, side))
    # rows of one place are dealt by a hash as well, so that a crowded place is no single task's
    order = ["z", F.xxhash64(*rows.columns)]
    dealt = coded.repartitionByRange(files, *order) if files else coded.repartitionByRange(*order)
    dealt.sortWithinPartitions("z").write.parquet(f"{path}/rows")
    spark = rows.sparkSession
    found = spark.read.parquet(f"{path}/rows").select("z", F.col(x).alias("x"), F.col(y).alias("y"), F.col("_metadata.file_path").alias("file"))
    bounds = found.groupBy("file").agg(F.min("z").alias("first"), F.max("z").alias("last"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"), F.count(F.lit(1)).alias("n"))
    bounds.select("*", F.lit(west).alias("at_x"), F.lit(south).alias("at_y"), F.lit(side).alias("side"), F.lit(x).alias("x"), F.lit(y).alias("y")).coalesce(1).write.parquet(f"{path}/files")


def files_in(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """The files whose bounds meet a box."""
    return spark.read.parquet(f"{path}/files").filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """The rows in a box (bounds count): from files that meet it, of which runs of codes are read; the names of these files come to the driver, as a scan's do."""
    known = spark.read.parquet(f"{path}/files")
    where = known.select("at_x", "at_y", "side", "x", "y").first()
    schema = spark.read.parquet(f"{path}/rows").schema
    names = [r.file for r in files_in(spark, path, west, south, east, north).select("file").collect()]
    if where is None or not names:
        return spark.createDataFrame([], schema).drop("z")
    last = (1 << zorder.DEEPEST) - 1
    step = lambda v, low: max(0, min(last, int((v - low) / where.side * (last + 1) // 1)))
    # one more on each side, against rounding
    box = (max(0, step(west, where.at_x) - 1), max(0, step(south, where.at_y) - 1), min(last, step(east, where.at_x) + 1), min(last, step(north, where.at_y) + 1))
    runs = None
    for a, b in zorder.ranges(box, RUNS):
        one = F.col("z").between(a, b)
        runs = one if runs is None else runs | one
    found = spark.read.schema(schema).parquet(*names).filter(runs)
    return found.filter(F.col(where.x).between(west, east) & F.col(where.y).between(south, north)).drop("z")
