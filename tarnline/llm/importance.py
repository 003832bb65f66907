"""Importance resampling toward a target distribution over hashed word runs.

The features of a text are its runs of one to three words; each falls into one of 10,000 buckets. A bucket's gain is
the logarithm of its share in the target over its share in the raw documents, both smoothed; a document's weight is the
sum of the gains of its features, and Gumbel noise drawn from its id turns the highest weights into a sample without
replacement.

Array functions make a document's bucket array in its own row; these arrays are written once. Counting them shuffles one
row for each bucket and task, and a document's weight is an aggregate over its array that looks every gain up in a
literal array, without exploding anything. Ranks come from a sort by ranges over a few numbers a document: no task sees all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged

BUCKETS = 10_000
#: Longest run of words that is a feature.
LONGEST = 3
#: Documents of fewer words aren't drawn.
LEAST_WORDS = 20
#: Share of the documents with enough words that is drawn, in percent.
PERCENT = 5
SEED = 42
#: What stands between words once A-Z are in lower case; bytes above 127 belong to words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def word_array(text: Column) -> Column:
    """The words of a text; a null or empty one has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def feature_array(words: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to longest consecutive words, joined by a space, repeats and all: shorter runs first."""

    def longer(runs: Column, n: int) -> Column:
        if n > longest:
            return runs
        least = F.greatest(F.size(words) - (n - 1), F.lit(0))
        joined = F.zip_with(F.slice(runs, F.lit(1), least), F.slice(words, F.lit(n), least), lambda a, b: F.concat(a, F.lit(" "), b))
        return _let(joined, lambda more: F.concat(runs, longer(more, n + 1)))

    return longer(words, 2)


def bucket_array(words: Column, buckets: int = BUCKETS, longest: int = LONGEST) -> Column:
    """The bucket of every feature: unsigned CRC-32 of its UTF-8 bytes, modulo the number of buckets."""
    return F.transform(feature_array(words, longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucketed(df: DataFrame, text: str, name: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """df with a struct column name of n_words and buckets (the bucket array) instead of its text column."""
    made = _let(word_array(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), bucket_array(w, buckets, longest).alias("buckets")))
    return df.withColumn(name, made).drop(text)


def totals(arrays: DataFrame, column: str) -> dict[int, int]:
    """How often each bucket stands in the arrays of a column. What comes to the driver are at most as many numbers as there are buckets."""
    counted = arrays.select(F.explode(column).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return {r.bucket: r.n for r in counted.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from a hash of the seed and the id (a null id: no digits)."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weight(buckets: Column, gain: list[int]) -> Column:
    """The sum of the gains of a bucket array; 0 of an empty one."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, x: a + F.element_at(table, x + 1))


def ranked(scored: DataFrame, staged: Staged, id_col: str, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score, uid) with their rank among those of enough words, 1 for the highest score; null for what isn't drawn.

    The rows are dealt out by ranges of score, id and uid and numbered in each range; what the ranges before hold is added.
    """
    enough = F.coalesce(F.col("n_words"), F.lit(0)) >= least_words
    ordered = scored.filter(enough).repartitionByRange(F.desc("score"), F.col(id_col).asc_nulls_first(), F.col("uid")).sortWithinPartitions(F.desc("score"), F.col(id_col).asc_nulls_first(), F.col("uid"))
    placed = staged.keep(ordered.withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # a row for each range, as many as the shuffle has partitions
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total = placed.count()
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = placed.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + at + 1)
    drawn = F.when(F.col("rank") <= percent * total // 100, F.col("rank"))
    kept = [c for c in scored.columns if c != "uid"]
    return found.select(*kept, drawn.alias("rank")).unionByName(scored.filter(~enough).select(*kept, F.lit(None).cast("long").alias("rank")))


def importance(docs: DataFrame, target: DataFrame, staged: Staged, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row a document: its id, n_words, n_features, weight, score and rank (1, 2, 3... of the drawn; null: not drawn).

    target: rows with a text column of the same name. Null and empty texts have no features, weight 0, and are never
    drawn. Ties go to the lesser id (null first); repeated rows are documents of their own, next to each other in the
    ranking. An empty target or empty documents count as no features; other columns are left out, whatever their names.
    """
    body, found = "body" if id_col != "body" else "body_", "made" if id_col != "made" else "made_"
    arrays = lambda df, *ids: bucketed(df.select(*ids, F.col(text).alias(body)), body, found, buckets, longest)
    own = staged.keep(arrays(docs, id_col))
    made = F.col(found)
    gain = gains(totals(own, f"{found}.buckets"), totals(arrays(target), f"{found}.buckets"), buckets)
    figures = own.select(id_col, made["n_words"].alias("n_words"), F.size(made["buckets"]).cast("long").alias("n_features"), weight(made["buckets"], gain).alias("weight"))
    scored = staged.keep(figures.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).withColumn("uid", F.monotonically_increasing_id()))
    staged.drop(own)
    return ranked(scored, staged, id_col, least_words, percent)


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn, whole."""
    return docs.join(ranks.filter("rank is not null").select(id_col), id_col, "left_semi")
