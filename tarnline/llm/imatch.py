"""I-Match document fingerprints over a mid-frequency lexicon.

The lexicon holds the terms whose document frequency lies in a band, by shares of all documents. Its size is bounded
whatever the corpus: every term takes at least the lower share of all documents, and a document has only so many
distinct terms; over the bound of bytes the lexicon is joined by shuffle instead of broadcast. Of each document the
lexicon's terms are sorted and hashed once for every randomised subset of the lexicon. Subsets come at several rates,
each a quarter of the one before, so that short and long documents alike have subsets that hold a few of their terms.
All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The band: least and largest share of the documents that a term is in.
LEAST_SHARE, MOST_SHARE = 1 / 1000, 1 / 10
#: Subsets of the lexicon: the whole, and SEEDS random ones at each of the rates 1/4, 1/16, ... 1/4^RATES.
RATES, SEEDS = 5, 16
#: Lexicon terms up to which it is broadcast (16 bytes each).
BROADCAST_TERMS = 2_000_000
#: Bytes of text in a range of ids in which neighbours are looked up.
RANGE_BYTES = 8_000_000


def terms(text: Column) -> Column:
    """Distinct terms of a text, hashed: lower-case runs of letters and digits. Null: none."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(F.array_distinct(split), lambda t: t != "")


def lexicon(docs: DataFrame, text: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> DataFrame:
    """Hashed terms in the band, counted over all documents (column h). A term needs two documents at least."""
    n = docs.count()
    found = docs.select(F.explode(terms(F.col(text))).alias("t")).select(F.xxhash64("t").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return found.filter((F.col("df") >= max(2.0, least_share * n)) & (F.col("df") <= max(2.0, most_share * n))).select("h")


def fingerprint(df: DataFrame, sorted_terms: str, whole: str, name: str) -> DataFrame:
    """df with the hashes of the terms in every subset, in hexadecimal and joined by '-'; nothing for an empty subset.

    The subsets of a seed are nested. A text without lexicon terms gets the hash of all its terms after 'x'.
    """
    parts, before = [f"_{name}_{r}" for r in range(RATES + 1)], F.col(sorted_terms)
    out = df.withColumn(parts[0], F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda s: before))
    for r in range(1, RATES + 1):
        out = out.withColumn(parts[r], F.transform(parts[r - 1], lambda own, s: F.filter(own, lambda h: F.shiftrightunsigned(F.xxhash64(h, s), 2 * r).bitwiseAND(3) == 0)))  # noqa: B023
    short = lambda own: F.when(F.size(own) == 0, "").otherwise(F.lower(F.hex(F.xxhash64(own).bitwiseAND(0xFFFF))))
    hashes = F.concat(F.array(F.lower(F.hex(F.xxhash64(sorted_terms)))), *(F.transform(p, short) for p in parts[1:]))
    return out.withColumn(name, F.when(F.size(sorted_terms) > 0, F.array_join(hashes, "-")).otherwise(F.concat(F.lit("x"), F.lower(F.hex(whole))))).drop(*parts)


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with equal hashes, among those that aren't empty in both; 1 for equal fingerprints, 0 if either has no lexicon term."""
    pairs = F.zip_with(F.split(a, "-"), F.split(b, "-"), lambda x, y: F.when((x == "") & (y == ""), None).when(x == y, 1).otherwise(0))
    counted = F.filter(pairs, lambda p: p.isNotNull())
    mean = F.aggregate(counted, F.lit(0), lambda s, p: s + p) / F.size(counted)
    return F.when(a == b, 1.0).when(F.startswith(a, F.lit("x")) | F.startswith(b, F.lit("x")), 0.0).otherwise(mean).cast("double")


def fingerprints(texts: DataFrame, lexicon_: DataFrame, key: list[str], bodies: dict[str, str], keep: list[str]) -> DataFrame:
    """key, the kept columns, and one fingerprint for each text column in bodies (result name to column). key must be unique.

    Terms are looked up in the lexicon as rows and gathered again by key; besides one row for each text only lexicon terms are moved.
    """
    small = lexicon_.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    known = lexicon_.withColumn("known", F.lit(True))
    known = F.broadcast(known) if small else known
    mark = "\x00"
    each = F.array(*(F.struct(F.lit(i).alias("i"), terms(F.col(c)).alias("t")) for i, c in enumerate(bodies.values())))
    per_text = texts.select(*key, *keep, F.explode(each).alias("b")).select(*key, *keep, F.col("b.i").alias("i"), F.concat(F.array(F.lit(mark)), "b.t").alias("t"), F.xxhash64(F.array_sort(F.col("b.t"))).alias("whole"))
    rows = per_text.select(*key, *keep, "i", "whole", F.explode("t").alias("t")).select(*key, *(F.when(F.col("t") == mark, F.col(k)).alias(k) for k in keep), "i", F.when(F.col("t") == mark, F.col("whole")).alias("whole"), F.xxhash64("t").alias("h"), (F.col("t") == mark).alias("marked"))
    found = rows.join(known, "h", "left").filter("known or marked")
    gathered = found.groupBy(*key).agg(
        *(F.first(k, ignorenulls=True).alias(k) for k in keep),
        *(F.first(F.when(F.col("i") == i, F.col("whole")), ignorenulls=True).alias(f"_w{i}") for i in range(len(bodies))),
        *(F.array_sort(F.collect_list(F.when((F.col("i") == i) & F.col("known"), F.col("h")))).alias(f"_{i}") for i in range(len(bodies))),
    )
    for i, n in enumerate(bodies):
        gathered = fingerprint(gathered, f"_{i}", f"_w{i}", n)
    return gathered.select(*key, *keep, *bodies)


def next_in_order(docs: DataFrame, id_col: str, carry: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The id and carried column, with next_<carry> of the row with the next id; after the last comes the first. Also part (range of ids), place in it, and ghost.

    Ids are cut into ranges of about so many bytes at approximate quantiles, so their number grows with the input. The first row of a range is also dealt to the range before it, as a
    ghost (ghost > 0) at its end, so every range is a window of its own and no task sees all rows. Null ids come first; ties go by the carried column.
    """
    key = F.col(id_col)
    ranges = 1 + (docs.agg(F.sum(F.octet_length(carry))).first()[0] or 0) // range_bytes
    quantiles = [i / ranges for i in range(1, ranges)] or [0.5]
    found = docs.agg(F.percentile_approx(id_col, quantiles, max(10_000, 20 * ranges)).alias("q"), F.min(id_col).alias("low"), F.count_if(key.isNull()).alias("nulls")).first()
    cut = sorted({q for q in found["q"] or [] if q != found["low"]}) if ranges > 1 else []
    splits = F.array(*map(F.lit, cut)).cast("array<bigint>")
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(len(cut).bit_length())))).cast("array<int>")
    below = F.aggregate(halves, F.lit(0), lambda n, h: F.when(F.try_element_at(splits, n + h) <= key, n + h).otherwise(n))  # how many splits are not over the id, by halving
    part = F.when(key.isNull(), 0).otherwise(below)
    first = key.isNull() if found["nulls"] else key == F.lit(found["low"])
    place = lambda p, g: F.struct(p.cast("int").alias("part"), F.lit(g).alias("ghost"))
    places = F.array(place(part, 0), F.when(F.array_contains(splits, key), place(part - 1, 1)), F.when(first, place(F.lit(len(cut)), 2)))
    dealt = docs.select(id_col, carry, F.explode(F.filter(places, lambda p: p.isNotNull())).alias("_p")).select(id_col, carry, "_p.part", "_p.ghost")
    window = Window.partitionBy("part").orderBy("ghost", F.col(id_col).asc_nulls_first(), F.col(carry).asc_nulls_first())
    return dealt.select("*", F.row_number().over(window).alias("place"), F.lead(carry).over(window).alias(f"next_{carry}"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Null texts are empty. Rows with one id follow each other by text and each count as a document; a single document
    is its own next one. Null ids come first. An empty table gives no rows. Columns other than the two are left out.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = next_in_order(plain, "doc_id", "text").withColumn("edited", F.coalesce(edited(F.col("text"), F.col("next_text")), F.lit("")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    made = fingerprints(rows, lexicon(plain), ["part", "place"], {"fingerprint": "text", "edited_fingerprint": "edited"}, ["doc_id", "n_chars", "edited_sha256", "ghost"])
    following = F.lead("fingerprint").over(Window.partitionBy("part").orderBy("place"))
    made = made.withColumn("next", following).filter("ghost = 0")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
