"""Secret scans: pattern rules, and character Markov models for secrets that no pattern names.

Two bigram models, of random strings and of ordinary identifiers, are counted from labelled samples; a token whose
log-likelihood ratio per character is over the threshold is a secret. The ratios of all character pairs are one
array of fixed size, so scoring is a fold over the token's pairs. All of it is SQL functions over one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

#: Patterns of the rules; of an assignment the second group is the value. Greedy matches under the least length are dropped.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"  # runs are matched whole, so that the least length can stand in the pattern
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Values that are folded at a time, and code points of a chunk of a text; both keep the work in proportion to the text.
BLOCK, CHUNK = 128, 2048
#: Tokens that the models look at.
CANDIDATE = "[A-Za-z0-9_+/=-]{20,}"
#: Characters that the models tell apart; all others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/="
#: Log-likelihood ratio per character pair from which a token counts as random.
THRESHOLD = 0.4
KINDS = ("assign", "access", "hex", "markov")
#: Parts of ordinary identifiers (fixed values).
PARTS = "account add address after all app apply array async author base batch before begin block body boolean buffer build button byte cache call case chain change channel char check child class clean clear client close code collection column command comment commit compare component config connect content context control convert copy count create current data date debug decode default define delete depth detail device display document down draw edit element empty encode end entry error event exception execute exit export extend factory field file filter find first flag float folder format frame free from function get global graph group handle handler hash head height hidden host image import index info init input insert instance integer interface invalid item iterator job join key label language last layer left length level library limit line link list listener load local lock log login logger loop main make manager map mark mask match max merge message method min mode model module move name native network new next node null number object offset old open option order output owner package page pair parent parse part password path pattern pending phone point port position post prefix previous print process profile project property public push query queue random range read record reference refresh region register remote remove render replace request reset resolve resource response result return right role root route row run save scale schema scope screen script search section select send sequence server service session set shape shared show size sort source split stack start state status stop store stream string style submit success sum switch symbol sync system table tag target task temp test text thread time title token top total track transaction transform tree trigger type unit update upload url user util valid value vector version view visible wait watch weight width window word worker wrapper write zone".split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled training strings made by rule: label 1 random (hex, base 64, base 62, capitals), 0 identifiers and paths of ordinary words."""
    h = F.sha2(F.concat(F.lit("r"), F.col("id")), 512)
    hexed = F.substring(h, 1, 40)
    b64 = F.substring(F.base64(F.unhex(h)), 1, 44)
    b62 = F.substring(F.regexp_replace(F.base64(F.unhex(h)), "[+/=]", ""), 1, 36)
    caps = F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(h)), "[+/=]", "")), 1, 32)
    random = F.element_at(F.array(hexed, b64, b62, caps), (F.col("id") % 4 + 1).cast("int"))
    words = F.array(*map(F.lit, PARTS))
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    some = F.array(*(word(k) for k in range(5)))
    camel = F.concat_ws("", F.transform(some, F.initcap))
    plain = F.element_at(F.array(F.array_join(some, "_"), camel, F.array_join(some, "/"), F.array_join(some, "-"), F.array_join(some, ""), F.upper(F.array_join(some, "_"))), (F.col("id") % 6 + 1).cast("int"))
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(1).alias("label")).unionByName(ids.select(plain.alias("text"), F.lit(0).alias("label")))


def train_markov(samples: DataFrame, text: str = "text", label: str = "label", smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all character pairs, row by row of the first one, as counted from labelled strings.

    Null texts and labels other than 0 and 1 are passed over. Without samples every ratio is 0. The table has (characters + 1) squared entries, whatever the samples.
    """
    from math import log

    size = len(ALPHABET) + 1
    at = lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(size))
    pairs = samples.filter(F.col(label).isin(0, 1) & (F.length(text) > 1)).select(F.col(label).alias("y"), F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(F.col(text), i, F.lit(2)))).alias("p"))
    counted = pairs.groupBy("y", at(F.substring("p", 1, 1)).alias("a"), at(F.substring("p", 2, 1)).alias("b")).count()
    counts = {(r["y"], r["a"], r["b"]): r["count"] for r in counted.collect()}
    if not counts:
        return [0.0] * size * size
    ratio = []
    for a in range(1, size + 1):
        total = [sum(counts.get((y, a, b), 0) for b in range(1, size + 1)) + smooth * size for y in (0, 1)]
        ratio += [log((counts.get((1, a, b), 0) + smooth) / total[1]) - log((counts.get((0, a, b), 0) + smooth) / total[0]) for b in range(1, size + 1)]
    return [round(r, 6) for r in ratio]


def likelihood_ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's character pairs; 0 for tokens of fewer than two characters."""
    size = len(ALPHABET) + 1
    codes = F.transform(F.split(token, ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)), F.lit(size)))
    total = F.aggregate(codes, F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum")), lambda acc, c: F.struct(c.alias("before"), (acc["sum"] + F.when(acc["before"] > 0, F.element_at(table, (acc["before"] - 1) * size + c)).otherwise(0.0)).alias("sum")), lambda acc: acc["sum"])
    return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(0.0)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def _before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What merge makes, from 0, of all values (whole numbers) before each one. A block of values is folded at a time, since an array that grows is copied with every value."""
    none = F.array().cast("array<int>")

    def folded(own: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(own, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda own: F.aggregate(own, F.lit(0), merge))
        return F.flatten(F.zip_with(blocks, folded(totals, F.lit(0)), folded))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(values) > 0, _let(blocks, over)).otherwise(none)


def _spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points: what lies between the matches gives their places."""
    none = F.array().cast("array<struct<start:int,end:int,rank:int,value:string>>")
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    zipped = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), F.length(m).alias("m"))), values, lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), v.alias("v")))
    rank = F.lit(KINDS.index(kind))
    place = lambda x, at: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["m"]).alias("end"), rank.alias("rank"), x["v"].alias("value"))
    found = _let(zipped, lambda z: F.zip_with(z, _before(F.transform(z, lambda x: x["g"] + x["m"]), lambda p, q: p + q), place))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _rewritten(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """text with instead(span, end of those before it) in place of what sorted spans cover. Pieces are cut from chunks of the text, so that no cut counts from its beginning."""

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        i, j = (F.floor(x / CHUNK).cast("int") for x in (start, end))
        own = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        inside = F.substring(own(i), start % CHUNK + 1, end - start)
        across = F.concat(F.substring(own(i), start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(own(j), F.lit(1), end % CHUNK))
        return F.when(end <= start, F.lit("")).when(i == j, inside).otherwise(across)

    def made(chunks: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        pieces = F.zip_with(spans, _before(ends, lambda p, q: F.greatest(p, q)), lambda s, at: F.concat(cut(chunks, at, F.greatest(at, s["start"])), instead(s, at)))
        return F.concat(F.array_join(pieces, ""), cut(chunks, F.array_max(ends), F.length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), made)


def _blanked(text: Column, spans: Column) -> Column:
    """text of the same length, with spaces for what sorted spans (one at least) cover."""
    return _rewritten(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"]))))


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, name: str, table: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column: base and spans (arrays of start, end, rank of the kind; code points, end exclusive), sorted by start and kind.

    spans holds base and the tokens that the Markov models call random; base spans end a token, and what is left of it on
    either side is a token of its own. Null and empty texts have none. Repeated rows each get their result; other columns pass through.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    a, b, c, d, m = (free_name(docs, f"_{name}_{k}") for k in ("rules", "tokens", "scored", "all", "rest"))
    short = lambda spans, kind: F.filter(spans, lambda s: F.length(s["value"]) >= LEAST[kind])
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["rank"]))
    rules = F.array_sort(bare(F.concat(short(_spans(body, ASSIGN, "assign", 2), "assign"), short(_spans(body, ACCESS, "access"), "access"), _spans(body, HEX, "hex"))))
    by_kind = F.array_sort(F.transform(rules, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    out = docs.withColumn(a, by_kind)
    out = out.withColumn(m, F.when(F.size(a) > 0, _blanked(body, F.col(a))).otherwise(body)).withColumn(b, _spans(F.col(m), CANDIDATE, "markov"))
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # constant: folded into one literal
    out = out.withColumn(c, F.filter(F.col(b), lambda t: likelihood_ratio(t["value"], ratios) >= threshold))
    added = F.transform(F.col(c), lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end")))
    out = out.withColumn(d, F.array_sort(F.concat(F.col(a), added)))
    return out.withColumn(name, F.struct(F.col(a).alias("base"), F.col(d).alias("spans"))).drop(a, b, c, d, m)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, table: list[float], text: str = "text", mask: str = "[secret]", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every secret replaced by the mask (overlapping spans by one), and the length column, if any, brought up to date. Other rows and columns stay as they are."""
    name = free_name(docs, "secrets")
    out = scan_secrets(docs, name, table, text)
    body = F.col(text)
    folded = _rewritten(body, F.col(name)["spans"], lambda s, at: F.when(s["start"] >= at, F.lit(mask)).otherwise(F.lit("")))
    out = out.withColumn(text, F.when(F.size(F.col(name)["spans"]) > 0, folded).otherwise(body))
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.size(F.col(name)["spans"]) > 0, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.drop(name)
