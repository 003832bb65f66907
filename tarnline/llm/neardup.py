"""Near-duplicate documents by a chosen-path set similarity join.

Texts become sets of hashed word shingles; equal sets are one class from then on. Every tree of the join branches the
classes recursively: at each level a class goes to the child named by its least shingle under that level's hash, so two
sets stay together with the probability of their Jaccard similarity. Nodes of one class end; small nodes are compared
exhaustively, first by their minwise sketches; large nodes branch on. What keeps together in large nodes at the last
level is mostly one group of near copies: its members are compared to a hub, the member closest to what most of a
sample agree on, and a node whose members are linked through their hubs needs nothing more. The classes of all other
such nodes are joined exactly, by a prefix filter on whole sets. All links are confirmed on whole sets read from the
texts, and the trees, which share no hash, are repeated to reach the target recall: a pair at similarity 0.8 stays
together down to the last level, 4, in one of TREES trees with probability 1 - (1 - 0.8^4)^TREES = 0.998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import Staged, add_struct, bound_batches, release, slices

#: Words of a shingle; least similarity, in hundredths, of linked documents. A contract may ask for others.
WORDS, PERCENT = 5, 80
TREES, HASHES = 12, 96
#: Levels at which nodes are looked at; at the last one large nodes are compared to hubs, and what these leave apart is joined exactly.
LEVELS = (2, 3, 4)
#: Counters of shingles for the order of the exact join: shingles that share one only cost candidates, never links.
BUCKETS = 1 << 18
#: Classes in a node that is compared exhaustively, and members sampled to find a hub.
SMALL, SAMPLE = 24, 64
#: Pairs whose sketches agree less are not confirmed: more than four standard deviations below the threshold.
SKETCH_MARGIN = 0.18
_SEEDS = np.array([xxhash.xxh64_intdigest(str(i), 1) | 1 for i in range(HASHES)], np.uint64)
_SHIFTS = np.array([xxhash.xxh64_intdigest(str(i), 2) for i in range(HASHES)], np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Texts to sorted arrays of distinct hashed shingles; word hashes are remembered."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def hash(self, word: bytes) -> int:
        if (h := self.known.get(word)) is None:
            if len(self.known) > 250_000:
                self.known.clear()
            self.known[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        own = text.encode("utf-8", "replace").lower().split() if text else []
        if not own:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hash, own), np.uint64, len(own))
        k = min(self.words, len(own))
        out = np.full(len(own) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * _P + h[i : len(own) - k + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * _P
        return np.unique(out ^ (out >> np.uint64(31)))


def sketch(shingles: np.ndarray) -> bytes:
    """Minwise values under all hashes, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * _SEEDS + _SHIFTS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def sets(docs: DataFrame, name: str, words: int = WORDS, text: str = "text") -> DataFrame:
    """docs with a struct column: n (size of the shingle set), key (hash of the set), sketch; key and sketch are null for the empty set."""
    fields = StructType([StructField("n", LongType()), StructField("key", StringType()), StructField("sketch", BinaryType())])

    def make():
        shingler = Shingler(words)

        def score(texts: list[str | None]) -> dict:
            own = [shingler(t) for t in texts]
            return {"n": [len(s) for s in own], "key": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in own], "sketch": [sketch(s) if len(s) else None for s in own]}

        return score

    return add_struct(docs, text, name, fields, make)


def _mapped(df: DataFrame, schema: StructType, rows) -> DataFrame:
    """mapInArrow over columns as Python lists; rows yields tuples of lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = rows(*(c.to_pylist() for c in batch.slice(at, 1000).columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def agreement(pairs: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """The kept long columns, and agree: how many minwise values two sketches share."""
    schema = StructType([*(StructField(k, LongType()) for k in keep), StructField("agree", LongType())])

    def rows(*columns: list) -> tuple:
        a, b = (np.frombuffer(b"".join(c), "<u4").reshape(-1, HASHES) for c in columns[-2:])
        return *columns[:-2], (a == b).sum(axis=1)

    return _mapped(pairs.select(*(F.col(k).cast("long") for k in keep), left, right), schema, rows)


def _path(levels: int) -> Column:
    """A class's way down its tree: its least shingles under the hashes of so many levels, 4 bytes each."""
    return F.concat(*(F.expr(f"substring(sketch, 4 * ((6 * tree + {d}) % {HASHES}) + 1, 4)") for d in range(levels))).alias("path")


def _sized(rows: DataFrame, level: int) -> DataFrame:
    """rows (id, tree, path) with node, the name of the node they are in at a level, and its size, for nodes of two or more."""
    named = rows.select("id", "tree", "path", F.xxhash64("tree", F.lit(level), F.substring("path", 1, 4 * level)).alias("node"))
    sizes = named.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return named.join(sizes, "node")


def _pairs(small: DataFrame) -> DataFrame:
    """All pairs of classes in small nodes (a < b), each once."""
    nodes = small.groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    pairs = nodes.select(F.explode(F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, SMALL), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    return pairs.select("p.a", "p.b").distinct()


def _sketched(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs a, b with agree, of those whose sketches agree enough."""
    joined = pairs.join(classes.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(classes.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    return agreement(joined, "sa", "sb", ["a", "b"]).filter(F.col("agree") >= least * HASHES)


def hubs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Star pairs (a < b) of large nodes: each member and the hub of its node."""
    sampled = members.filter(F.pmod(F.xxhash64("id", "node"), F.col("size")) < SAMPLE).join(classes.select("id", "sketch"), "id").groupBy("node").agg(F.collect_list("sketch").alias("own"))

    def usual(nodes: list, own: list) -> tuple:
        out = []
        for sketches in own:
            x = np.sort(np.frombuffer(b"".join(sketches), "<u4").reshape(-1, HASHES), axis=0)
            run = np.ones(x.shape, np.int64)
            for i in range(1, len(x)):
                run[i] = np.where(x[i] == x[i - 1], run[i - 1] + 1, 1)
            out.append(x[run.argmax(axis=0), np.arange(HASHES)].tobytes())
        return nodes, out

    modes = _mapped(sampled, StructType([StructField("node", LongType()), StructField("mode", BinaryType())]), usual)
    close = agreement(members.join(modes, "node").join(classes.select("id", "sketch"), "id"), "sketch", "mode", ["node", "id"])
    chosen = close.groupBy("node").agg(F.max(F.struct("agree", (-F.col("id")).alias("m"))).alias("x")).select("node", (-F.col("x.m")).alias("hub"))
    return members.join(chosen, "node").filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs a, b with 100 * |intersection| >= percent * |union| over their whole sets."""
    joined = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, held = Shingler(words), None, np.zeros(0, np.uint64)
        for piece in (q for p in slices(batches, 2) for q in slices(iter([p]), 3)):
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if last is None or last != (a, ta):
                    last, held = (a, ta), shingler(ta)
                other = shingler(tb)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(other) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        del shingler, held
        release()

    return joined.mapInArrow(run, "a long, b long").distinct()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) % BUCKETS


def prefix_pairs(texts: DataFrame, labels: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs a < b of different components that can reach the similarity (a prefix filter: none that does is left out).

    With the shingles of every set in one order, rarest first, sets that are similar enough share one of their first
    n - ceil(n * percent / 100) + 1; their sizes and the place of the shared shingle bound the similarity from above.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), np.zeros(BUCKETS, np.int64)
        for piece in slices(batches, 1):
            for text in piece.column(1).to_pylist():
                counts += np.bincount(_bucket(shingler(text)), minlength=BUCKETS) if text else 0
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])
        del shingler
        release()

    found = texts.select("id", "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(BUCKETS, np.int64)
    frequency[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    order = texts.sparkSession.sparkContext.broadcast(frequency)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for piece in slices(batches, 1):
            for id_, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                own = shingler(text)
                n = len(own)
                first = own[np.lexsort((own, order.value[_bucket(own)]))][: n + percent * -n // 100 + 1] if n else own
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(len(first), id_)), pa.array(np.arange(len(first))), pa.array(np.full(len(first), n))], names=["token", "id", "at", "n"])
        del shingler
        release()

    own = texts.select("id", "text").mapInArrow(prefixes, "token long, id long, at long, n long").join(labels.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    lists = own.groupBy("token").agg(F.collect_list(F.struct("id", "c", "at", "n")).alias("x"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("x.id", "x.c", "x.at", "x.n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in zip(*batch.columns, strict=True):
                id_, c, at, n = (x.values.to_numpy() for x in columns)
                by = np.argsort(id_, kind="stable")
                id_, c, at, n = id_[by], c[by], at[by], n[by]
                out = []
                for i in range(len(id_) - 1):
                    most = np.minimum(n[i] - at[i], n[i + 1 :] - at[i + 1 :])  # shingles that the two can share from here on, the first shared one here
                    able = (c[i + 1 :] != c[i]) & (id_[i + 1 :] != id_[i]) & (100 * most >= percent * (n[i] + n[i + 1 :] - most))
                    out.append(np.stack((np.full(able.sum(), id_[i]), id_[i + 1 :][able])))
                a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return lists.mapInArrow(meet, "a long, b long").distinct()


def components(links: DataFrame, staged: Staged) -> DataFrame:
    """id and component (least id that links reach) of all linked ids, by alternating large and small stars."""
    edges = staged.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = staged.keep(small)
        staged.drop(edges)
        edges = after


def _some(df: DataFrame) -> bool:
    return not df.isEmpty()


def near_duplicates(docs: DataFrame, staged: Staged, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reached over links), kept (doc_id = component_id) for every row.

    Null, empty and wordless texts have no shingles and are linked with nothing. Repeated rows and equal sets are in one
    component. Rows with a null id are linked with nothing, have a null component and are kept. Rows that share an id but not a
    text are looked up each by its own set. An empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = staged.keep(sets(plain, "s", words).select("id", "s.n", "s.key", "s.sketch"))
    full = signed.filter("id is not null and n > 0")
    by_key = staged.keep(full.groupBy("key").agg(F.min("id").alias("class")))
    classes = staged.keep(full.join(by_key.select("key", F.col("class").alias("id")), ["key", "id"]).select("id", "key", "sketch").dropDuplicates(["id", "key"]).select("id", "sketch"))
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")

    # first levels: what is alone ends, what is small is paired, what is large branches on
    rows = classes.select("id", "sketch", trees).select("id", "tree", _path(LEVELS[-1]))
    candidates, levels = None, []
    for level in LEVELS:
        levels.append(staged.keep(_sized(rows, level)))
        found = _pairs(levels[-1].filter(f"size <= {SMALL}"))
        candidates = found if candidates is None else candidates.unionByName(found)
        rows = large = levels[-1].filter(f"size > {SMALL}")
    least = percent / 100 - SKETCH_MARGIN
    edges = staged.keep(_sketched(candidates.distinct(), classes, least))
    staged.drop(*levels[:-1])
    needed = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct()
    texts = staged.keep(plain.join(needed, "id").join(by_key.select(F.col("class").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "text"]))

    # large nodes: hubs, then an exact join of those that the hubs' links don't join
    links, labels = None, spark.createDataFrame([], "id long, component long")
    if _some(large):
        links = staged.keep(confirm(hubs(large, classes), texts, words, percent))
        labels = staged.keep(components(links, staged))
        rest = staged.keep(_mixed(large, labels).select("id").distinct())
        if _some(rest):
            own = staged.keep(texts.join(rest, "id", "left_semi"))
            edges = edges.unionByName(_sketched(prefix_pairs(own, labels, words, percent), classes, least))

    # pairs: for each document its first and its closest partner, then all pairs that these links leave apart
    edges = staged.keep(_apart(edges.distinct(), labels))
    first = edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    closest = edges.groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("m"))).alias("x")).select((-F.col("x.m")).alias("a"), "b")
    confirmed = staged.keep(confirm(first.unionByName(closest).distinct(), texts, words, percent))
    links = confirmed if links is None else links.unionByName(confirmed)
    labels = components(links, staged)
    tried = first.unionByName(closest).distinct()
    rest = staged.keep(_apart(edges, labels).join(tried, ["a", "b"], "left_anti"))
    if _some(rest):
        links = links.unionByName(staged.keep(confirm(rest, texts, words, percent)))
        labels = components(links, staged)

    out = signed.select("id", "n", "key").join(by_key, "key", "left").join(labels.select(F.col("id").alias("class"), "component"), "class", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "class", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _apart(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    own = edges.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    return own.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "agree")


def _mixed(sized: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of nodes whose members are in more than one component."""
    own = sized.join(labels, "id", "left").select("id", "tree", "path", "node", "size", F.coalesce("component", "id").alias("c"))
    mixed = own.groupBy("node").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("node")
    return own.join(mixed, "node").select("id", "tree", "path", "node", "size")


def drop_near_duplicates(docs: DataFrame, staged: Staged, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies, that with the least id; of rows with that id all but one of each text go. The columns stay. Rows with a null id stay."""
    kept = near_duplicates(docs, staged, words, percent, id_col, text).filter(f"kept and {id_col} is not null").select(id_col).distinct()
    first = docs.filter(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col, text])
    return first.unionByName(docs.filter(F.col(id_col).isNull()))
