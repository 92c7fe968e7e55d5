"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal shingle sets are one node, a row of the incidence matrix;
shingles are its columns. A node enters the product with the columns of its
prefix, rare ones first (by counts of all shingles in hashed cells), so
passages that many documents share stay out of the prefixes of documents that
have anything else. Sets that reach the similarity share at least
``least_shared`` of these columns, a bound that follows from the smaller size;
a node that shares fewer with all others together leaves at once.

The product runs in blocks. A block takes the next rows of each column as
pivots, multiplies the column's other rows with them and adds to each pair's
overlap count; pivots come in one order for all columns, rows that meet most
others first, so a group of near copies meets in one of them. A column counts
for a pair only if what the two shared before it at most and have left from it
on reach the overlap that their sizes need (``can_reach``). Of two rows that
have too many unshared columns before one, neither can reach a set of its own
size or more, so such rows are no pivots and never meet each other. A pair
whose count reaches the bound of its sizes (``needed``) is compared in full, and links
close to components. Pivots that were used leave their column, a column whose
rows are all in one component is done, and blocks go on (with more pivots each
time, or all of them once few enough pairs are left) until no column is left:
what is still below its bound then can't link and is discarded. Pairs inside a
component are never formed for their own sake, so a group of n copies costs
about n pairs, and no link between different components can be missed.

Cases: null and wordless texts have no shingles and link with nothing (their
component is their own doc_id); a text of fewer than five words is one shingle;
repeated rows and equal texts are one node; a null doc_id is never a
component's id unless all ids of the component are null. No documents give an
empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinwork.llm.common import BATCH_ROWS, arrow_batches, checkpointed, fresh, quoted, release
from veinwork.llm.components import components
from veinwork.llm.shingles import mix, shingles

WORDS = 5
PERCENT = 80
#: Cells in which shingles are counted; about 16 for each document, within these bounds.
CELLS = (1 << 16, 1 << 24)
_SLICES = 64
#: Pivots of a column in the first block; each later block has so many times more than the one before.
PIVOTS, MORE_PIVOTS = 1, 8
#: Sides of at most so many rows (of two or three numbers) are broadcast; larger ones meet by a shuffle.
BROADCAST_ROWS = 500_000
#: Nodes that a task remembers, to send the columns of each once.
_SEEN = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def node_id(s: np.ndarray) -> int:
    """64 bits of a set."""
    return int((mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.uint64(len(s))).astype(np.int64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(k, BATCH_ROWS)
            yield part, part.column(part.schema.names.index("text")).to_pylist()


def cell_levels(docs: DataFrame, words: int) -> np.ndarray:
    """How far each cell's count of shingles stands above the mean, in steps of three standard deviations.

    Counts all shingles of all rows. Each task sends one vector of counts, in
    slices that are summed where they meet; what the driver gets has one byte
    for each cell, however large the corpus.
    """
    rows = docs.count()
    cells = CELLS[0]
    while cells < min(CELLS[1], 16 * rows):
        cells *= 2
    shift, width = np.uint64(64 - cells.bit_length() + 1), cells // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, texts in _texts(batches):
            if total is None:
                total = np.zeros(cells, np.uint32)
            at = [shingles(t, words) >> shift for t in texts]
            at = np.concatenate(at).astype(np.int64) if at else np.empty(0, np.int64)
            np.add(total, np.bincount(at, minlength=cells).astype(np.uint32) if len(at) > cells // 8 else 0, out=total)
            if len(at) <= cells // 8:
                u, n = np.unique(at, return_counts=True)
                total[u] += n.astype(np.uint32)
        if total is not None:
            parts = total.reshape(_SLICES, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array([_packed(p) for p in parts], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k not in sums:
                    sums[k] = np.zeros(width, np.uint64)
                sums[k] += np.frombuffer(c[1:], f"u{c[0]}")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    each = docs.select("text").mapInArrow(count, schema).repartition(_SLICES, "slice").mapInArrow(add, schema)
    out = np.zeros(cells, np.uint64)
    for r in each.toLocalIterator():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.uint64)
    mean = max(1.0, out.mean())
    return np.clip((out - mean) / (3 * mean**0.5), 0, 60).astype(np.uint8)


def _packed(p: np.ndarray) -> bytes:
    top = int(p.max())
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([size]) + p.astype(f"u{size}").tobytes()


def least_shared(n, percent: int):
    """Elements that a set of n shares, within the prefixes, with any larger set that reaches the similarity (integers or a column)."""
    spare = (n * (100 - percent) - n * (100 - percent) % 100) / 100 if isinstance(n, Column) else n * (100 - percent) // 100
    return F.greatest(F.lit(1), F.floor((spare + 1) / 3)) if isinstance(n, Column) else max(1, (spare + 1) // 3)


def prefix_length(n: int, percent: int) -> int:
    """If at most ``n - ceil(percent * n)`` elements of a set aren't in the other, ``least_shared`` of so many first ones are, and in its prefix too."""
    return n * (100 - percent) // 100 + least_shared(n, percent)


def overlap(n, m, percent: int):
    """Elements that sets of n and m share at least, if they reach the similarity (columns)."""
    return F.ceil(percent * (n + m) / (100 + percent))


def needed(n: Column, m: Column, percent: int) -> Column:
    """Columns that sets of n and m share at least within both prefixes, if they reach the similarity.

    Either has at most ``n - overlap`` elements of its own, so that many from
    the end of its prefix are shared ones at the latest, or before.
    """
    o = overlap(n, m, percent)
    length = lambda k: F.floor(k * (100 - percent) / 100) + least_shared(k, percent)
    return F.greatest(F.lit(1), F.least(length(n) - (n - o), length(m) - (m - o)))


def can_reach(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether rows a and b (n: size; pos: columns before this one; r: those of them that anything shares) can link if both have this column."""
    return F.least(a["r"], b["r"]) + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= overlap(a["n"], b["n"], percent)


def _prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, th, s, n, prefix) for each row: node, size of its set, and the prefix's columns; a task may leave these out for a node that it has sent."""
    spark = docs.sparkSession
    levels = cell_levels(docs, words)
    sent, shift = spark.sparkContext.broadcast(levels), np.uint64(64 - len(levels).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = sent.value, set()
        for part, texts in _texts(batches):
            ids, sizes, prefixes = [], [], []
            for t in texts:
                x = shingles(t, words)
                ids.append(node_id(x) if len(x) else None)
                sizes.append(len(x))
                if ids[-1] in seen:
                    x = x[:0]
                elif len(x):
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(ids[-1])
                    key = (level[x >> shift].astype(np.uint64) << np.uint64(58)) | (mix(x) >> np.uint64(6))
                    x = x[np.argsort(key, kind="stable")[: prefix_length(len(x), percent)]]
                prefixes.append(x.astype(np.int64))
            offsets = np.zeros(len(prefixes) + 1, np.int32)
            np.cumsum([len(p) for p in prefixes], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["id", "th", "s", "n", "prefix"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("th", T.LongType()), T.StructField("s", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.select(quoted("doc_id").alias("id"), _text_hash().alias("th"), "text").mapInArrow(run, schema)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(s, n, x): a row for each node, with its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            found = {node_id(x): x for t in texts if len(x := shingles(t, words))}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([len(x) for x in found.values()], pa.int64()), pa.array([x.view(np.int64) for x in found.values()], pa.list_(pa.int64()))], names=["s", "n", "x"])

    return docs.select("text").mapInArrow(run, "s long, n long, x array<long>")


class _Product:
    """The product's state: incidence rows (g, s, n, pos, r, d), node sets, overlap counts of undecided pairs, links and components so far."""

    def __init__(self, rows: DataFrame, sets: DataFrame, percent: int):
        self.rows, self.sets, self.percent = rows, sets, percent
        self.counts = self.links = self.roots = None
        #: Rows that reach a set of their own size.
        self.early = (100 + percent) * (F.col("n") - F.col("pos") + F.col("r")) >= 2 * percent * F.col("n")

    def placed(self) -> DataFrame:
        """The incidence rows with their components c."""
        if self.roots is None:
            return self.rows.withColumn("c", F.col("s"))
        roots = self.roots.withColumnRenamed("node", "s")
        return self.rows.join(small(roots, roots.count()), "s", "left").withColumn("c", F.coalesce("root", "s")).drop("root")

    def run(self) -> None:
        total, pivots = self.rows.count(), PIVOTS
        while True:
            rows = self.placed()
            each = rows.groupBy("g", "c").agg(F.count("*").alias("m"), F.sum(self.early.cast("long")).alias("e"))
            pairs = each.groupBy("g").agg((F.sum("m") * F.sum("e") - F.sum(F.col("m") * F.col("e"))).alias("k"))
            pairs = checkpointed(pairs.filter("k > 0"))
            columns, left = pairs.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0))).first()
            if not left:
                return
            rows = rows.join(small(pairs.select("g"), columns), "g", "left_semi")
            if left <= total:
                return self.last(rows)
            self.block(rows, pivots)
            pivots *= MORE_PIVOTS

    def block(self, rows: DataFrame, most: int) -> None:
        """Multiply with the next pivots of each column, one of each of ``most`` parts, and take them out of it."""
        order = Window.partitionBy("g", F.pmod(F.xxhash64("s", F.lit(most)), F.lit(most))).orderBy(F.desc(self.early), F.desc("d"), F.desc(F.xxhash64("s")))
        rows = checkpointed(rows.withColumn("own", (F.row_number().over(order) == 1) & self.early))
        self.multiply(rows, rows.filter("own"), F.col("own"))
        self.rows = rows.filter("not own").drop("own", "c")
        release(rows.sparkSession)

    def last(self, rows: DataFrame) -> None:
        """Multiply all that is left."""
        self.multiply(rows, rows.filter(self.early), self.early)

    def multiply(self, rows: DataFrame, pivots: DataFrame, own: Column) -> None:
        """Multiply the rows with the pivots of their columns; ``own`` tells which rows are pivots, which meet each other once."""
        names = ("n", "pos", "r")
        pivots = pivots.select("g", *[F.col(k).alias(f"p{k}") for k in (*names, "s", "c")])
        reach = can_reach({k: F.col(k) for k in names}, {k: F.col(f"p{k}") for k in names}, self.percent)
        self.add(rows.join(pivots, "g").filter((F.col("c") != F.col("pc")) & (~own | (F.col("s") < F.col("ps"))) & reach).select("s", "n", "ps", "pn"))

    def add(self, met: DataFrame) -> None:
        """Add the products (s, n, ps, pn), each of one column, to the overlap counts; settle the pairs that reach their bound."""
        now = met.groupBy(F.least("s", "ps").alias("a"), F.greatest("s", "ps").alias("b")).agg(F.first(needed(F.col("n"), F.col("pn"), self.percent)).alias("least"), F.count("*").alias("k"))
        if self.counts is not None:
            now = now.unionByName(self.counts).groupBy("a", "b").agg(F.first("least").alias("least"), F.sum("k").alias("k"))
        now = checkpointed(now)
        self.counts = now.filter("k < least")
        reached = now.filter("k >= least").select("a", "b")
        if reached.limit(1).count():
            found = checkpointed(self.compared(reached))
            self.links = found if self.links is None else self.links.unionByName(found)
            self.roots = checkpointed(components(self.links))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        n = pairs.count()

        def at(side: str) -> DataFrame:
            sets = self.sets.select(F.col("s").alias(side), F.col("n").alias(f"n_{side}"), F.col("x").alias(f"x_{side}"))
            return sets.join(F.broadcast(pairs.select(side).distinct()), side, "left_semi") if n <= BROADCAST_ROWS else sets

        full = at("b").join(small(pairs, n), "b").join(at("a"), "a")
        both = F.size(F.array_intersect("x_a", "x_b"))
        return full.filter(100 * both >= self.percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, th, n_shingles, component_id, node, c) for each row of ``docs``.

    ``id`` and ``th`` are the row's doc_id and the hash of its text; node is its
    set of shingles (rows with equal nodes have equal sets), c its component's smallest node.
    """
    arrow_batches(docs.sparkSession)
    spark, own = docs.sparkSession, docs.select("doc_id", "text")
    nodes = checkpointed(_prefixes(own, words, percent))
    columns = nodes.filter("s is not null").select("s", "n", F.posexplode("prefix").alias("pos", "g"))
    # Columns of several nodes, each node once; m rows have the column.
    all_rows, in_order = Window.partitionBy("g"), Window.partitionBy("g").orderBy("s")
    marked = columns.withColumns({"before": F.lag("s").over(in_order), "s0": F.min("s").over(all_rows), "s1": F.max("s").over(all_rows), "m": F.count("*").over(all_rows)})
    met = checkpointed(marked.filter("s0 < s1 and (before is null or before < s)").select("g", "s", "n", "pos", "m"))
    slim = checkpointed(nodes.select("id", "th", "s", "n"))
    del nodes, columns, marked
    release(spark)
    # The other set may be smaller, by the similarity at most.
    smallest = F.ceil(percent * F.col("n") / 100)
    # Rows that meet most others come first as pivots.
    own_rows = Window.partitionBy("s")
    ranked = met.withColumns({"k": F.count("*").over(own_rows), "d": F.sum("m").over(own_rows), "r": F.row_number().over(own_rows.orderBy("pos")) - 1})
    rows = checkpointed(ranked.filter(F.col("k") >= least_shared(smallest, percent)).select("g", "s", "n", "pos", "r", "d"))
    del met
    release(spark)
    enough = checkpointed(rows.select("s").distinct())
    n_enough = enough.count()
    active = slim.join(small(enough, n_enough), "s", "left_semi").groupBy("s").agg(F.min(F.struct("id", "th")).alias("k"))
    wanted = small(active.select(F.col("k.id").alias("_i"), F.col("k.th").alias("_t")), n_enough)
    sets = checkpointed(_sets(own.join(wanted, F.col("doc_id").eqNullSafe(F.col("_i")) & (_text_hash() == F.col("_t")), "left_semi"), words))
    if sets.count() > n_enough:  # rows that repeat doc_id and text
        sets = checkpointed(sets.dropDuplicates(["s"]))
    release(spark)
    product = _Product(rows, sets, percent)
    del rows, sets
    product.run()
    roots, product = product.roots, None
    release(spark)
    if roots is not None:
        slim = slim.join(small(roots.withColumnRenamed("node", "s"), roots.count()), "s", "left").withColumn("c", F.coalesce("root", "s"))
    else:
        slim = slim.withColumn("c", F.col("s"))
    slim = checkpointed(slim.select("id", "th", F.col("n").alias("n_shingles"), F.col("s").alias("node"), "c"))
    # Only components of several rows look up their least id; materialised, so that the join may split a large one.
    several = checkpointed(slim.filter("c is not null").groupBy("c").agg(F.min("id").alias("least"), F.count("*").alias("m")).filter("m > 1").select("c", "least"))
    return slim.join(small(several, several.count()), "c", "left").select("id", "th", "n_shingles", "node", F.coalesce("least", "id").alias("component_id"), "c")


def similarity_components(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``op9``."""
    return similar_groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (null last), then the smallest text hash. Wordless rows all stay."""
    groups = similar_groups(docs, words, percent).filter("c is not null").select("id", "th", "c")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    first = groups.groupBy("c").agg(F.min(order).alias("k"), F.count("*").alias("m"))
    several = checkpointed(first.filter("m > 1").select("c", F.col("k.id").alias("first_id"), F.col("k.th").alias("first_th")))
    members = checkpointed(groups.join(small(several, several.count()), "c"))
    kept = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    gone = members.filter(~kept).select("id", "th").distinct()
    gone = checkpointed(gone.select(F.col("id").alias((at := fresh(docs, "id", "th"))[0]), F.col("th").alias(at[1])))
    out = docs.join(small(gone, gone.count()), quoted("doc_id").eqNullSafe(F.col(at[0])) & (_text_hash() == F.col(at[1])), "left_anti")
    repeated = members.filter(kept).groupBy("c").count().filter("count > 1").limit(1).count()
    return _without_repeats(out) if repeated else out


def _without_repeats(docs: DataFrame) -> DataFrame:
    """Of rows equal in doc_id and text one stays, unless they have no words."""
    th, o, least_o, i, t = fresh(docs, "th", "order", "least", "id", "hash")
    named = docs.withColumns({th: _text_hash(), o: F.xxhash64(F.struct(*[quoted(c).cast("string") for c in docs.columns if c != "text"]))})
    worded = F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    least = named.filter(worded).groupBy("doc_id", th).agg(F.min(o).alias(least_o), F.count("*").alias("m")).filter("m > 1").select(F.col("doc_id").alias(i), F.col(th).alias(t), least_o)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(th) == F.col(t))
    rest = named.join(least, same, "left_anti")
    one = named.join(least, same & (F.col(o) == F.col(least_o)), "left_semi").dropDuplicates(["doc_id", th])
    return rest.unionByName(one).select(*[quoted(c) for c in docs.columns])
