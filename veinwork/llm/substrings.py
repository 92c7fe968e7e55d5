"""Suffix-array dedup: every byte inside a string of ``LENGTH`` bytes that also starts elsewhere goes.

Sorting a suffix for every byte would move a text hundreds of times. Instead
each start position belongs to a cell: the run of neighbouring positions whose
window has the same anchor (the gram of ``GRAM`` bytes with the least hash in
it). Equal strings have equal anchors at equal offsets, so only cells that
share an anchor can hold repeated strings. An anchor with one distinct cell is
settled by counting. Where an anchor has several distinct cells, one copy of each
is compared: positions fall into ``BANDS`` by their distance from the anchor, all
strings of a band share a window, and bands whose window no other cell has drop
out. The suffixes at the positions left are sorted: sampled splitters
range-partition them by their leading tokens (hashes of half a string each, and
then their place, so that equal suffixes may span partitions), each partition
sorts by multikey quicksort and compares neighbours, and the first and last
suffixes of all partitions are compared across the boundaries.

All strings of a cell overlap, so what a cell loses is one range, from the
first to the last repeated position.

Cases: null and empty texts have no bytes and lose none, like all texts shorter
than ``LENGTH``; matches never cross rows; rows that repeat are copies of each
other, so all their strings are repeated; a null doc_id is a row like any
other; runs of one byte are strings that overlap themselves and go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinwork.llm.common import BATCH_ROWS, arrow_batches, checkpointed, release, row_key, sheltered, without
from veinwork.llm.shingles import mix, prefix_hash, range_hash

LENGTH = 400
GRAM = 100
BANDS = 4
#: Suffixes that a range holds on average at most; a task sorts one range in its memory.
RANGE_SUFFIXES = 1_000_000
#: Runs of suffixes of at most so many are sorted by all their tokens at once.
SHORT_RUN = 2048
#: Rows in which a range of suffixes hands on what it found.
SHARES = 1024
#: Sides of at most so many ranges are broadcast; larger ones meet by a shuffle.
BROADCAST_RANGES = 2_000_000
_U = np.uint64


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, in linear time."""
    n = len(v)
    blocks = np.full(-(-n // width) * width, np.iinfo(v.dtype).max, v.dtype)
    blocks[:n] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def cells(text: str | None, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, cell hash, first and last start position, and anchor position of each cell of a text."""
    codes = _codes(text)
    if len(codes) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    s = prefix_hash(codes)
    start = np.arange(len(codes) - gram + 1)
    g = range_hash(s, start, start + gram)
    least = sliding_least(((g >> _U(32)) << _U(32)) | start.astype(_U), length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    anchor = (least[first] & _U(0xFFFFFFFF)).astype(np.int64)
    shape = (anchor - first).astype(_U) * _U(0x9E3779B97F4A7C15) + (last - first).astype(_U)
    return g[anchor].view(np.int64), mix(range_hash(s, first, last + length) + mix(shape)).view(np.int64), first, last, anchor


def suffix_tokens(text: str | None, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The two leading tokens of the suffixes at ``starts``: hashes of their first and second half string."""
    s, half = prefix_hash(_codes(text)), length // 2
    return range_hash(s, starts, starts + half).view(np.int64), range_hash(s, starts + half, starts + length).view(np.int64)


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: the order that sorts by the first token, then equal ones by the next token, and so on.

    A run is split in three by a pivot's token at the run's depth: what is less
    and what is greater stay at that depth, what equals it goes one token on.
    """
    order = np.arange(len(keys[0]))
    runs = [(0, len(order), 0)]
    while runs:
        a, b, depth = runs.pop()
        if b - a < 2 or depth == len(keys):
            continue
        own = order[a:b]
        if b - a <= SHORT_RUN:
            order[a:b] = own[np.lexsort([k[own] for k in reversed(keys[depth:])])]
            continue
        key = keys[depth][own]
        pivot = np.partition(key[:: max(1, len(key) // 127)], 63)[63]
        less, more = key < pivot, key > pivot
        low, high = own[less], own[more]
        same = own[~(less | more)]
        order[a:b] = np.concatenate([low, same, high])
        x, y = a + len(low), b - len(high)
        runs += [(a, x, depth), (x, y, depth + 1), (y, b, depth)]
    return order


def _all_cells(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, fp, cell, lo, hi, p) for every cell of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(j, BATCH_ROWS)
                found = [cells(t, length, gram) for t in part.column(1).to_pylist()]
                counts = [len(x[0]) for x in found]
                key = part.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                joined = [np.concatenate([x[c] for x in found]) if found else np.empty(0, np.int64) for c in range(5)]
                yield pa.RecordBatch.from_arrays([key, *(pa.array(x.astype(np.int64)) for x in joined)], names=["k", "fp", "cell", "lo", "hi", "p"])

    slim = docs.select(row_key().alias("k"), "text").filter(F.octet_length("text") >= length)
    return slim.mapInArrow(run, T.StructType([slim.schema["k"], *(T.StructField(c, T.LongType()) for c in ("fp", "cell", "lo", "hi", "p"))]))


def _positions(cells_: list, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the cell, start and band of every position of the cells (lo, hi, p, and optionally a mask of bands)."""
    lo, hi, p = (np.array([c[x] for c in cells_], np.int64) for x in ("lo", "hi", "p"))
    n = hi - lo + 1
    which = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    return which, start, (p[which] - start) // _band_width(length, gram)


def _band_width(length: int, gram: int) -> int:
    return -(-(length - gram + 1) // BANDS)


def _with_cells(docs: DataFrame, wanted: DataFrame, ranges: int) -> DataFrame:
    """(text, cells) of the rows that ``wanted`` (k, cells) names."""
    wanted = wanted.select(F.col("k.id").alias("_i"), F.col("k.th").alias("_t"), "cells")
    slim = docs.select(row_key().alias("_k"), "text")
    return slim.join(F.broadcast(wanted) if ranges <= BROADCAST_RANGES else wanted, F.col("_k.id").eqNullSafe(F.col("_i")) & (F.col("_k.th") == F.col("_t"))).select("text", "cells")


def _bands(met: DataFrame, length: int, gram: int) -> DataFrame:
    """(cell, band, key): the window that all strings of a band share, for each band of each cell."""
    width = _band_width(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                which, _, band = _positions(own, length, gram)
                both = np.unique(which * BANDS + band)
                which, band = both // BANDS, both % BANDS
                start = np.array([c["p"] for c in own], np.int64)[which] - band * width
                key = mix(range_hash(prefix_hash(_codes(text)), start, start + length - width + 1) + band.astype(_U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([c["cell"] for c in own], np.int64)[which]), pa.array(band), pa.array(key)], names=["cell", "band", "key"])

    return met.mapInArrow(run, "cell long, band long, key long")


def _suffixes(met: DataFrame, length: int, gram: int) -> DataFrame:
    """(t1, t2, cell, off): the suffixes at all positions of the cells' bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                which, start, band = _positions(own, length, gram)
                kept = (np.array([c["bands"] for c in own], np.int64)[which] >> band) & 1 > 0
                which, start = which[kept], start[kept]
                t1, t2 = suffix_tokens(text, start, length)
                off = start - np.array([c["lo"] for c in own], np.int64)[which]
                yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(np.array([c["cell"] for c in own], np.int64)[which]), pa.array(off)], names=["t1", "t2", "cell", "off"])

    return met.mapInArrow(run, "t1 long, t2 long, cell long, off long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of suffixes: its first and last one (edge 1 and 2, with tokens), and the repeated positions found.

    A cell's suffixes are spread over all ranges, so what is found leaves in
    ``SHARES`` rows of arrays (cells, firsts, lasts), not in a row for each cell.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t1, t2, cell, off = (np.concatenate([b.column(c).to_numpy() for b in tables]) for c in range(4))
    del tables
    order = multikey_order([t1, t2])
    t1, t2, cell, off = t1[order], t2[order], cell[order], off[order]
    same = (t1[1:] == t1[:-1]) & (t2[1:] == t2[:-1])
    repeated = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    c, o = cell[repeated], off[repeated]
    by = np.lexsort((o, c))
    c, o = c[by], o[by]
    at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
    end = np.concatenate([at[1:], [len(c)]]) - 1 if len(c) else at
    found = [c[at], o[at], o[end]]
    share = (found[0].view(_U) % _U(SHARES)).astype(np.int64)
    by = np.argsort(share, kind="stable")
    cuts = np.searchsorted(share[by], np.arange(SHARES + 1)).astype(np.int32)
    some = np.flatnonzero(np.diff(cuts)).tolist()
    edges = [0, len(t1) - 1]
    sizes = np.concatenate([[0], np.diff(cuts)[some], [1, 1]])
    offsets = pa.array(np.cumsum(sizes).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[by], (cell if j == 0 else off)[edges]]))) for j, x in enumerate(found)]
    zeros = [0] * len(some)
    numbers = [some + [-1, -1], zeros + [1, 2], zeros + t1[edges].tolist(), zeros + t2[edges].tolist()]
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *lists], names=["share", "edge", "t1", "t2", "cells", "firsts", "lasts"])


_COMPARED = "share long, edge long, t1 long, t2 long, cells array<long>, firsts array<long>, lasts array<long>"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, first, last): the least and the greatest repeated position of each cell, over all ranges."""
    held: list[list[np.ndarray]] = [[], [], []]
    for b in batches:
        for j, own in enumerate(held):
            own.append(b.column(j).flatten().to_numpy())
    cell, first, last = (np.concatenate([np.empty(0, np.int64), *own]) for own in held)
    if not len(cell):
        return
    cells_, at = np.unique(cell, return_inverse=True)
    low = np.full(len(cells_), np.iinfo(np.int64).max)
    high = np.full(len(cells_), -1)
    np.minimum.at(low, at, first)
    np.maximum.at(high, at, last)
    yield pa.RecordBatch.from_arrays([pa.array(cells_), pa.array(low), pa.array(high)], names=["cell", "first", "last"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k, spans): for each row that has any, the byte ranges to remove (start, end), merged."""
    arrow_batches(docs.sparkSession)
    every = _all_cells(docs, length, gram)
    shared = every.groupBy("fp").agg(F.count("*").alias("n"), F.min("cell").alias("c0"), F.max("cell").alias("c1")).filter("n > 1")
    shared = checkpointed(shared.select("fp", (F.col("c0") != F.col("c1")).alias("mixed")))
    n_shared = shared.count()
    own = checkpointed(every.join(F.broadcast(shared) if n_shared <= BROADCAST_RANGES else shared, "fp"))
    release(docs.sparkSession)
    distinct = own.filter("mixed").groupBy("fp", "cell").agg(F.count("*").alias("n"), F.min(F.struct("k", "lo", "hi", "p")).alias("r"))
    distinct = checkpointed(distinct.select("cell", "n", F.col("r.k").alias("k"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), F.col("r.p").alias("p")))
    n_distinct = distinct.count()
    wanted = distinct.groupBy("k").agg(F.collect_list(F.struct("cell", "lo", "hi", "p")).alias("cells"))
    bands = checkpointed(_bands(_with_cells(docs, wanted, n_distinct), length, gram))
    twice = bands.groupBy("key").agg(F.min("cell").alias("c0"), F.max("cell").alias("c1")).filter("c0 <> c1").select("key")
    masks = bands.join(twice, "key").groupBy("cell").agg(F.bit_or(F.pow(F.lit(2), F.col("band")).cast("long")).alias("bands"))
    kept = checkpointed(distinct.join(masks, "cell").select("k", F.struct("cell", "lo", "hi", "p", "bands").alias("c")))
    wanted = kept.groupBy("k").agg(F.collect_list("c").alias("cells"))
    n_kept, n_suffixes = kept.agg(F.count("*"), F.coalesce(F.sum(F.col("c.hi") - F.col("c.lo") + 1), F.lit(0))).first()
    suffixes = _suffixes(_with_cells(docs, wanted, n_kept), length, gram)
    release(docs.sparkSession)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_suffixes // RANGE_SUFFIXES)
    compared = checkpointed(suffixes.repartitionByRange(parts, "t1", "t2", "cell", "off").mapInArrow(_compare, _COMPARED))
    release(docs.sparkSession)
    edges = compared.filter("edge > 0").select("edge", "t1", "t2", *[F.get(f"{c}s", F.lit(0)).alias(c) for c in ("cell", "first", "last")])
    # Two rows for each range. Ranges that share a suffix have it at their edges; one suffix that is both edges counts once.
    across = edges.groupBy("t1", "t2").agg(F.countDistinct("cell", "first").alias("m")).filter("m > 1").select("t1", "t2")
    across = edges.join(across, ["t1", "t2"]).select("cell", "first", "last")
    found = compared.filter("edge = 0").select("share", "cells", "firsts", "lasts").repartition(parts, "share").select("cells", "firsts", "lasts").mapInArrow(_gathered, "cell long, first long, last long")
    found = found.unionByName(across).groupBy("cell").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    whole = distinct.filter("n > 1").select("cell", F.lit(True).alias("whole"))
    result = found.join(whole, "cell", "full_outer").select("cell", "first", "last", F.coalesce("whole", F.lit(False)).alias("whole"))
    result = checkpointed(result)
    met = own.filter("mixed").join(F.broadcast(result) if result.count() <= BROADCAST_RANGES else result, "cell")
    partly = met.select("k", F.when(F.col("whole"), F.col("lo")).otherwise(F.col("lo") + F.col("first")).alias("start"), (F.when(F.col("whole"), F.col("hi")).otherwise(F.col("lo") + F.col("last")) + length).alias("end"))
    wholly = own.filter("not mixed").select("k", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    each = partly.unionByName(wholly).groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return each.mapInArrow(_merged, T.StructType([each.schema["k"], T.StructField("spans", _SPANS)]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring cells give ranges that overlap: few are left of each row's."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        spans = [[{"start": x, "end": y} for x, y in merge(own)] for own in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["k", "spans"])


def merge(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = ("n_bytes", "n_removed", "removed_spans", "kept")


@sheltered("doc_id", "text")
def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``removed_spans`` (merged byte ranges) and ``kept``.

    ``kept`` holds the remaining bytes, which may end within a character; with
    ``digest`` it is their SHA-256 in hex.
    """
    docs = without(docs, RESULT)
    spans = checkpointed(repeated_ranges(docs.select("doc_id", "text"), length, gram))
    spans = spans.select(F.col("k.id").alias("_i"), F.col("k.th").alias("_t"), F.col("spans").alias("_spans"))
    ranges = spans.agg(F.sum(F.size("_spans"))).first()[0] or 0
    met = docs.withColumn("_k", row_key()).join(F.broadcast(spans) if ranges <= BROADCAST_RANGES else spans, F.col("_k.id").eqNullSafe(F.col("_i")) & (F.col("_k.th") == F.col("_t")), "left").drop("_k", "_i", "_t")
    at = met.columns.index("_spans")
    kind = T.StringType() if digest else T.BinaryType()
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", _SPANS), T.StructField("kept", kind)]
    text_at = [c.lower() for c in met.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(j, BATCH_ROWS)
                sizes, removed, merged_, kept = [], [], [], []
                for text, own in zip(part.column(text_at).to_pylist(), part.column(at).to_pylist()):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    gone = merge(own)
                    last, left = 0, []
                    for a, b in gone:
                        left.append(data[last:a])
                        last = b
                    rest = b"".join([*left, data[last:]])
                    sizes.append(len(data))
                    removed.append(len(data) - len(rest))
                    merged_.append([{"start": a, "end": b} for a, b in gone])
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string() if digest else pa.binary())]
                old = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*(n for n in part.schema.names if n != "_spans"), *(f.name for f in fields)])

    return met.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def substring_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``op10``."""
    found = remove_repeated(docs.select("doc_id", "text"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))

