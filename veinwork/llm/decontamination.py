"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Test strings are windows of consecutive item words. For each window length
there is one table set: a shift for every block of two words (how far the
window may move on before a test string can end), buckets of test strings by
their last block, and a direct comparison of all words that confirms.

Cases: a null or wordless text has no words and no hits; a wordless item has no
windows; an item with fewer words than a window is one window; repeated items
count once by item_id; an item without an id marks words but is not listed;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinwork.llm.common import append_columns, arrow_batches, row_key, sheltered, without

WINDOW = 10
#: Test strings are searched in blocks of so many bytes of item text; one block is what each task holds.
BLOCK_BYTES = 32 << 20

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ") if text else []


class _Length:
    """Tables for the test strings of one length."""

    def __init__(self, m: int, strings: list[tuple[bytes, ...]]):
        self.m, self.block = m, min(2, m)
        self.default = m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p in strings:
            for end in range(self.block - 1, m):
                b = p[end - self.block + 1 : end + 1] if self.block == 2 else p[end]
                self.shift[b] = min(self.shift.get(b, self.default), m - 1 - end)
            self.bucket[p[m - 2 :] if self.block == 2 else p[-1]].append(p)

    def search(self, words: list[bytes], found: list[tuple[int, int, tuple]]) -> None:
        m, n, get, default = self.m, len(words), self.shift.get, self.default
        at = m - 1
        if self.block == 1:
            bucket = self.bucket
            found += [(k, k + 1, (w,)) for k, w in enumerate(words) if w in bucket]
            return
        while at < n:
            move = get((words[at - 1], words[at]), default)
            if move:
                at += move
                continue
            first = words[at - m + 1]
            for p in self.bucket[(words[at - 1], words[at])]:
                if p[0] == first and tuple(words[at - m + 1 : at + 1]) == p:
                    found.append((at - m + 1, at + 1, p))
            at += 1


class WuManber:
    """All test strings of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [w for w in words_of(text) if w]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                self.owners[tuple(words[k : k + window])] |= {str(item)} if item is not None else set()
        by: dict[int, list] = defaultdict(list)
        for p in self.owners:
            by[len(p)].append(p)
        self.tables = [_Length(m, ps) for m, ps in sorted(by.items())]

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """The number of words, the covered word ranges (merged, in order) and the items that occur."""
        words = [w for w in words_of(text) if w]
        found: list = []
        for t in self.tables:
            t.search(words, found)
        return len(words), merged((a, b) for a, b, _ in found), sorted({i for _, _, p in found for i in self.owners[p]})


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))]
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _arrays(found: list) -> dict[str, pa.Array]:
    return {
        "n_words": pa.array([n for n, _, _ in found], pa.int64()),
        "hit_spans": pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], _SPAN_ARROW),
        "hit_items": pa.array([i for _, _, i in found], pa.list_(pa.string())),
    }


@sheltered("doc_id", "text")
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges, end exclusive), ``n_hit`` and ``hit_items`` (ids as sorted strings).

    The benchmark is a stated set of test strings: it is read in blocks of at
    most ``block_bytes`` of text (or one item), each of which is broadcast and
    held against all documents. With more than one block, the hits of the
    blocks meet by document.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = without(docs, ["n_words", "hit_spans", "n_hit", "hit_items"])
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, block_bytes)] or [spark.sparkContext.broadcast([])]

    def scan(frame: DataFrame, sent) -> DataFrame:
        def make():
            search = WuManber(sent.value, window).search
            return lambda texts: _arrays([search(t) for t in texts])

        return append_columns(frame, FIELDS, make)

    if len(blocks) == 1:
        out = scan(docs, blocks[0])
    else:
        slim = docs.select(row_key().alias("_k"), "text").dropDuplicates(["_k"])
        hits = [scan(slim, b).drop("text").filter(F.size("hit_items") + F.size("hit_spans") > 0) for b in blocks]
        union = hits[0]
        for h in hits[1:]:
            union = union.unionByName(h)
        joined = union.groupBy("_k").agg(F.flatten(F.collect_list("hit_spans")).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("_i"))
        out = scan(docs, spark.sparkContext.broadcast([])).withColumn("_k", row_key()).drop("hit_spans", "hit_items").join(joined, "_k", "left")
        spans = F.coalesce("_s", F.array().cast(SPAN))
        out = out.withColumns({"hit_spans": _merge(spans), "hit_items": F.coalesce("_i", F.array().cast("array<string>"))}).drop("_k", "_s", "_i")
    covered = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.withColumn("n_hit", covered)


def _merge(spans):
    """Sorted, merged ranges, with SQL functions."""
    zero = F.struct(F.array().cast(SPAN).alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    span = lambda s, e: F.array(F.struct(s.alias("start"), e.alias("end")))

    def step(acc, s):
        open_ = acc["end"] >= s["start"]
        return F.struct(
            F.when(open_ | (acc["end"] < 0), acc["done"]).otherwise(F.concat(acc["done"], span(acc["start"], acc["end"]))).alias("done"),
            F.when(open_, acc["start"]).otherwise(s["start"]).alias("start"),
            F.when(open_, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"),
        )

    last = lambda acc: F.when(acc["end"] < 0, acc["done"]).otherwise(F.concat(acc["done"], span(acc["start"], acc["end"])))
    return F.aggregate(F.array_sort(spans), zero, step, last)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items block by block; only one block at a time is on the driver while it streams them."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        n = len(r["text"]) * 4
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def contamination_digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``op5``."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
