"""Connected components of a graph of links, by alternating stars.

Links that fit one task are settled there by union-find. Of more, each task
reduces its batches to forests; then large-star and small-star
steps, each a grouped minimum and a join, hang every node on the smallest of
its component. Nothing is collected; each round is checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import checkpointed


#: So many links fit one task; they are settled there at once. More go through distributed rounds.
ONE_TASK_LINKS = 500_000


def _forest(links: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    """Links from each node to the smallest one of its component, among these links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _forest(_pairs(batch))


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _forest(pair for batch in batches for pair in _pairs(batch))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the smallest node that links reach.

    Self-links and repeated links do no harm; no links give an empty table.
    """
    links = links.select("a", "b").filter("a <> b")
    if links.count() <= ONE_TASK_LINKS:
        return _roots(checkpointed(links.coalesce(1).mapInArrow(_one_forest, "u long, v long")))
    edges = checkpointed(links.mapInArrow(_forests, "u long, v long").distinct())
    seen = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _roots(edges)


def _roots(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


