"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks (the input's partitions). How many of a block's rows go to
each shard is one cell of a matrix with given row sums (the blocks' sizes) and
column sums (the shards' sizes); in a uniform shuffle it follows the
multivariate hypergeometric law, and is drawn from it. Each block then permutes
its rows and deals its first ones to shard 0, the next ones to shard 1, and so
on; after the exchange each shard permutes what it got. All of this is
DataFrame code; only the blocks' sizes and the matrix, of at most
``BLOCKS`` x shards numbers however large the input is, are on the driver.

Orders are by hashes of a row's place (partition and position) and a seed, so
one layout of the input gives one result, and equal rows, of any number, don't
meet. Places are written down once (``checkpointed``) before they are used: a
lost executor can't change them.

Cases: an empty table gives an empty result. With fewer rows than shards, the last
shards stay empty. A null text has no bytes (and the checksum 0, as an empty text has). A
null or repeated doc_id and rows equal in all columns are rows like others.
Further columns play no part in ``shard_digest``; ``shuffled`` passes them
through, and replaces one named ``shard`` or ``slot``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.common import checkpointed, fresh, quoted, without

#: Partitions beyond so many share blocks.
BLOCKS = 1024
#: A shard's order is made in so many parts, ranges of its random keys.
PARTS = 64


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard: row sums are ``sizes``, column sums at most one apart."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    left = np.array([total // shards + (q < total % shards) for q in range(shards)], np.int64)
    out = np.zeros((len(sizes), shards), np.int64)
    for k, size in enumerate(sizes):
        rest = int(left.sum())
        for q in range(shards - 1):  # one shard after the other, given those before
            others = rest - int(left[q])
            out[k, q] = _hypergeometric(rng, int(left[q]), others, size - int(out[k, :q].sum()))
            rest = others
        out[k, -1] = size - int(out[k, :-1].sum())
        left -= out[k]
    return out


#: numpy's generator takes urns below 10^9.
URN = 500_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement.

    For larger urns than the generator takes: inversion over the mode and 12 standard deviations around it, from the
    ratios of neighbouring probabilities. What lies beyond has less than 1e-30 of the probability, far below the
    generator's resolution of 2^-53.
    """
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if good < URN and bad < URN:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = int(12 * (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5) + 40
    k = np.arange(max(0, draws - bad, mode - spread), min(good, draws, mode + spread) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[1:]) - np.log(bad - draws + k[1:])
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(weights - weights.max()))
    return int(k[np.searchsorted(below, rng.random() * below[-1], side="right")])


def shuffled(rows: DataFrame, shards: int, seed: int = 12) -> DataFrame:
    """``rows`` with ``shard`` (int from 0) and ``slot`` (long, gapless from 0 in each shard); shards differ by one row at most."""
    if not 1 <= shards <= 100_000:
        raise ValueError("shards have to be from 1 to 100,000")
    rows = without(rows, ["shard", "slot"])
    names = rows.columns
    block, place, rank, dealt, key, part, k, before = fresh(rows, "block", "place", "rank", "dealt", "key", "part", "k", "before")
    placed = checkpointed(rows.withColumn(block, F.spark_partition_id() % BLOCKS).withColumn(place, F.monotonically_increasing_id()))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(block).count().collect())  # at most BLOCKS rows
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    ends = placed.sparkSession.createDataFrame([(b, [int(x) for x in ends]) for (b, _), ends in zip(sizes, matrix.cumsum(axis=1))], f"`{block}` int, `{dealt}` array<long>")
    local = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), place), place)
    sent = placed.withColumn(rank, F.row_number().over(local)).join(F.broadcast(ends), block)
    sent = sent.withColumn("shard", F.size(F.filter(dealt, lambda x: x < F.col(rank)))).withColumn(key, F.xxhash64(F.lit(seed + 1), place)).withColumn(part, F.shiftright(key, 58))
    sent = checkpointed(sent.select(*[quoted(c) for c in names], "shard", part, key, place))
    counts = sent.groupBy("shard", part).count()
    offset = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", part, offset.alias(before))  # at most shards x PARTS rows
    ordered = sent.withColumn(k, F.row_number().over(Window.partitionBy("shard", part).orderBy(key, place)))
    joined = ordered.join(F.broadcast(starts) if shards * PARTS <= 65_536 else starts, ["shard", part])
    return joined.select(*[quoted(c) for c in names], F.col("shard").cast("int").alias("shard"), (F.col(k) + F.col(before) - 1).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Where each document goes, with its size (UTF-8 bytes and 8) and the checksum of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(narrow, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int, seed: int = 12) -> None:
    """Write whole rows as one folder a shard, each in the order of its slots."""
    shuffled(docs, shards, seed).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
