"""Who is whom: keepers of duplicates followed to the end, and all that points to a duplicate pointed to its keeper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.merge import repointed
from veinwork.streaming.sinks import checkpoint_folder


def keepers(evidence: DataFrame, by: list[str], order: list[Column], row: str) -> DataFrame:
    """(row, keeper, *by) of every row that shares its evidence with a better one; a group's best row is a minimum, not a window.

    ``order`` gives ascending sort keys of a total order. Groups of any size are combined before they are shuffled, and meet their keeper in a join
    that splits hot groups.
    """
    best = evidence.groupBy(*by).agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(row).alias("keeper")))["keeper"].alias("keeper"), F.count("*").alias("_n"))
    return evidence.join(best.filter("_n > 1"), by).filter(F.col(row) != F.col("keeper")).select(row, "keeper", *by)


def resolved(pairs: DataFrame) -> DataFrame:
    """(old, new) with ``new`` the end of the chain of keepers that begins at ``old``, by pointer jumping.

    Each round doubles the length of the steps, so chains of n links take log2(n) rounds. Of several keepers of one row the smallest counts. Rows
    whose chain ends in a ring take the ring's smallest id, which itself moves nowhere. Pairs of a row with itself
    and null ids count for nothing.
    """
    checkpoint_folder(pairs.sparkSession)
    links = pairs.filter("old <> new").groupBy("old").agg(F.min("new").alias("new")).checkpoint(eager=True)
    now, seen = links, None
    while True:
        ahead = links if seen is None else now
        step = now.join(ahead.select(F.col("old").alias("new"), F.col("new").alias("next")), "new", "left")
        step = step.select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("open")).checkpoint(eager=True)
        now = step.select("old", "new")
        left = step.filter("open").agg(F.count("*"), F.countDistinct("new")).first()
        if left[0] == 0:
            return now
        if tuple(left) == seen:
            break  # as many are open as before, and they end in as many rows: what is open ends in rings
        seen = tuple(left)
    ends = step.filter("open").select(F.col("new").alias("old")).distinct()
    ring = _least_of_rings(ends.join(links, "old", "left_semi").join(links, "old").checkpoint(eager=True))
    open_ = step.filter("open").select("old", "new").join(ring.withColumnRenamed("old", "new"), "new").select("old", F.col("least").alias("new"))
    return step.filter("not open").select("old", "new").unionByName(open_).filter("old <> new")


def _least_of_rings(links: DataFrame) -> DataFrame:
    """(old, least) for rows that all lie on rings: the least of what 2^k steps pass, until nothing changes."""
    now = links.select("old", "new", F.least("old", "new").alias("least"))
    before = None
    while True:
        ahead = now.select(F.col("old").alias("new"), F.col("new").alias("next"), F.col("least").alias("far"))
        now = now.join(ahead, "new").select("old", F.col("next").alias("new"), F.least("least", "far").alias("least")).checkpoint(eager=True)
        total = now.agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return now.select("old", "least")
        before = total


def repoint(children: dict[str, tuple[DataFrame, str]], moved: DataFrame, clashes: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """All child tables with their parents replaced by ``moved`` (old, new: ends of chains).

    ``clashes`` names, for a child table, the columns that make a row unique for one parent (null: never the same): of
    the former owners that had such a row, the keeper, or else the smallest, keeps its own ones; the others' go.
    """
    out = {}
    for name, (rows, parent) in children.items():
        now = repointed(rows.withColumn("_was", F.col(parent)), parent, moved)
        if unique := (clashes or {}).get(name):
            owner = F.min(F.struct((F.col("_was") != F.col(parent)).alias("a"), F.col("_was").alias("b")))["b"].alias("_owner")
            owners = now.dropna(subset=unique).groupBy(parent, *unique).agg(owner)
            met = now.join(owners, [parent, *unique], "left")
            now = met.filter(F.col("_owner").isNull() | (F.col("_owner") == F.col("_was")))
        out[name] = now.select(*rows.columns)
    return out


def merged_keepers(rows: DataFrame, key: str, moved: DataFrame, unions: list[str], greatest: list[str]) -> DataFrame:
    """Each keeper with the union of its group's arrays and the greatest of its numbers; other columns are its own."""
    end = repointed(rows.withColumn("_was", F.col(key)), key, moved)
    gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in unions]
    values = end.groupBy(key).agg(*gathered, *[F.max(c).alias(c) for c in greatest])
    own = rows.drop(*unions, *greatest)
    return own.join(values, key).select(*rows.columns)
