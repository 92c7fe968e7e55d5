"""Merging incoming rows into stored ones without a MERGE statement: joins, unions and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.operators.relational import keep_first


def merged_rows(stored: DataFrame, incoming: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """One row for each key of either side, with an outcome: new, updated, unchanged or kept.

    ``rules`` says by column how values meet: ``incoming`` (its non-null value
    wins), ``union`` (arrays), ``greatest``, ``or``, or ``stored``.
    """
    a, b = stored.alias("a"), incoming.alias("b")
    meet = {
        "incoming": lambda x, y: F.coalesce(y, x),
        "stored": lambda x, y: F.coalesce(x, y),
        "union": lambda x, y: F.array_sort(F.array_union(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>")))),
        "greatest": lambda x, y: F.greatest(x, y),
        "or": lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)),
    }
    values = {c: meet[r](F.col(f"a.{c}"), F.col(f"b.{c}")) for c, r in rules.items()}
    same = F.lit(True)
    for c in rules:
        same = same & values[c].eqNullSafe(F.array_sort(F.col(f"a.{c}")) if rules[c] == "union" else F.col(f"a.{c}"))
    has_a, has_b = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    outcome = F.when(~has_a, "new").when(~has_b, "kept").when(same, "unchanged").otherwise("updated")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[v.alias(c) for c, v in values.items()], outcome.alias("outcome"))


def one_of_each(df: DataFrame, key: str, arrival: str, last: bool = False) -> DataFrame:
    """First or last arrival of each key."""
    return keep_first(df, [key], [F.col(arrival).desc() if last else F.col(arrival)])


def repointed(children: DataFrame, parent: str, moved: DataFrame) -> DataFrame:
    """``children`` with their parent replaced where ``moved`` (old, new) says so."""
    return children.join(moved.withColumnRenamed("old", parent), parent, "left").withColumn(parent, F.coalesce("new", parent)).drop("new")


def rejected(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that fail with the first failing rule as reason."""
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    named = df.withColumn("reason", reason)
    return named.filter("reason is null").drop("reason"), named.filter("reason is not null")
