"""Numbers in a total order, without a window that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.streaming.sinks import checkpoint_folder


def positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``position``, from 0 in this order: ranges are sorted each in its task, then moved by the sizes of those before.

    The order has to be total. ``df`` is written down in between, so ranges can't change under a second reading.
    """
    checkpoint_folder(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    sizes = ranged.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(starts), "_range").withColumn("position", (F.col("_before") + F.col("_local") - 1).cast("long")).drop("_range", "_local", "_before")


def group_positions(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's number, from 1, in the total order of its group; a group of any size is dealt over many tasks."""
    placed = positions(df, *by, *order)
    first = placed.groupBy(*by).agg(F.min("position").alias("_first"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}"))
    out = placed.alias("p").join(first.alias("f"), same)
    return out.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("p.position") - F.col("f._first") + 1).alias(name))
