"""Relational building blocks: first-by-order, OR joins, duplicate pairs, retention, directory relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row.

    They come out of a generator of one row. As plain projections they would be
    substituted into every expression and pushed-down filter that names them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def first_by(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``value`` of each key's first row in a total order; one aggregation, combined before the shuffle.

    ``order`` gives ascending sort keys (negate or invert to descend); nulls sort first.
    """
    ranked = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], value.alias("v"))
    return df.groupBy(*keys).agg(F.min(ranked)["v"].alias(name))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: each group's first row."""
    return numbered(df, by, order, "_n").filter("_n = 1").drop("_n")


def later_duplicates(df: DataFrame, by: list[str], order: list[Column], keep: Column) -> DataFrame:
    """Rows that duplicate an earlier one of their group, with the kept row's ``keep`` and the group's size."""
    w = Window.partitionBy(*by)
    ranked = df.withColumns({"position": F.row_number().over(w.orderBy(*order)).cast("long"), "keeper": F.first(keep).over(w.orderBy(*order)), "copies": F.count("*").over(w)})
    return ranked.filter("position > 1")


def shift_null_last(c: Column) -> Column:
    """Sort key that puts nulls after all values, ascending."""
    return F.struct(c.isNull().alias("n"), c.alias("v"))


def slice_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page by row number, with the total and whether more follow; size is held within 10..100."""
    size = min(100, max(10, size))
    page = max(1, page)
    top = page * size
    first = df.orderBy(*order).limit(top)  # a top-k: no global sort of all rows
    total = df.agg(F.count("*").alias("total"))
    rows = first.withColumn("row", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("row") > top - size)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > top)


#: Tables of at most so many bytes for each core may be dealt anew: larger ones have a split of a file for each.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows dealt to all cores before heavy work on them; one that is larger, or has files for all cores, stays as it is."""
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path
    size = sum(path(f).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path(f)).getLen() for f in files)
    return df.repartition(cores) if size <= SPREAD_BYTES * cores else df


#: A side of ids of at most so many rows may be sent to all executors.
FEW_ROWS = 4_000_000


def few(ids: DataFrame, rows: int) -> DataFrame:
    """A side of ids that is broadcast if its ``rows`` are few, else meets the other side by a shuffle."""
    return F.broadcast(ids) if rows <= FEW_ROWS else ids
