"""Pairs of rows with similar names within a block, decided between distinct names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions.text import fold, folded_likely_same, folded_words
from veinwork.operators.relational import once

#: Rows of one name that meet others in one group of a join; more of them are dealt to several.
SHARE = 1000


def _word_pairs(words: Column) -> Column:
    """Each two words of a name as one key, in code-point order."""
    key = lambda x, y: F.concat_ws("\n", F.least(x, y), F.greatest(x, y))
    return F.flatten(F.transform(words, lambda x, k: F.transform(F.slice(words, k + 2, F.size(words)), lambda y: key(x, y))))


def similar_pairs(rows: DataFrame, key: str, name: str, block: str) -> DataFrame:
    """(id, other_id) of rows of one block, the smaller key first, whose names are likely the same.

    Names are compared once for each two distinct ones that share two words (of different names, a repeated word of the first counts as
    often as it stands there). Rows then meet by names: the work beyond the names is that of writing the pairs down.
    """
    own = once(rows.select(F.col(key).alias("id"), F.col(block).alias("block"), F.col(name).alias("name")), folded=fold(F.col("name"))).select("id", "block", "folded")
    own = own.filter("block is not null and folded is not null")
    names = own.groupBy("block", "folded").agg(F.count("*").alias("n")).withColumn("shares", F.ceil(F.col("n") / SHARE))
    words = once(names.select("block", "folded"), words=folded_words(F.col("folded")))
    a = words.select("block", F.col("folded").alias("x"), F.explode(F.array_distinct(_word_pairs(F.col("words")))).alias("k"))
    twice = F.transform("words", lambda w: F.concat_ws("\n", w, w))
    b = words.select("block", F.col("folded").alias("y"), F.explode(F.array_distinct(F.concat(_word_pairs(F.col("words")), twice))).alias("k"))
    alike = a.join(b, ["block", "k"]).filter("x <> y").select("block", "x", "y").distinct().filter(folded_likely_same(F.col("x"), F.col("y")))
    links = alike.unionByName(names.filter("n > 1").select("block", F.col("folded").alias("x"), F.col("folded").alias("y")))
    shares = names.select("block", F.col("folded").alias("x"), "shares")
    first = own.withColumnRenamed("folded", "x").join(shares, ["block", "x"]).select("block", "x", F.pmod(F.hash("id"), "shares").alias("share"), "id")
    other = own.select("block", F.col("folded").alias("y"), F.col("id").alias("other_id")).join(links.join(shares, ["block", "x"]), ["block", "y"])
    other = other.select("block", "x", "other_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    return first.join(other, ["block", "x", "share"]).filter("id < other_id").select("id", "other_id")
