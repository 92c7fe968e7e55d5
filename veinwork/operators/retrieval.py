"""Retrieval of candidates by text, merging of passes, and hydration of the few that are ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions.text import plain
from veinwork.operators.relational import first_by, once, spread
from veinwork.operators.textindex import TextIndex

MOST = 300


def padded_words(text: Column) -> Column:
    """The folded words with a space on either side of each."""
    return F.concat(F.lit(" "), F.regexp_replace(plain(text), "[^\\p{L}\\p{N}]+", " "), F.lit(" "))


def group_hits(padded: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """How many groups have a term among the padded words."""
    one = lambda g: reduce(lambda a, b: a | b, [F.contains(padded, F.lit(f" {t} ")) for t in g])
    return reduce(lambda a, b: a + b, [one(g).cast("int") for g in groups], F.lit(0))


def indexed_matches(index: TextIndex, docs: DataFrame, groups: tuple[tuple[str, ...], ...], most: int = MOST) -> DataFrame:
    """(candidate_id, document_id, hits): each candidate's best document that holds a term of any group; the top ones.

    Read from the postings of the terms; no text is read. ``docs`` (id, candidate_id, is_primary) meets the hits alone.
    """
    scored = index.hits(groups).join(docs.select("id", "candidate_id", "is_primary"), "id")
    best = first_by(scored, ["candidate_id"], [-F.col("hits"), ~F.col("is_primary"), F.col("id")], F.struct(F.col("id").alias("document_id"), "hits"), "b")
    return best.select("candidate_id", "b.*").orderBy(F.desc("hits"), "candidate_id").limit(most)


def document_matches(texts: DataFrame, docs: DataFrame, groups: tuple[tuple[str, ...], ...], most: int = MOST) -> DataFrame:
    """(candidate_id, document_id, hits): each candidate's best document that holds a term of any group; the top ones.

    The same as ``indexed_matches`` by a scan of all texts, for texts without an index.
    ``texts`` has id, candidate_id and raw_text; ``docs`` tells which are primary, and meets the hits alone.
    """
    own = spread(texts.filter("raw_text is not null").select("id", "candidate_id", "raw_text"))
    words = once(own, _words=padded_words(F.col("raw_text")))
    hits = once(words, hits=group_hits(F.col("_words"), groups)).filter("hits > 0").select("id", "candidate_id", "hits")
    scored = hits.join(docs.select("id", "is_primary"), "id")
    best = first_by(scored, ["candidate_id"], [-F.col("hits"), ~F.col("is_primary"), F.col("id")], F.struct(F.col("id").alias("document_id"), "hits"), "b")
    return best.select("candidate_id", "b.*").orderBy(F.desc("hits"), "candidate_id").limit(most)


def profile_matches(candidates: DataFrame, groups: tuple[tuple[str, ...], ...], most: int = MOST) -> DataFrame:
    text = padded_words(F.concat_ws(" ", "full_name", "current_role", "city", "country", "summary", F.array_join("tags", " ")))
    found = once(once(candidates, _words=text), hits=group_hits(F.col("_words"), groups)).filter("hits > 0")
    return found.orderBy(F.desc("hits"), F.desc("quality_score"), F.desc("updated_at"), "id").limit(most).select(F.col("id").alias("candidate_id"), F.lit(None).cast("long").alias("document_id"), "hits")


def merged_matches(passes: list[DataFrame], most: int = MOST) -> DataFrame:
    """The best rank of each candidate over all passes, and the first document that any of them matched."""
    union = reduce(DataFrame.unionByName, passes)
    best = union.groupBy("candidate_id").agg(F.max("hits").alias("hits"), F.max_by("document_id", F.when(F.col("document_id").isNotNull(), F.col("hits"))).alias("document_id"))
    return best.orderBy(F.desc("hits"), "candidate_id").limit(most)


def hydrate(matches: DataFrame, candidates: DataFrame, texts: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Wide rows of the few matched candidates: what ranking needs, from sides reduced before they join.

    ``matches`` is a top-k of at most a few hundred ids. It is fetched once and
    becomes a literal table: as a plan it would run again for each side.
    """
    top = matches.select("candidate_id", "document_id", "hits")
    few = F.broadcast(matches.sparkSession.createDataFrame(top.collect(), top.schema))
    # Which document is best is told without texts; only the chosen ones' texts are read.
    own = docs.select("candidate_id", "id", "is_primary").join(few, "candidate_id")
    best_id = F.min(F.struct((~F.col("id").eqNullSafe(F.col("document_id"))).alias("x"), (~F.col("is_primary")).alias("y"), "id"))["id"]
    counts = own.groupBy("candidate_id").agg(F.count("*").alias("documents"), best_id.alias("best_id"))
    found = texts.select(F.col("id").alias("best_id"), F.col("file_name").alias("document_name"), F.col("raw_text").alias("document_text"))
    best = found.join(F.broadcast(counts), "best_id").drop("best_id")
    latest = sources.filter("is_active").join(few.select("candidate_id"), "candidate_id", "left_semi").groupBy("candidate_id").agg(F.max("source_created_at").alias("latest"))
    rows = candidates.join(few, F.col("id") == F.col("candidate_id")).drop("document_id")
    rows = rows.join(best, "candidate_id", "left").join(latest, "candidate_id", "left")
    return rows.withColumn("documents", F.coalesce("documents", F.lit(0))).drop("candidate_id")
