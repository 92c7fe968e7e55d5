"""Search by postings over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators.postings import matches, parsed, postings, ranked, updated
from veinwork.operators.relational import spread
from veinwork.plans.base import query
from veinwork.sources.tables import table

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' extra word' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL),
w AS (SELECT doc_id, strip_accents(unnest({_WORDS})) AS lexeme FROM t)
SELECT lexeme, count(DISTINCT doc_id) AS documents, count(*) AS places FROM w GROUP BY lexeme""")
def postings_kept_up_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all texts, then of changed ones alone: a third of the texts differ, a seventh is gone."""
    before = _texts(spark, sf_dir)
    after = before.filter("id % 7 <> 0").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" extra word"))).otherwise(F.col("text")))
    kept = updated(postings(before, stemmed=False), before, after, stemmed=False)
    return kept.groupBy("lexeme").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("places"))


@query(f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(list_transform({_WORDS}, lambda w: strip_accents(w)), ' ') || ' ' AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS id FROM d WHERE (contains(x, ' the and ') AND NOT contains(x, ' ti ')) OR (contains(x, ' que ') AND contains(x, ' de la ') AND NOT contains(x, ' el la '))""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, alternatives and refusals, decided by positions."""
    kept = postings(_texts(spark, sf_dir), stemmed=False)
    return matches(kept, parsed('"the and" -ti or que "de la" -"el la"', stemmed=False)).select("id")


@query(f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS p FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, p, strip_accents(w) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n, lag(strip_accents(w)) OVER (PARTITION BY doc_id ORDER BY p) AS before, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS apart FROM w WHERE strip_accents(w) IN ('que', 'los'))
SELECT doc_id AS id, round(sum(0.1 / (1 + apart - 1)), 6) AS rank FROM s WHERE before <> w GROUP BY doc_id""")
def cover_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two terms, ranked by how densely they cover them: each neighbouring pair of different terms is one stretch."""
    kept = postings(_texts(spark, sf_dir), stemmed=False)
    found = matches(kept, parsed("que los", stemmed=False))
    return ranked(found, ["que", "los"]).select("id", F.round("rank", 6).alias("rank"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents WHERE text IS NOT NULL AND lang = 'es')
SELECT 'occurrences' AS what, CAST(count(*) AS BIGINT) AS n FROM w WHERE w NOT IN (SELECT unnest(string_split('de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu tus ellas nosotras vosotros vosotras os es son era eran fue fueron ser soy eres somos sea sean he has ha hemos han haya hayan había habían tengo tiene tienen tenía', ' ')))""")
def spanish_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed postings of the Spanish texts hold every occurrence of every word with a meaning; stems are held against known ones by tests."""
    d = spread(table(spark, sf_dir, "documents").filter("lang = 'es'").select(F.col("doc_id").alias("id"), "text"))
    return postings(d).agg(F.sum(F.size("positions")).alias("n")).select(F.lit("occurrences").alias("what"), "n")
