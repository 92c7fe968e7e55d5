"""The directory over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.operators.directory import SORTS, DirectoryQuery, counts, filtered, page, relevance, without_false_positives
from veinwork.plans.base import query
from veinwork.sources.tables import candidates, sources, with_

SEARCH = "building"
WHERE = """duplicate_of IS NULL AND (contains(lower(full_name), 'building') OR current_role_ ILIKE '%building%' OR city ILIKE '%building%' OR country ILIKE '%building%' OR summary ILIKE '%building%'
 OR len(list_filter(tags, lambda t: t ILIKE '%building%')) > 0 OR len(list_filter(email, lambda t: t ILIKE '%building%')) > 0 OR len(list_filter(phone, lambda t: t ILIKE '%building%')) > 0)"""
TIER = "CASE WHEN lower(current_role_) = 'building' THEN 6 WHEN list_contains(tags, 'building') THEN 9 ELSE 30 END"


@query(with_("candidates", f"SELECT id, full_name, tier FROM (SELECT *, {TIER} AS tier FROM candidates WHERE {WHERE}) ORDER BY tier, full_name, id LIMIT 50 OFFSET 20"))
def directory_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(candidates(spark, sf_dir), DirectoryQuery(search=SEARCH, sort="name", offset=20)).select("id", "full_name", "tier")


@query(with_("candidates", f"SELECT count(*) FILTER (WHERE {WHERE}) AS total, count(*) FILTER (WHERE duplicate_of IS NULL) AS database_total FROM candidates"))
def directory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(candidates(spark, sf_dir), DirectoryQuery(search=SEARCH))


@query(with_("candidates", """
SELECT id, CASE WHEN contains(lower(full_name), '11') THEN 3 WHEN len(list_filter(email, lambda e: contains(lower(e), '11'))) > 0 OR len(list_filter(phone, lambda p: contains(p, '11'))) > 0 THEN 5
 WHEN contains(lower(city), '11') THEN 10 WHEN contains(summary, '11') THEN 20 ELSE 30 END AS tier FROM candidates"""))
def directory_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("id", relevance("11").cast("int").alias("tier"))


@query(with_("candidates", "SELECT id FROM candidates WHERE duplicate_of IS NULL AND country ILIKE 'asia' AND len(email) > 0 AND len(phone) > 0 ORDER BY updated_at NULLS LAST, id LIMIT 100"))
def directory_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(candidates(spark, sf_dir), DirectoryQuery(country="asia", contact="both", sort="oldest", limit=500)).select("id")


@query(with_("candidates", "SELECT country, count(*) AS people, count(*) FILTER (WHERE len(phone) > 0) AS with_phone FROM candidates WHERE duplicate_of IS NULL GROUP BY country"))
def directory_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(candidates(spark, sf_dir), DirectoryQuery()).groupBy("country").agg(F.count("*").alias("people"), F.count_if(F.size("phone") > 0).alias("with_phone"))


_LATEST = ", l AS (SELECT candidate_id AS id, max(source_created_at) AS latest_at FROM sources WHERE is_active AND source_id % 3 = 0 GROUP BY 1), c AS (SELECT c.*, latest_at FROM candidates c LEFT JOIN l USING (id) WHERE duplicate_of IS NULL)"
_ORDERS = {"quality": "quality_score DESC", "updated": "updated_at DESC NULLS LAST", "recent": "latest_at DESC NULLS LAST", "oldest": "latest_at NULLS LAST", "name": "full_name", "name_desc": "full_name DESC"}


@query(with_("candidates sources", _LATEST + " " + " UNION ALL ".join(f"SELECT '{n}' AS sort, id, position FROM (SELECT id, row_number() OVER (ORDER BY {o}, id) AS position FROM c) WHERE position <= 100" for n, o in _ORDERS.items())))
def directory_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page in each of the six sorts; undated rows come last in both that go by date."""
    latest = sources(spark, sf_dir).filter("is_active and source_id % 3 = 0").groupBy(F.col("candidate_id").alias("id")).agg(F.max("source_created_at").alias("latest_at"))
    rows, out = candidates(spark, sf_dir).join(latest, "id", "left"), None
    for name, (order, column) in SORTS.items():
        top = page(rows, DirectoryQuery(sort=name, limit=100))
        place = F.row_number().over(Window.orderBy(order(column), "id")).cast("long")
        top = top.select(F.lit(name).alias("sort"), "id", place.alias("position"))
        out = top if out is None else out.unionByName(top)
    return out


@query(with_("candidates", """
SELECT id FROM candidates WHERE CASE WHEN id % 2 = 0 THEN id % 14 IN (8, 10, 12) ELSE id % 14 <> 13 END"""))
def directory_without_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the people come by mail, with every kind of mistake among them; one kind of name is nobody's wherever it comes from."""
    k, kind = F.col("id"), F.col("id") % 14
    c = candidates(spark, sf_dir)
    name = F.when(kind == 0, "Google Cloud Team").when(kind == 2, "RE: hola").when(kind == 4, "Solicitud de empleo").when(kind == 13, "Perfil profesional").when((kind == 1) | (kind == 3), "Google Cloud Team").otherwise(F.col("full_name"))
    bare = kind == 6
    c = c.withColumns({"full_name": name, "email": F.when(bare, F.array().cast("array<string>")).otherwise(F.array(F.lit("a@b.example"))), "phone": F.array().cast("array<string>"), "summary": F.when(bare, "A Security Alert").otherwise(F.col("summary")), "current_role": F.when(kind == 5, "work account access").otherwise(F.col("current_role"))})
    came = c.select(k.alias("candidate_id"), F.when(k % 2 == 0, "mail").otherwise("board").alias("source_type"))
    # Those whose document is a system's are left out, too.
    documents = c.filter("id % 2 = 0 and id % 14 not in (8, 10, 12)").select(k.alias("candidate_id"), F.lit("mail").alias("source_type"), F.lit("Your request for work account access").alias("raw_text"), F.lit("x.txt").alias("file_name"))
    own = documents.filter("candidate_id % 14 = 0")
    texts = own.unionByName(documents.filter("candidate_id % 14 in (2, 4)").withColumn("raw_text", F.lit("plain")))
    return without_false_positives(c, came, texts).select("id")
