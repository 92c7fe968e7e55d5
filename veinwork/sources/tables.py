"""Domain tables over a folder of Parquet tables, and the same mapping as SQL text.

``candidates``, ``sources`` and ``contents`` are projections that push down to
the scans. ``CTE`` holds each of them as SQL, for checking results elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Results must not depend on the clock: every age is taken against this instant.
AS_OF = "2001-09-01 00:00:00"
SOURCE_TYPES = ("mail", "board", "upload", "partner")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, full_name, current_role, city, country, quality_score, duplicate_of, status, email, phone, tags, summary, updated_at)"""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 4
    digits = F.lpad((k * 7919 % 10000000).cast("string"), 7, "0")
    shared = F.concat(F.lit("shared"), F.floor(k / 10).cast("string"), F.lit("@mail.example"))
    own = F.concat(F.lit("p"), k.cast("string"), F.lit("@Mail.example"))
    none = F.array().cast("array<string>")
    return (
        t("customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("id"),
            F.col("c_name").alias("full_name"),
            F.col("c_mktsegment").alias("current_role"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100).cast("int"))).alias("quality_score"),
            F.when(k % 31 == 30, k - 1).alias("duplicate_of"),
            F.when(k % 29 == 0, "needs_review").when(k % 29 == 1, "rejected").otherwise("active").alias("status"),
            F.when(kind == 1, F.array(own)).when(kind == 2, F.array(own, shared)).when(kind == 3, F.array(shared)).otherwise(none).alias("email"),
            F.when(kind == 0, F.array(F.concat(F.lit("09"), digits))).when(kind == 1, F.array(F.concat(F.lit("+598 9"), digits))).when(kind == 3, F.array(F.lit("1234567890123"), F.concat(F.lit("09"), digits))).otherwise(none).alias("phone"),
            F.array(F.lower("c_mktsegment"), F.lower("n_name")).alias("tags"),
            F.concat(F.lit("Profile of "), F.col("c_name"), F.lit(" in "), F.col("n_name")).alias("summary"),
            F.timestamp_add("MINUTE", k % 5000, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("updated_at"),
        )
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, source_type, source_id, source_created_at, is_active)"""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderpriority").alias("source_type"),
        F.col("o_orderkey").alias("source_id"),
        F.col("o_orderdate").alias("source_created_at"),
        (F.col("o_orderstatus") != "P").alias("is_active"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, candidate_id, raw_text, lang, source_type, file_name, mime_type, is_primary, processed_at, attempts, error, created_at)"""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = F.col("doc_id")
    created = F.timestamp_add("HOUR", d % 20000, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            d.alias("id"),
            (d % 300).alias("candidate_id"),
            F.col("text").alias("raw_text"),
            "lang",
            F.element_at(F.array(*[F.lit(s) for s in SOURCE_TYPES]), (d % 4 + 1).cast("int")).alias("source_type"),
            F.concat(F.lit("file-"), d.cast("string"), F.when(d % 3 == 0, ".pdf").when(d % 3 == 1, ".docx").otherwise(".txt")).alias("file_name"),
            F.when(d % 3 == 0, "application/pdf").when(d % 3 == 1, "application/msword").alias("mime_type"),
            (F.coalesce("quality", F.lit(0)) == 1).alias("is_primary"),
            F.when(d % 5 != 0, created).alias("processed_at"),
            (d % 7).cast("int").alias("attempts"),
            F.when(d % 11 == 0, "HTTP 404 not found").when(d % 11 == 1, "timeout after 30 s").when(d % 11 == 2, "HTTP 403 forbidden").when(d % 11 == 3, "no text layer").alias("error"),
            created.alias("created_at"),
        )
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, candidate_id, file_name, raw_text) of ``contents``: a projection of the scan alone, so that whole texts meet no other table."""
    d = F.col("doc_id")
    name = F.concat(F.lit("file-"), d.cast("string"), F.when(d % 3 == 0, ".pdf").when(d % 3 == 1, ".docx").otherwise(".txt"))
    return table(spark, sf_dir, "documents").select(d.alias("id"), (d % 300).alias("candidate_id"), name.alias("file_name"), F.col("text").alias("raw_text"))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, candidate_id, is_primary) of ``contents``, without texts."""
    best = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(best, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 300).alias("candidate_id"), (F.coalesce("quality", F.lit(0)) == 1).alias("is_primary"))


CTE = {
    "candidates": """candidates AS (
  SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS current_role_, n_name AS city, r_name AS country,
         CAST(least(100, greatest(0, floor(c_acctbal / 100))) AS INTEGER) AS quality_score,
         CASE WHEN c_custkey % 31 = 30 THEN c_custkey - 1 END AS duplicate_of,
         CASE WHEN c_custkey % 29 = 0 THEN 'needs_review' WHEN c_custkey % 29 = 1 THEN 'rejected' ELSE 'active' END AS status,
         CASE c_custkey % 4 WHEN 1 THEN ['p' || c_custkey || '@Mail.example']
              WHEN 2 THEN ['p' || c_custkey || '@Mail.example', 'shared' || (c_custkey // 10) || '@mail.example']
              WHEN 3 THEN ['shared' || (c_custkey // 10) || '@mail.example'] ELSE CAST([] AS VARCHAR[]) END AS email,
         CASE c_custkey % 4 WHEN 0 THEN ['09' || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0')]
              WHEN 1 THEN ['+598 9' || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0')]
              WHEN 3 THEN ['1234567890123', '09' || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0')] ELSE CAST([] AS VARCHAR[]) END AS phone,
         [lower(c_mktsegment), lower(n_name)] AS tags,
         'Profile of ' || c_name || ' in ' || n_name AS summary,
         TIMESTAMP '2001-01-01 00:00:00' + to_minutes(c_custkey % 5000) AS updated_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)""",
    "sources": """sources AS (
  SELECT o_custkey AS candidate_id, o_orderpriority AS source_type, o_orderkey AS source_id, o_orderdate AS source_created_at, o_orderstatus <> 'P' AS is_active FROM orders
)""",
    "contents": """contents AS (
  SELECT d.doc_id AS id, d.doc_id % 300 AS candidate_id, text AS raw_text, lang,
         (['mail', 'board', 'upload', 'partner'])[CAST(d.doc_id % 4 + 1 AS INTEGER)] AS source_type,
         'file-' || d.doc_id || CASE d.doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.txt' END AS file_name,
         CASE d.doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/msword' END AS mime_type,
         coalesce(quality, 0) = 1 AS is_primary,
         CASE WHEN d.doc_id % 5 <> 0 THEN TIMESTAMP '2000-01-01 00:00:00' + to_hours(d.doc_id % 20000) END AS processed_at,
         CAST(d.doc_id % 7 AS INTEGER) AS attempts,
         CASE d.doc_id % 11 WHEN 0 THEN 'HTTP 404 not found' WHEN 1 THEN 'timeout after 30 s' WHEN 2 THEN 'HTTP 403 forbidden' WHEN 3 THEN 'no text layer' END AS error,
         TIMESTAMP '2000-01-01 00:00:00' + to_hours(d.doc_id % 20000) AS created_at
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
)""",
}


def with_(names: str, body: str) -> str:
    """``body`` after the named common table expressions."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body.strip()
