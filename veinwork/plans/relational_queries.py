"""Filters, joins, aggregates, windows and sorts over candidates, their sources and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinwork.operators.identity import keepers
from veinwork.operators.ordering import group_positions
from veinwork.operators.relational import first_by, keep_first, later_duplicates, numbered, shift_null_last, slice_page
from veinwork.plans.base import query
from veinwork.sources.tables import AS_OF, candidates, contents, sources, table, with_

LIVE = "duplicate_of IS NULL AND status = 'active'"


@query(with_("candidates", f"""
SELECT id, full_name, current_role_ AS role, city, country, quality_score FROM candidates
WHERE {LIVE} AND country = 'EUROPE' AND current_role_ ILIKE 'building' AND len(email) > 0"""))
def live_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows, an equality, a case-insensitive equality and a contact filter, all before any shuffle."""
    c = candidates(spark, sf_dir).filter(LIVE).filter((F.col("country") == "EUROPE") & F.col("current_role").ilike("building") & (F.size("email") > 0))
    return c.select("id", "full_name", F.col("current_role").alias("role"), "city", "country", "quality_score")


@query(with_("candidates sources", f"""
SELECT id, full_name FROM candidates c WHERE {LIVE}
AND EXISTS (SELECT 1 FROM sources s WHERE s.candidate_id = c.id AND s.is_active AND s.source_type IN ('1-URGENT', '2-HIGH'))"""))
def source_filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).filter(F.col("is_active") & F.col("source_type").isin("1-URGENT", "2-HIGH"))
    return candidates(spark, sf_dir).filter(LIVE).join(s, F.col("id") == F.col("candidate_id"), "left_semi").select("id", "full_name")


@query(with_("candidates sources", f"""
SELECT id FROM candidates c WHERE EXISTS (SELECT 1 FROM sources s WHERE s.candidate_id = c.id AND s.is_active
AND s.source_created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)"""))
def recency_filter_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS")
    s = sources(spark, sf_dir).filter(F.col("is_active") & (F.col("source_created_at") >= since))
    return candidates(spark, sf_dir).join(s, F.col("id") == F.col("candidate_id"), "left_semi").select("id")


@query(with_("candidates", f"SELECT id, city FROM candidates WHERE {LIVE} AND (city ILIKE '%a%' OR country ILIKE '%europe%')"))
def location_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).filter(LIVE).filter(F.col("city").ilike("%a%") | F.col("country").ilike("%europe%")).select("id", "city")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@query(with_("candidates contents", """
SELECT id FROM candidates c WHERE EXISTS (SELECT 1 FROM contents d WHERE d.candidate_id = c.id AND (d.mime_type ILIKE '%pdf%' OR d.file_name ILIKE '%.pdf'))
AND EXISTS (SELECT 1 FROM contents d WHERE d.candidate_id = c.id)"""))
def document_format_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = contents(spark, sf_dir).filter(F.col("mime_type").ilike("%pdf%") | F.col("file_name").ilike("%.pdf"))
    return candidates(spark, sf_dir).join(pdf.select("candidate_id"), F.col("id") == F.col("candidate_id"), "left_semi").select("id")


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.missing') IS NULL AND props <> '{}'""")
def json_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    e = table(spark, sf_dir, "events").filter(F.array_contains(keys, "k") & ~F.array_contains(keys, "missing") & (F.col("props") != "{}"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
SELECT event_id, 'limit' AS key, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT event_id, 'api_' || CASE event_id % 3 WHEN 0 THEN 'Token' WHEN 1 THEN 'password' ELSE 'sessionCookie' END, '********' FROM events
UNION ALL SELECT event_id, 'keywords', event_type FROM events""")
def masked_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under keys that name secrets are masked; allowed keys that only look like one pass."""
    k = F.col("event_id")
    secret = F.concat(F.lit("api_"), F.when(k % 3 == 0, "Token").when(k % 3 == 1, "password").otherwise("sessionCookie"))
    config = F.create_map(F.lit("limit"), F.get_json_object("props", "$.k"), secret, F.lit("x1"), F.lit("keywords"), F.col("event_type"))
    hidden = lambda n: n.rlike("(?i)password|token|secret|cookie|session|key") & ~n.isin("keywords")
    masked = F.transform_values(config, lambda n, v: F.when(hidden(n), F.lit("********")).otherwise(v))
    return table(spark, sf_dir, "events").select("event_id", F.explode(masked).alias("key", "value"))


@query(with_("candidates contents sources", f"""
, counts AS (SELECT candidate_id, count(*) AS documents FROM contents GROUP BY 1),
best AS (SELECT candidate_id, id AS document_id FROM contents QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY is_primary DESC, created_at DESC, id DESC) = 1),
src AS (SELECT candidate_id, count(DISTINCT source_type) AS n_sources, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types, max(source_created_at) AS latest FROM sources WHERE is_active GROUP BY 1)
SELECT c.id, c.full_name, c.quality_score, coalesce(documents, 0) AS documents, document_id, coalesce(n_sources, 0) AS n_sources, coalesce(source_types, '') AS source_types, latest,
       row_number() OVER (ORDER BY c.quality_score DESC, c.updated_at DESC, c.id) AS position
FROM candidates c LEFT JOIN counts ON counts.candidate_id = c.id LEFT JOIN best ON best.candidate_id = c.id LEFT JOIN src ON src.candidate_id = c.id
WHERE c.{LIVE.replace(' AND ', ' AND c.')} ORDER BY position LIMIT 300"""))
def hydrate_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ids first, then enrichment of those rows by sides that are aggregated before they join."""
    order = [F.col("quality_score").desc(), F.col("updated_at").desc(), F.col("id")]
    asked = candidates(spark, sf_dir).filter(LIVE).orderBy(*order).limit(300)
    docs = contents(spark, sf_dir)
    counts = docs.groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias("documents"))
    best = first_by(docs.withColumnRenamed("candidate_id", "key"), ["key"], [~F.col("is_primary"), -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("id")], F.col("id"), "document_id").withColumnRenamed("key", "id")
    src = sources(spark, sf_dir).filter("is_active").groupBy(F.col("candidate_id").alias("id"))
    src = src.agg(F.countDistinct("source_type").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"), F.max("source_created_at").alias("latest"))
    rows = asked.join(counts, "id", "left").join(best, "id", "left").join(src, "id", "left")
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return rows.select("id", "full_name", "quality_score", F.coalesce("documents", F.lit(0)).alias("documents"), "document_id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("source_types", F.lit("")).alias("source_types"), "latest", "position")


@query(with_("contents", """
SELECT candidate_id, count(*) AS documents, arg_min(file_name, (NOT is_primary, -epoch_us(created_at), -id)) AS file_name, arg_min(source_type, id) AS first_source,
       array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types, max(created_at) AS newest
FROM contents GROUP BY candidate_id"""))
def listing_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing shows for each candidate, as one aggregation instead of a subquery for each value."""
    order = F.struct((~F.col("is_primary")).alias("a"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("b"), (-F.col("id")).alias("c"))
    return contents(spark, sf_dir).groupBy("candidate_id").agg(
        F.count("*").alias("documents"),
        F.min_by("file_name", order).alias("file_name"),
        F.min_by("source_type", "id").alias("first_source"),
        F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"),
        F.max("created_at").alias("newest"),
    )


@query(with_("candidates contents", """
SELECT c.id, d.id AS document_id, length(d.raw_text) AS n_chars FROM candidates c
JOIN (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY is_primary DESC, created_at DESC, id DESC) AS n FROM contents WHERE raw_text IS NOT NULL) d ON d.candidate_id = c.id AND n = 1"""))
def primary_doc_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's best text: the top row of a lateral join, as a minimum by order over slim columns."""
    d = contents(spark, sf_dir).filter("raw_text is not null").withColumn("n_chars", F.char_length("raw_text").cast("long"))
    best = first_by(d, ["candidate_id"], [~F.col("is_primary"), -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("id")], F.struct(F.col("id").alias("document_id"), "n_chars"), "b")
    return candidates(spark, sf_dir).join(best, F.col("id") == F.col("candidate_id")).select("id", "b.document_id", "b.n_chars")


@query(with_("candidates", """
, e AS (SELECT id, lower(unnest(email)) AS address FROM candidates), f AS (SELECT address, min(id) AS first_id, count(DISTINCT id) AS people FROM e GROUP BY address HAVING count(DISTINCT id) > 1)
SELECT DISTINCT e.id, first_id, people FROM e JOIN f USING (address)"""))
def contact_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array overlap between rows as an equi-join of exploded values: each row with the first one of every value it shares, so that a common value gives no pairs."""
    e = candidates(spark, sf_dir).select("id", F.explode("email").alias("address")).withColumn("address", F.lower("address")).distinct()
    first = e.groupBy("address").agg(F.min("id").alias("first_id"), F.count("*").alias("people")).filter("people > 1")
    return e.join(first, "address").select("id", "first_id", "people").distinct()


@query(with_("candidates", """
, p AS (SELECT id, regexp_replace(unnest(phone), '[^0-9]', '', 'g') AS digits FROM candidates),
k AS (SELECT id, CASE WHEN length(digits) < 7 THEN '' WHEN length(digits) = 11 AND starts_with(digits, '598') THEN '0' || substr(digits, 4) ELSE digits END AS phone_key FROM p)
SELECT phone_key, count(DISTINCT id) AS people, min(id) AS first_id FROM k WHERE phone_key <> '' GROUP BY phone_key"""))
def phone_identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veinwork.functions.text import phone_identity

    k = candidates(spark, sf_dir).select("id", F.explode("phone").alias("p")).withColumn("phone_key", phone_identity(F.col("p"))).filter("phone_key <> ''")
    return k.groupBy("phone_key").agg(F.countDistinct("id").alias("people"), F.min("id").alias("first_id"))


@query(with_("sources contents", """
SELECT s.source_type, count(DISTINCT s.candidate_id) AS people, count(DISTINCT d.id) AS documents, count(DISTINCT s.source_id) AS records
FROM sources s LEFT JOIN contents d ON d.candidate_id = s.candidate_id AND (s.source_id % 4 = d.id % 4) GROUP BY s.source_type"""))
def source_doc_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts over a join that fans out, with both keys in the join."""
    s = sources(spark, sf_dir).withColumn("part", F.col("source_id") % 4)
    d = contents(spark, sf_dir).select(F.col("candidate_id").alias("c"), (F.col("id") % 4).alias("p"), F.col("id").alias("document_id"))
    j = s.join(d, (F.col("candidate_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return j.groupBy("source_type").agg(F.countDistinct("candidate_id").alias("people"), F.countDistinct("document_id").alias("documents"), F.countDistinct("source_id").alias("records"))


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h, source, n_chars, substr(text, 1, 60) AS head FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, 'h' || h AS k FROM d UNION ALL SELECT doc_id, 's' || source || '/' || n_chars FROM d UNION ALL SELECT doc_id, 't' || head FROM d WHERE length(head) = 60),
f AS (SELECT k, min(doc_id) AS first_id FROM k GROUP BY k)
SELECT DISTINCT k.doc_id, f.first_id AS other_id FROM k JOIN f USING (k) WHERE f.first_id < k.doc_id""")
def document_identity_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same document by hash, or by source and size, or by its opening: each row with the first one of every key it shares."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    head = F.substring("text", 1, 60)
    keys = F.array_compact(F.array(F.concat(F.lit("h"), F.sha2("text", 256)), F.concat(F.lit("s"), "source", F.lit("/"), "n_chars"), F.when(F.char_length(head) == 60, F.concat(F.lit("t"), head))))
    each = d.select("doc_id", F.explode(F.transform(keys, lambda k: F.md5(k))).alias("k"))
    first = each.groupBy("k").agg(F.min("doc_id").alias("other_id"), F.count("*").alias("n")).filter("n > 1").select("k", "other_id")
    return each.join(first, "k").filter("other_id < doc_id").select("doc_id", "other_id").distinct()


#: Passages that are broadcast, in bytes at most.
PASSAGE_BYTES = 64 << 20


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage: candidates share the passage's rarest-looking word, then containment decides."""
    words = lambda c: F.array_distinct(F.split(c, "[ \\t-\\r]+"))
    items = table(spark, sf_dir, "benchmark").filter("text is not null").withColumnRenamed("text", "passage")
    inner = F.slice(F.split("passage", "[ \\t-\\r]+"), 2, F.greatest(F.lit(0), F.size(F.split("passage", "[ \\t-\\r]+")) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    keyed = items.withColumn("key", longest)
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    size = keyed.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    if size > PASSAGE_BYTES:
        raise ValueError(f"{size} bytes of passages are more than a task may hold ({PASSAGE_BYTES}); search in parts")
    # Words without texts meet the keys; then texts are read once more, by the few rows that are left.
    by_word = docs.select("doc_id", F.explode(words(F.col("text"))).alias("key")).join(F.broadcast(keyed.filter("key is not null").select("item_id", "key")), "key").select("doc_id", "item_id").distinct()
    met = docs.join(by_word, "doc_id").join(F.broadcast(keyed.select("item_id", "passage")), "item_id").filter(F.contains("text", "passage"))
    short = docs.join(F.broadcast(keyed.filter("key is null").select("item_id", "passage")), F.contains("text", "passage"))
    return met.select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id")).distinct()


@query(with_("sources", """
SELECT candidate_id, count(DISTINCT source_type) FILTER (WHERE is_active) AS active_types, count(DISTINCT source_type) AS all_types,
       coalesce(array_to_string(list_sort(list(DISTINCT source_type) FILTER (WHERE is_active)), ','), '') AS active_list, max(source_created_at) FILTER (WHERE is_active) AS latest
FROM sources GROUP BY candidate_id"""))
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.when(F.col("is_active"), F.col("source_type"))
    return sources(spark, sf_dir).groupBy("candidate_id").agg(
        F.size(F.collect_set(active)).cast("long").alias("active_types"),
        F.size(F.collect_set("source_type")).cast("long").alias("all_types"),
        F.array_join(F.array_sort(F.collect_set(active)), ",").alias("active_list"),
        F.max(F.when(F.col("is_active"), F.col("source_created_at"))).alias("latest"),
    )


FUNNEL = {
    "total": "TRUE",
    "searchable": "length(raw_text) >= 80",
    "pending": "processed_at IS NULL",
    "unreadable": "processed_at IS NOT NULL AND length(raw_text) < 80",
    "unavailable": "error LIKE 'HTTP%'",
    "processing": "processed_at IS NULL AND attempts = 1",
    "retrying": "processed_at IS NULL AND attempts > 1",
}


@query(with_("contents", "SELECT source_type, " + ", ".join(f"count(*) FILTER (WHERE {p}) AS {n}" for n, p in FUNNEL.items()) + " FROM contents GROUP BY source_type"))
def extraction_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).groupBy("source_type").agg(*[F.count_if(F.expr(p)).alias(n) for n, p in FUNNEL.items()])


@query(with_("candidates contents", f"""
SELECT count(*) AS candidates, count(*) FILTER (WHERE id IN (SELECT candidate_id FROM contents)) AS with_document, count(*) FILTER (WHERE len(email) > 0) AS with_email,
       count(*) FILTER (WHERE len(phone) > 0) AS with_phone, count(*) FILTER (WHERE quality_score >= 50) AS good FROM candidates WHERE {LIVE}"""))
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = contents(spark, sf_dir).select(F.col("candidate_id").alias("id")).distinct().withColumn("has", F.lit(True))
    c = candidates(spark, sf_dir).filter(LIVE).join(has, "id", "left")
    return c.agg(F.count("*").alias("candidates"), F.count_if(F.col("has")).alias("with_document"), F.count_if(F.size("email") > 0).alias("with_email"), F.count_if(F.size("phone") > 0).alias("with_phone"), F.count_if(F.col("quality_score") >= 50).alias("good"))


DOCUMENT = {
    "documents": "TRUE",
    "empty": "nullif(trim(raw_text), '') IS NULL",
    "readable": "length(trim(raw_text)) >= 80",
    "typed": "mime_type IS NOT NULL",
    "primary_docs": "is_primary",
}


@query(with_("contents", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {p}) AS {n}" for n, p in DOCUMENT.items()) + " FROM contents"))
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).agg(*[F.count_if(F.expr(p)).alias(n) for n, p in DOCUMENT.items()])


@query(with_("contents", "SELECT source_type, count(*) AS unreadable, max(attempts) AS attempts FROM contents WHERE length(raw_text) < 400 GROUP BY source_type ORDER BY unreadable DESC, source_type"))
def unreadable_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contents(spark, sf_dir).filter(F.char_length("raw_text") < 400)
    return d.groupBy("source_type").agg(F.count("*").alias("unreadable"), F.max("attempts").alias("attempts")).orderBy(F.desc("unreadable"), "source_type")


@query(with_("contents", """
SELECT source_type, CASE WHEN error IS NULL THEN 'none' WHEN error ILIKE '%404%' THEN 'missing' WHEN error ILIKE '%403%' OR error ILIKE '%401%' THEN 'denied' WHEN error ILIKE '%timeout%' THEN 'timeout' WHEN error ILIKE '%text%' THEN 'no_text' ELSE 'other' END AS category, count(*) AS documents
FROM contents GROUP BY 1, 2"""))
def error_category_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("error")
    category = F.when(e.isNull(), "none").when(e.ilike("%404%"), "missing").when(e.ilike("%403%") | e.ilike("%401%"), "denied").when(e.ilike("%timeout%"), "timeout").when(e.ilike("%text%"), "no_text").otherwise("other")
    return contents(spark, sf_dir).groupBy("source_type", category.alias("category")).agg(F.count("*").alias("documents"))


@query("""
SELECT event_type, count(*) AS events, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS keyed, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least, max(ts) AS latest FROM events GROUP BY event_type""")
def json_key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(k.isNotNull()).alias("keyed"), F.min(k.cast("long")).alias("least"), F.max("ts").alias("latest"))


@query(with_("candidates contents", """
SELECT (SELECT count(*) FROM candidates) AS candidates, (SELECT count(*) FROM contents) AS documents, (SELECT coalesce(sum(strlen(raw_text)), 0) FROM contents) AS text_bytes,
       (SELECT count(*) FROM contents WHERE processed_at IS NULL) AS queued"""))
def storage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contents(spark, sf_dir).agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("raw_text")), F.lit(0)).alias("text_bytes"), F.count_if(F.col("processed_at").isNull()).alias("queued"))
    return candidates(spark, sf_dir).agg(F.count("*").alias("candidates")).crossJoin(d)


@query("SELECT date_trunc('day', ts) AS day, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS done, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, count(DISTINCT user_id) AS users, round(sum(value), 4) AS worth FROM events GROUP BY 1")
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return e.agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("worth"))


@query("""
SELECT doc_id, position, keeper, copies FROM (
  SELECT doc_id, row_number() OVER w AS position, first_value(doc_id) OVER w AS keeper, count(*) OVER (PARTITION BY lang, sha256(text)) AS copies
  FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY lang, sha256(text) ORDER BY n_chars DESC NULLS LAST, doc_id)) WHERE position > 1""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of one content with the row that is kept; windows see hashes, not texts."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    return later_duplicates(d, ["lang", "h"], [F.col("n_chars").desc_nulls_last(), F.col("doc_id")], F.col("doc_id")).select("doc_id", "position", "keeper", "copies")


@query(with_("contents candidates", """
, evidence AS (
  SELECT c.id, c.quality_score, c.updated_at, 'same_text' AS kind, sha256(d.raw_text) AS key FROM contents d JOIN candidates c ON c.id = d.candidate_id WHERE d.raw_text IS NOT NULL
  UNION ALL SELECT id, quality_score, updated_at, 'same_email', lower(unnest(email)) FROM candidates
), one AS (SELECT DISTINCT * FROM evidence),
w AS (SELECT *, count(*) OVER (PARTITION BY kind, key) AS n, first_value(id) OVER (PARTITION BY kind, key ORDER BY quality_score DESC, updated_at DESC, id) AS keeper FROM one)
SELECT id, keeper, kind FROM w WHERE n > 1 AND id <> keeper QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind DESC, keeper) = 1"""))
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (duplicate, keeper) from two kinds of evidence; text evidence wins over addresses."""
    c = candidates(spark, sf_dir).select("id", "quality_score", "updated_at", "email")
    by_text = contents(spark, sf_dir).filter("raw_text is not null").select(F.col("candidate_id").alias("id"), F.sha2("raw_text", 256).alias("key")).join(c, "id").withColumn("kind", F.lit("same_text"))
    by_mail = c.select("*", F.explode("email").alias("e")).withColumns({"key": F.lower("e"), "kind": F.lit("same_email")})
    cols = ["id", "quality_score", "updated_at", "kind", "key"]
    one = by_text.select(*cols).unionByName(by_mail.select(*cols)).distinct()
    best = [-F.col("quality_score"), -F.unix_micros(F.col("updated_at").cast("timestamp")), F.col("id")]
    found = keepers(one, ["kind", "key"], best, "id")
    return first_by(found, ["id"], [F.col("kind") != "same_text", F.col("keeper")], F.struct("keeper", "kind"), "b").select("id", "b.*")


@query("""
SELECT doc_id % 300 AS candidate_id, doc_id, hits FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '(^|[^a-z])(que|los|por)([^a-z]|$)')) AS hits FROM documents)
WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id % 300 ORDER BY hits DESC, doc_id) = 1""")
def best_match_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("candidate_id"), "doc_id", F.regexp_count(F.lower("text"), F.lit("(^|[^a-z])(que|los|por)([^a-z]|$)")).cast("long").alias("hits")).filter("hits > 0")
    return keep_first(d, ["candidate_id"], [F.col("hits").desc(), F.col("doc_id")])


@query(with_("candidates", "SELECT country, id, row_number() OVER (PARTITION BY country ORDER BY quality_score DESC, id) AS rank_position FROM candidates"))
def rank_position_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results numbered from 1 within their country; few countries hold all rows, so numbers come from ranges, not from a window over each."""
    return group_positions(candidates(spark, sf_dir).select("country", "id", "quality_score"), ["country"], [F.col("quality_score").desc(), F.col("id")], "rank_position").drop("quality_score")


@query("""
SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events)
WHERE n <= 50 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY""")
def retention_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 50 of each kind that are no older than 20 days."""
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    kept = numbered(e, ["event_type"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()], "n").filter("n <= 50")
    return kept.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 20 DAYS")).select("event_id", "event_type")


@query("""
SELECT o_custkey AS candidate_id, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate DESC NULLS LAST, o_orderkey), ',') AS orders FROM orders GROUP BY o_custkey""")
def child_lists_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows as an ordered list for each parent."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("candidate_id"))
    keyed = F.struct(shift_null_last(-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("d"), F.col("o_orderkey").alias("k"))
    listed = F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["k"].cast("string"))
    return o.agg(F.array_join(listed, ",").alias("orders"))


@query(with_("candidates", "SELECT id, row, (SELECT count(*) FROM candidates) AS total, (SELECT count(*) FROM candidates) > 50 AS has_more FROM (SELECT id, row_number() OVER (ORDER BY quality_score DESC, id) AS row FROM candidates) WHERE row BETWEEN 26 AND 50"))
def slice_page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_page(candidates(spark, sf_dir).select("id", "quality_score"), [F.col("quality_score").desc(), F.col("id")], 2, 25).select("id", "row", "total", "has_more")


@query(with_("candidates", "SELECT id, full_name FROM candidates WHERE id > 40 ORDER BY id LIMIT 25"))
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).filter("id > 40").orderBy("id").limit(25).select("id", "full_name")


@query("SELECT event_type, count(*) AS events, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS place FROM events GROUP BY event_type ORDER BY place, event_type")
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events")).withColumn("place", place).orderBy("place", "event_type")
