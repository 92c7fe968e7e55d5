"""Text, date and place functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import geo, text
from veinwork.functions.perrow import per_row
from veinwork.functions.profile import references_at, years
from veinwork.functions.dates import backoff_minutes, month_index, recency_bonus, safe_timestamp, union_months
from veinwork.operators.relational import once, spread
from veinwork.operators.similar import similar_pairs
from veinwork.plans.base import query
from veinwork.sources.tables import AS_OF, candidates, contents, table, with_

FOLDED = "trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))"


@query(f"""
SELECT token, count(*) AS documents FROM (
  SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array({FOLDED}, '[^\\pL\\pN]+'), lambda w: length(w) >= 3)) AS token FROM documents)
GROUP BY token ORDER BY documents DESC, token LIMIT 200""")
def fold_tokens_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "token").limit(200)


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'), lambda x: lower(x)))), ',') AS emails FROM documents WHERE text LIKE '%@%'""")
def emails_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")))
    return d.select("doc_id", F.array_join(F.array_sort(text.emails(F.col("text"))), ",").alias("emails"))


@query(with_("candidates", """
, p AS (SELECT id, trim(regexp_replace(unnest(phone), '[^0-9+]+', ' ', 'g')) AS v FROM candidates),
d AS (SELECT id, v, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM p)
SELECT id, array_to_string(list_sort(list(DISTINCT v)), ',') AS phones FROM d
WHERE length(n) BETWEEN 7 AND 15 AND (length(n) <= 9 OR starts_with(n, '598')) AND NOT regexp_matches(n, '^(0*|1*|2*|3*|4*|5*|6*|7*|8*|9*)$')
AND NOT regexp_matches(n, '^(19|20)[0-9]{6}([0-9]{4,6})?$') AND NOT regexp_matches(n, '^(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{6}$') AND NOT regexp_matches(v, '^[0-9]{1,2} ?[0-9]{1,2} ?0{5,}$')
GROUP BY id"""))
def phones_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = candidates(spark, sf_dir).select("id", text.clean_phones(F.col("phone")).alias("p"))
    return p.filter(F.size("p") > 0).select("id", F.array_join(F.array_sort("p"), ",").alias("phones"))


L = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"


@query(f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' ) AS x FROM documents)
SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(x), '%pdf-|endobj|xref|startxref|/flatedecode|/xobject|/font|/colorspace')) >= 3 OR starts_with(lower(x), '%pdf-')
  OR (length(x) > 200 AND len(regexp_extract_all(x, '[^\\s{L}0-9@._%+\\-:,;()/]')) > 0.35 * len(regexp_extract_all(x, '[{L}]'))) THEN 0 ELSE least(50000, length(x)) END AS kept_chars FROM t""")
def text_cleaner_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(text.clean_document(F.col("text"))).cast("long").alias("kept_chars"))


@query(f"""
WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, length(x) >= 80 AND len(regexp_extract_all(x, '[{L}]')) >= 0.55 * length(x) AND len(regexp_extract_all(x, '%PDF-|endobj|xref|/FlateDecode|/XObject')) < 5 AS readable FROM t""")
def readability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.readable(F.col("text")).alias("readable"))


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '\\s+', ' ', 'g')) AS body FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("body"))


@query("""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/]*') || href ELSE regexp_replace(url, '[^/]*$', '') || href END AS link, count(*) AS times
FROM l WHERE href <> '' AND NOT starts_with(href, '#') GROUP BY 1, 2""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links of each page; relative ones are resolved on the page's own address."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a\\s[^>]*href="([^"]*)"'), 1)).alias("href"))
    p = p.filter((F.col("href") != "") & ~F.col("href").startswith("#"))
    link = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", "^https?://[^/]*", 0), "href")).otherwise(F.concat(F.regexp_replace("url", "[^/]*$", ""), "href"))
    return p.groupBy("page_id", link.alias("link")).agg(F.count("*").alias("times"))


#: Neutral rules over frequent words: (label, pattern on folded text).
RULES = (("articles", "(^|[^a-z])(the|der|las|les)([^a-z]|$)"), ("links", "(^|[^a-z])(and|und|que|pour)([^a-z]|$)"), ("places", "(^|[^a-z])(from|von|dans|para)([^a-z]|$)"))


@query(f"""
WITH t AS (SELECT doc_id, {FOLDED} AS x FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest([{", ".join(f"{{'p': length(split_part(regexp_replace(x, '{p}', chr(1)), chr(1), 1)), 'hit': regexp_matches(x, '{p}'), 'o': {k}, 'l': '{n}'}}" for k, (n, p) in enumerate(RULES))}]) AS m FROM t)
SELECT doc_id, array_to_string(list(m.l ORDER BY m.o) FILTER (WHERE m.hit), ',') AS labels, arg_min(m.l, (m.p, m.o)) FILTER (WHERE m.hit) AS first_label,
       CAST(least(100, 20 + 15 * count(*) FILTER (WHERE m.hit)) AS BIGINT) AS quality FROM r GROUP BY doc_id""")
def rule_tags_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels whose rule matches, the one that matches first, and a score that grows with the evidence."""
    t = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.fold(F.col("text")).alias("x"))
    hits = F.array_compact(F.array(*[F.when(F.col("x").rlike(p), F.struct(F.regexp_instr("x", F.lit(p)).alias("p"), F.lit(k).alias("o"), F.lit(n).alias("l"))) for k, (n, p) in enumerate(RULES)]))
    t = t.select("doc_id", hits.alias("h"))
    return t.select("doc_id", F.when(F.size("h") > 0, F.array_join(F.transform("h", lambda m: m["l"]), ",")).alias("labels"), F.array_min("h")["l"].alias("first_label"), F.least(F.lit(100), 20 + 15 * F.size("h")).cast("long").alias("quality"))


@query("SELECT doc_id, 'text-sha256:' || sha256(trim(text)) AS fingerprint, sha256(concat_ws('|', lang, source, sha256(text))) AS record FROM documents WHERE text IS NOT NULL")
def document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", text.document_fingerprint(F.col("text")).alias("fingerprint"), F.sha2(F.concat_ws("|", "lang", "source", F.sha2("text", 256)), 256).alias("record"))


@query("""
WITH w AS (SELECT p_partkey, lower(p_name) AS n, list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 2) AS ws, p_brand FROM part)
SELECT a.p_partkey AS id, b.p_partkey AS other_id FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE a.n = b.n OR (len(a.ws) > 1 AND len(b.ws) > 1 AND len(list_filter(a.ws, lambda x: list_contains(b.ws, x))) >= 2 AND len(list_filter(a.ws, lambda x: list_contains(b.ws, x))) >= 0.66 * least(len(a.ws), len(b.ws)))""")
def name_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names within a block: distinct names are compared, then their rows are paired."""
    return similar_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand")


@query(f"""
SELECT o_orderkey AS id, CAST(CASE WHEN d <= 7 THEN 10 WHEN d <= 30 THEN 7 WHEN d <= 90 THEN 4 WHEN d <= 365 THEN 2 ELSE 0 END AS INTEGER) AS bonus
FROM (SELECT o_orderkey, greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(o_orderdate)) / 86400e6 AS d FROM orders)""")
def recency_bonus_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), recency_bonus(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp_ntz")).alias("bonus"))


@query(with_("contents", "SELECT id, attempts, CAST(least(360, greatest(1, pow(2, least(8, greatest(0, attempts - 1))))) AS INTEGER) AS wait_minutes, created_at + to_minutes(CAST(least(360, greatest(1, pow(2, least(8, greatest(0, attempts - 1))))) AS BIGINT)) AS due_at FROM contents"))
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = backoff_minutes(F.col("attempts"))
    return contents(spark, sf_dir).select("id", "attempts", wait.alias("wait_minutes"), (F.col("created_at") + F.make_dt_interval(mins=wait)).alias("due_at"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) WHEN event_id % 3 = 1 THEN date_trunc('second', ts) END AS at FROM events""")
def safe_iso_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that arrive as ISO text, as milliseconds, or as noise."""
    ts = F.date_trunc("second", "ts")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.unix_millis(ts.cast("timestamp")).cast("string")).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", safe_timestamp(raw).cast("timestamp_ntz").alias("at"))


@query("""
WITH s AS (SELECT o_custkey AS person, year(o_orderdate) * 12 + month(o_orderdate) AS a, year(l_shipdate) * 12 + month(l_shipdate) + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate),
m AS (SELECT *, max(b) OVER (PARTITION BY person ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT * FROM s))
SELECT person, CAST(sum(greatest(0, b - greatest(a, coalesce(reach, -1)))) AS BIGINT) AS months FROM m GROUP BY person""")
def interval_union_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("l_shipdate") > F.col("o_orderdate"))
    s = s.select(F.col("o_custkey").alias("person"), month_index(F.col("o_orderdate")).alias("a"), (month_index(F.col("l_shipdate")) + 1).alias("b"))
    return union_months(s, "person", "a", "b")


@query(f"""
WITH {geo.sql_places()}, d AS (SELECT a.place_id, b.place_id AS near_id, a.radius, {geo.SQL_HALF} AS h FROM places a, places b)
SELECT place_id, near_id, round({geo.SQL_KM}, 1) AS km FROM d WHERE {geo.SQL_KM} <= coalesce(radius, 15)""")
def nearby_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nearby(spark).filter("matches").select("place_id", "near_id", F.round("km", 1).alias("km"))


@query(f"""
WITH {geo.sql_places()}, w AS (SELECT c_custkey AS id, CAST(c_custkey % 43 AS INTEGER) AS own, CAST(c_custkey * 7 % 43 AS INTEGER) AS asked FROM customer),
d AS (SELECT id, own, asked, b.radius, {geo.SQL_HALF} AS h FROM w JOIN places a ON a.place_id = own JOIN places b ON b.place_id = asked)
SELECT id, round({geo.SQL_KM}, 1) AS km, {geo.SQL_KM} <= coalesce(radius, 15) AS matches FROM d""")
def proximity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each person's place to the one asked for, by a broadcast of the fixed place table."""
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 43).cast("int").alias("own"), (F.col("c_custkey") * 7 % 43).cast("int").alias("asked"))
    p = geo.places(spark)
    a = p.select(F.col("place_id").alias("own"), F.col("lat").alias("la"), F.col("lon").alias("oa"))
    b = p.select(F.col("place_id").alias("asked"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), "radius")
    d = geo.km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"))
    return w.join(F.broadcast(a), "own").join(F.broadcast(b), "asked").select("id", F.round(d, 1).alias("km"), (d <= F.coalesce("radius", F.lit(15))).alias("matches"))


@query(f"""
WITH {geo.sql_places()}, near AS (SELECT b.name, b.alias FROM places a, places b, (SELECT 1) WHERE a.name = 'Pocitos' AND (6371 * 2 * asin(sqrt({geo.SQL_HALF}))) <= coalesce(a.radius, 15))
SELECT c_custkey AS id, p.name AS city FROM customer JOIN places p ON p.place_id = c_custkey % 43 WHERE EXISTS (SELECT 1 FROM near WHERE contains(lower(p.name), lower(near.name)))""")
def location_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known place stands for all names within its radius; a city matches if it contains any of them."""
    p = geo.places(spark)
    near = geo.nearby(spark).join(p.filter("name = 'Pocitos'").select("place_id"), "place_id").filter("matches").select(F.col("near_id").alias("place_id")).join(p, "place_id").select(F.lower("name").alias("near"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 43).cast("int").alias("place_id")).join(F.broadcast(p), "place_id")
    return people.join(F.broadcast(near), F.contains(F.lower("name"), F.col("near")), "left_semi").select("id", F.col("name").alias("city"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, trim(regexp_replace(lower(strip_accents('{p[0]}  {p[1] or ''} -X')), '[^a-z0-9]+', ' ', 'g')))" for k, p in enumerate(geo.PLACES)) + ") v(place_id, name)")
def place_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every known place's names, with noise around them."""
    return geo.places(spark).select("place_id", text.place_key(F.concat(F.col("name"), F.lit("  "), F.coalesce("alias", F.lit("")), F.lit(" -X"))).alias("name"))


@query("SELECT doc_id, CASE WHEN length(text) > 420 THEN rtrim(substr(text, 1, 420), ' ') || '...' ELSE text END AS shown FROM documents")
def summary_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("shown"))


@query(with_("candidates", """
, p AS (SELECT id, regexp_replace(regexp_replace(phone[1], '[^0-9]', '', 'g'), '^00', '') AS d FROM candidates WHERE len(phone) > 0)
SELECT id, 'https://wa.me/' || CASE WHEN regexp_matches(d, '^0[0-9]{8}$') THEN '598' || substr(d, 2) WHEN regexp_matches(d, '^[249][0-9]{7}$') THEN '598' || d ELSE d END AS link FROM p"""))
def messaging_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).filter(F.size("phone") > 0).select("id", text.messaging_url(F.get("phone", F.lit(0))).alias("link"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ';' || p_brand || '| ' || p_type || ',,', '[;,|]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS parts FROM part")
def list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(";"), "p_brand", F.lit("| "), "p_type", F.lit(",,"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.split_list(raw), "/").alias("parts"))


@query("""
SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(1, p - 80), least(p - 1, 80) + 220) END AS shown FROM (SELECT doc_id, text, strpos(text, 'the ') AS p FROM documents)""")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword in its context, 80 characters before and 220 from its start."""
    d = table(spark, sf_dir, "documents").withColumn("p", F.locate("the ", F.col("text")))
    return d.select("doc_id", F.when(F.col("p") > 0, F.expr("substring(text, greatest(1, p - 80), least(p - 1, 80) + 220)")).alias("shown"))


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) - 1 AS after FROM orders")
def day_overlap_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_sub("o_orderdate", 1).alias("after"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id % 59 + 1 WHEN 1 THEN greatest(3, doc_id % 59 + 1) WHEN 2 THEN NULL END AS years FROM documents""")
def years_and_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most years of experience that a text states; other numbers don't count."""
    d = F.col("doc_id")
    n = (d % 59 + 1).cast("string")
    said = F.when(d % 4 == 0, F.concat(F.lit("Cuento con "), n, F.lit(" años de experiencia, nací en 1970"))).when(d % 4 == 1, F.concat(F.lit("Experiencia en ventas: 3 años. Más de "), n, F.lit(" AÑOS de trayectoria"))).when(d % 4 == 2, F.concat(n, F.lit(" años cumplidos"))).otherwise(F.lit("con 60 años de experiencia"))
    return table(spark, sf_dir, "documents").select("doc_id", per_row(years, "long")(F.concat(F.lit("Texto. "), said)).alias("years"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN text || chr(10) || 'Referencias: ' || lang ELSE text || chr(10) END AS head FROM documents WHERE text IS NOT NULL")
def reference_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text before its section of references."""
    d = F.col("doc_id")
    tail = F.when(d % 3 == 0, F.concat(F.lit("Referencias laborales: "), "lang")).when(d % 3 == 1, F.concat(F.lit("REFERENCIAS PERSONALES\n"), "lang", F.lit(" referencias laborales"))).otherwise(F.concat(F.lit("Referencias: "), "lang"))
    docs = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", "lang"))
    # Only where the section begins comes back from Python.
    found = once(docs, whole=F.concat("text", F.lit("\n"), tail)).withColumn("at", per_row(references_at, "int")("whole"))
    return found.select("doc_id", F.when(F.col("at") > 0, F.substring("whole", F.lit(1), F.col("at"))).otherwise(F.col("whole")).alias("head"))
