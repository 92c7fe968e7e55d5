"""Merges, rejects, repairs and rule-based changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators.identity import keepers, repoint, resolved
from veinwork.operators.merge import merged_rows, one_of_each, rejected, repointed
from veinwork.operators.relational import keep_first
from veinwork.functions.names import looks_real
from veinwork.functions.perrow import per_row
from veinwork.plans.base import query
from veinwork.plans.name_queries import PEOPLE, people
from veinwork.sources.tables import candidates, contents, sources, table, with_


@query(with_("candidates", """
SELECT a.id, array_to_string(list_sort(list_distinct(list_concat(a.email, coalesce(b.email, CAST([] AS VARCHAR[]))))), ',') AS emails, greatest(a.quality_score, coalesce(b.quality_score, 0)) AS quality_score
FROM candidates a LEFT JOIN candidates b ON b.duplicate_of = a.id"""))
def array_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    b = c.filter("duplicate_of is not null").select(F.col("duplicate_of").alias("id"), F.col("email").alias("more"), F.col("quality_score").alias("q"))
    j = c.join(b, "id", "left")
    return j.select("id", F.array_join(F.array_sort(F.array_union("email", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("emails"), F.greatest("quality_score", F.coalesce("q", F.lit(0))).alias("quality_score"))


@query("""
WITH s AS (SELECT doc_id, sha256(text) AS h, lang FROM documents WHERE doc_id % 2 = 0), i AS (SELECT doc_id - doc_id % 2 AS doc_id, sha256(text) AS h, lang FROM documents WHERE doc_id % 2 = 1)
SELECT i.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.h = i.h THEN 'unchanged' ELSE 'updated' END AS outcome FROM i LEFT JOIN s USING (doc_id)""")
def unchanged_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows whose content hash is known change nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    s = d.filter("doc_id % 2 = 0").select("doc_id", F.col("h").alias("old"))
    i = d.filter("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - F.col("doc_id") % 2)
    return i.join(s, "doc_id", "left").select("doc_id", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("h"), "unchanged").otherwise("updated").alias("outcome"))


@query(with_("contents", """
, s AS (SELECT * FROM contents WHERE id % 2 = 0), i AS (SELECT id - id % 2 AS id, is_primary, mime_type, processed_at, raw_text FROM contents WHERE id % 2 = 1)
SELECT coalesce(s.id, i.id) AS id, coalesce(s.is_primary, FALSE) OR coalesce(i.is_primary, FALSE) AS is_primary, coalesce(i.mime_type, s.mime_type) AS mime_type,
       coalesce(i.processed_at, s.processed_at) AS processed_at FROM s FULL JOIN i ON s.id = i.id"""))
def document_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contents(spark, sf_dir).select("id", "is_primary", "mime_type", "processed_at")
    i = d.filter("id % 2 = 1").withColumn("id", F.col("id") - F.col("id") % 2)
    return merged_rows(d.filter("id % 2 = 0"), i, "id", {"is_primary": "or", "mime_type": "incoming", "processed_at": "incoming"}).drop("outcome")


@query(with_("candidates contents", """
SELECT coalesce(c.duplicate_of, d.candidate_id) AS candidate_id, count(*) AS documents, min(d.id) AS first_id FROM contents d LEFT JOIN candidates c ON c.id = d.candidate_id AND c.duplicate_of IS NOT NULL GROUP BY 1"""))
def duplicate_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = candidates(spark, sf_dir).filter("duplicate_of is not null").select(F.col("id").alias("old"), F.col("duplicate_of").alias("new"))
    return repointed(contents(spark, sf_dir).select("candidate_id", "id"), "candidate_id", moved).groupBy("candidate_id").agg(F.count("*").alias("documents"), F.min("id").alias("first_id"))


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 7 AS keeper FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM d a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.doc_id % 2 = 0 AND b.h = a.h)""")
def hash_clash_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to move, without those whose content the keeper has already."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.filter("doc_id % 2 = 1").join(d.filter("doc_id % 2 = 0").select("h"), "h", "left_anti").select("doc_id")


@query(with_("candidates", """
, s AS (SELECT id, unnest(email) AS e FROM candidates WHERE id % 2 = 0), i AS (SELECT id, unnest(email) AS e FROM candidates WHERE id % 2 = 1),
m AS (SELECT i.id, max(s.id) AS stored FROM i JOIN s ON lower(i.e) = lower(s.e) GROUP BY i.id)
SELECT c.id, m.stored, CASE WHEN m.stored IS NULL THEN 'inserted' ELSE 'merged' END AS outcome, CASE WHEN m.stored IS NULL THEN 50 END AS quality_score FROM candidates c LEFT JOIN m ON m.id = c.id WHERE c.id % 2 = 1"""))
def manual_import_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming people meet a stored one by address; the newest wins, the rest are inserted."""
    c = candidates(spark, sf_dir)
    e = c.select("id", F.explode("email").alias("e")).withColumn("e", F.lower("e"))
    s = e.filter("id % 2 = 0").select(F.col("id").alias("stored"), "e")
    m = e.filter("id % 2 = 1").join(s, "e").groupBy("id").agg(F.max("stored").alias("stored"))
    out = c.filter("id % 2 = 1").select("id").join(m, "id", "left")
    return out.select("id", "stored", F.when(F.col("stored").isNull(), "inserted").otherwise("merged").alias("outcome"), F.when(F.col("stored").isNull(), 50).alias("quality_score"))


@query("SELECT user_id, arg_min(event_id, event_id) AS first_id, arg_max(event_id, event_id) AS last_id FROM events GROUP BY user_id")
def first_last_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    first = one_of_each(e, "user_id", "event_id").withColumnRenamed("event_id", "first_id")
    return first.join(one_of_each(e, "user_id", "event_id", last=True).withColumnRenamed("event_id", "last_id"), "user_id")


@query(with_("candidates", """
SELECT id, CASE WHEN len(email) = 0 AND len(phone) = 0 THEN 'no contact' WHEN quality_score < 5 THEN 'low quality' WHEN status = 'rejected' THEN 'rejected before' END AS reason FROM candidates
WHERE (len(email) = 0 AND len(phone) = 0) OR quality_score < 5 OR status = 'rejected'"""))
def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("no contact", (F.size("email") == 0) & (F.size("phone") == 0)), ("low quality", F.col("quality_score") < 5), ("rejected before", F.col("status") == "rejected")]
    return rejected(candidates(spark, sf_dir), rules)[1].select("id", "reason")


@query("""
WITH o AS (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'new' WHEN event_id % 3 = 1 THEN 'updated' ELSE 'unchanged' END AS outcome, ts FROM events)
SELECT event_type AS source, count(*) FILTER (WHERE outcome = 'new') AS new, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'error') AS errors,
       CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS seconds, CASE WHEN count(*) FILTER (WHERE outcome = 'error') > 0 THEN 'partial' ELSE 'ok' END AS status FROM o GROUP BY event_type""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    o = table(spark, sf_dir, "events").withColumn("outcome", F.when(i % 10 == 0, "error").when(i % 3 == 0, "new").when(i % 3 == 1, "updated").otherwise("unchanged"))
    n = lambda v: F.count_if(F.col("outcome") == v)
    seconds = F.round((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).cast("long")
    return o.groupBy(F.col("event_type").alias("source")).agg(n("new").alias("new"), n("updated").alias("updated"), n("unchanged").alias("unchanged"), n("error").alias("errors"), seconds.alias("seconds"), F.when(n("error") > 0, "partial").otherwise("ok").alias("status"))


@query(with_("candidates", """
, r AS (SELECT id, full_name, 'Cliente ' || substr(full_name, 10) AS repaired FROM candidates WHERE id % 5 = 0)
SELECT c.id, 'repaired' AS step, coalesce(r.repaired, c.full_name) AS full_name, r.full_name AS backup, FALSE AS reverted FROM candidates c LEFT JOIN r USING (id)
UNION ALL SELECT c.id, 'rolled back', CASE WHEN c.id % 10 = 0 THEN c.full_name ELSE coalesce(r.repaired, c.full_name) END, r.full_name, c.id % 10 = 0 FROM candidates c LEFT JOIN r USING (id)"""))
def repair_backup_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are repaired with a backup of the old ones; one of two repairs is rolled back from its backup and marked as reverted."""
    c = candidates(spark, sf_dir).select("id", "full_name")
    backup = c.filter("id % 5 = 0").select("id", (F.col("id") % 10).alias("repair_id"), F.col("full_name").alias("backup"))
    repaired = c.join(backup, "id", "left").withColumn("full_name", F.when(F.col("backup").isNotNull(), F.concat(F.lit("Cliente "), F.substring("full_name", 10, 100))).otherwise(F.col("full_name")))
    undone = F.coalesce(F.col("repair_id") == 0, F.lit(False))
    back = repaired.select("id", F.lit("rolled back").alias("step"), F.when(undone, F.col("backup")).otherwise(F.col("full_name")).alias("full_name"), "backup", undone.alias("reverted"))
    return repaired.select("id", F.lit("repaired").alias("step"), "full_name", "backup", F.lit(False).alias("reverted")).unionByName(back)


@query(with_("candidates sources", """
SELECT id FROM candidates c WHERE NOT (country = 'ASIA' AND len(email) = 0 AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.candidate_id = c.id AND s.is_active))"""))
def rule_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = sources(spark, sf_dir).filter("is_active").select(F.col("candidate_id").alias("id")).distinct().withColumn("a", F.lit(True))
    c = candidates(spark, sf_dir).join(active, "id", "left")
    return c.filter(~((F.col("country") == "ASIA") & (F.size("email") == 0) & F.col("a").isNull())).select("id")


@query(with_("contents", "SELECT id, CASE WHEN error LIKE 'HTTP%' AND attempts < 5 THEN NULL ELSE processed_at END AS processed_at FROM contents"))
def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.coalesce(F.col("error").startswith("HTTP"), F.lit(False)) & (F.col("attempts") < 5)
    return contents(spark, sf_dir).select("id", F.when(~again, F.col("processed_at")).alias("processed_at"))


@query(f"""
WITH {PEOPLE} SELECT id, CASE WHEN id % 4 = 0 THEN 'active' ELSE 'rejected' END AS status FROM people""")
def generic_name_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whose name is a kind of work, a heading or a code are rejected."""
    k = F.col("id")
    name = F.when(k % 4 == 0, F.col("name")).when(k % 4 == 1, F.lit("Auxiliar Administrativo")).when(k % 4 == 2, F.concat(F.lit("Perfil "), "name")).otherwise(F.concat(F.lit("Customer#"), k))
    return people(spark, sf_dir).select("id", F.when(per_row(looks_real, "boolean")(name), "active").otherwise("rejected").alias("status"))


@query(with_("candidates contents", """
, best AS (SELECT candidate_id, length(raw_text) AS n FROM contents QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY is_primary DESC, created_at DESC, id DESC) = 1)
SELECT c.id, CAST(least(100, 20 + 15 * CAST(len(email) > 0 AS INTEGER) + 15 * CAST(len(phone) > 0 AS INTEGER) + 15 * CAST(coalesce(n, 0) >= 80 AS INTEGER) + 10 * CAST(coalesce(n, 0) >= 2000 AS INTEGER)) AS BIGINT) AS quality_score
FROM candidates c LEFT JOIN best ON candidate_id = c.id"""))
def reanalysis_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality recomputed for all rows in one job."""
    d = contents(spark, sf_dir).withColumn("n", F.char_length("raw_text"))
    best = keep_first(d.select("candidate_id", "n", "is_primary", "created_at", "id"), ["candidate_id"], [F.col("is_primary").desc(), F.col("created_at").desc(), F.col("id").desc()])
    c = candidates(spark, sf_dir).select("id", "email", "phone").join(best.select(F.col("candidate_id").alias("id"), "n"), "id", "left")
    n, flag = F.coalesce("n", F.lit(0)), lambda b: b.cast("int")
    score = 20 + 15 * flag(F.size("email") > 0) + 15 * flag(F.size("phone") > 0) + 15 * flag(n >= 80) + 10 * flag(n >= 2000)
    return c.select("id", F.least(F.lit(100), score).cast("long").alias("quality_score"))


@query(with_("candidates", "SELECT id FROM candidates WHERE (CASE WHEN id % 6 = 0 THEN NULL ELSE city END) IS DISTINCT FROM city OR (CASE WHEN id % 10 = 0 THEN upper(summary) ELSE summary END) IS DISTINCT FROM summary"))
def changed_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose search inputs differ from before, null-safe: only these are indexed anew."""
    c = candidates(spark, sf_dir)
    city, summary = F.when(F.col("id") % 6 != 0, F.col("city")), F.when(F.col("id") % 10 == 0, F.upper("summary")).otherwise(F.col("summary"))
    return c.filter(~(city.eqNullSafe(F.col("city")) & summary.eqNullSafe(F.col("summary")))).select("id")


@query(with_("candidates", "SELECT id, CASE WHEN len(email) >= 2 OR len(phone) >= 2 THEN 'needs_review' ELSE status END AS status FROM candidates"))
def quarantine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = (F.size("email") >= 2) | (F.size("phone") >= 2)
    return candidates(spark, sf_dir).select("id", F.when(mixed, "needs_review").otherwise(F.col("status")).alias("status"))


@query(with_("candidates", "SELECT id, CASE WHEN regexp_matches(v, '[A-Za-z]') THEN v END AS city FROM (SELECT id, CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) ELSE city END AS v FROM candidates)"))
def numeric_field_nulling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).otherwise(F.col("city"))
    return candidates(spark, sf_dir).select("id", F.when(v.rlike("\\p{L}"), v).alias("city"))


@query("""
SELECT event_id, 'k' AS key, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 'kind', event_type FROM events
UNION ALL SELECT event_id, 'limit', CAST(user_id AS VARCHAR) FROM events WHERE event_id % 2 = 0""")
def config_merge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored maps take over changed keys and lose a removed one; keys that no change names stay."""
    k = F.get_json_object("props", "$.k")
    limit = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("limit"), F.col("user_id").cast("string"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    stored = F.map_concat(F.create_map(F.lit("k"), k, F.lit("cursor"), F.lit("x")), limit)
    change = F.create_map(F.lit("k"), (k.cast("long") + 1).cast("string"), F.lit("kind"), F.col("event_type"))
    kept = F.map_filter(stored, lambda n, v: ~F.array_contains(F.map_keys(change), n) & (n != "cursor"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.map_concat(kept, change)).alias("key", "value"))


#: Tables that point to a candidate: name, its column, and the columns that make a row of one candidate unique.
_CHILDREN = {"sources": ("candidate_id", ("source_id",)), "contents": ("candidate_id", ("id",)), "tags": ("id", ("tag",)), "contacts": ("id", ("value",))}


@query(with_("candidates sources contents", """
, m AS (SELECT id AS old, duplicate_of AS new FROM candidates WHERE duplicate_of IS NOT NULL),
u AS (SELECT 'sources' AS child, candidate_id AS parent, CAST(source_id AS VARCHAR) AS k FROM sources UNION ALL SELECT 'contents', candidate_id, CAST(id AS VARCHAR) FROM contents
      UNION ALL SELECT 'tags', id, unnest(tags) FROM candidates UNION ALL SELECT 'contacts', id, unnest(list_concat(email, phone)) FROM candidates),
r AS (SELECT DISTINCT child, coalesce(new, parent) AS parent, k FROM u LEFT JOIN m ON m.old = parent)
SELECT child, count(*) AS rows, count(DISTINCT parent) AS parents FROM r GROUP BY child"""))
def duplicate_merge_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table that points to a duplicate points to its keeper; rows that the keeper has already go."""
    c = candidates(spark, sf_dir)
    moved = c.filter("duplicate_of is not null").select(F.col("id").alias("old"), F.col("duplicate_of").alias("new"))
    tables = {"sources": sources(spark, sf_dir), "contents": contents(spark, sf_dir), "tags": c.select("id", F.explode("tags").alias("tag")), "contacts": c.select("id", F.explode(F.concat("email", "phone")).alias("value"))}
    out = None
    for name, (parent, unique) in _CHILDREN.items():
        rows = repointed(tables[name].select(parent, *unique).toDF("parent", "k"), "parent", moved).distinct()
        counted = rows.agg(F.lit(name).alias("child"), F.count("*").alias("rows"), F.countDistinct("parent").alias("parents"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(with_("candidates sources contents", """
, g AS (SELECT id FROM candidates WHERE id % 17 = 0)
SELECT 'candidates' AS name, count(*) AS rows FROM candidates WHERE id % 17 <> 0 UNION ALL SELECT 'sources', count(*) FROM sources WHERE candidate_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'contents', count(*) FROM contents WHERE candidate_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'pages', (SELECT count(*) FROM contents WHERE candidate_id NOT IN (SELECT id FROM g) AND raw_text IS NOT NULL)"""))
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted candidates take their sources and documents with them, and documents their texts: anti-joins level by level."""
    c, d = candidates(spark, sf_dir), contents(spark, sf_dir)
    gone = c.filter("id % 17 = 0").select(F.col("id").alias("candidate_id"))
    gone_documents = d.select("id", "candidate_id").join(gone, "candidate_id", "left_semi").select(F.col("id").alias("document_id"))
    pages = d.filter("raw_text is not null").select(F.col("id").alias("document_id"))
    left = {"candidates": c.select(F.col("id").alias("candidate_id")).join(gone, "candidate_id", "left_anti"), "sources": sources(spark, sf_dir).join(gone, "candidate_id", "left_anti"), "contents": d.join(gone, "candidate_id", "left_anti"), "pages": pages.join(gone_documents, "document_id", "left_anti")}
    out = None
    for name, rows in left.items():
        n = rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query(with_("candidates", """
SELECT id, sha256(full_name || '|' || city || '|' || array_to_string(list_sort(list_distinct(list_transform(email, lambda e: lower(e)))), ',') || '|' || array_to_string(list_sort(list_distinct(tags)), ',')) AS fingerprint, TRUE AS same FROM candidates"""))
def record_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's hash: the order and case of contacts and tags don't count, nor does what came as raw; other fields do."""
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, F.lower))), ",")
    own = lambda mail, tags: F.sha2(F.concat_ws("|", "full_name", "city", listed(mail), listed(tags)), 256)
    mixed = own(F.reverse(F.concat(F.transform("email", F.upper), F.col("email"))), F.reverse("tags"))
    return candidates(spark, sf_dir).select("id", own(F.col("email"), F.col("tags")).alias("fingerprint"), (own(F.col("email"), F.col("tags")) == mixed).alias("same"))


#: Tables that point to a client, and the column.
_OF_CLIENTS = {"sources": ("sales", "client_id"), "documents": ("documents", "doc_id"), "work_history": ("client_changes", "client_id"), "education": ("orders", "o_custkey"), "processes": ("clicks", "client_id"), "interviews": ("conversations", "conv_id"), "evaluations": ("labels", "doc_id"), "search_results": ("events", "user_id"), "agent_cache": ("lineitem", "l_suppkey")}
_ROOTS = """
WITH RECURSIVE ev AS (SELECT client_id AS id, updated_at, 'email' AS kind, lower(email) AS key FROM clients WHERE email IS NOT NULL UNION ALL SELECT client_id, updated_at, 'name', name || '|' || city FROM clients WHERE name IS NOT NULL AND city IS NOT NULL),
w AS (SELECT *, first_value(id) OVER (PARTITION BY kind, key ORDER BY updated_at DESC NULLS LAST, id) AS keeper FROM ev),
pairs AS (SELECT id AS old, keeper AS new FROM w WHERE id <> keeper QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind, keeper) = 1),
walk AS (SELECT old, new FROM pairs UNION ALL SELECT k.old, p.new FROM walk k JOIN pairs p ON p.old = k.new),
roots AS (SELECT old, new FROM walk WHERE new NOT IN (SELECT old FROM pairs))"""


def _client_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(old, new): clients with the same address, or name and city, as a newer one; followed to the last keeper."""
    c = table(spark, sf_dir, "clients").select(F.col("client_id").alias("id"), "updated_at", "email", "name", "city")
    by_mail = c.filter("email is not null").select("id", "updated_at", F.lit("email").alias("kind"), F.lower("email").alias("key"))
    by_name = c.filter("name is not null and city is not null").select("id", "updated_at", F.lit("name").alias("kind"), F.concat_ws("|", "name", "city").alias("key"))
    newest = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**62))
    found = keepers(by_mail.unionByName(by_name), ["kind", "key"], [newest, F.col("id")], "id")
    pairs = found.groupBy(F.col("id").alias("old")).agg(F.min(F.struct("kind", "keeper"))["keeper"].alias("new"))
    return resolved(pairs)


@query(_ROOTS + " SELECT old, new FROM roots")
def duplicates_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every duplicate client with the last keeper of its chain."""
    return _client_roots(spark, sf_dir)


def _moved_sql(name: str) -> str:
    of, parent = _OF_CLIENTS[name]
    if name == "documents":
        inner = f"SELECT p FROM (SELECT coalesce(new, {parent}) AS p, {parent} AS was, sha256(text) AS h FROM {of} LEFT JOIN roots ON old = {parent}) QUALIFY h IS NULL OR was = first_value(was) OVER (PARTITION BY p, h ORDER BY was <> p, was)"
    else:
        inner = f"SELECT coalesce(new, {parent}) AS p FROM {of} LEFT JOIN roots ON old = {parent}"
    return f"SELECT '{name}' AS child, count(*) AS rows, count(DISTINCT p) AS parents, CAST(sum(p) AS BIGINT) AS total FROM ({inner})"


@query(_ROOTS + " " + " UNION ALL ".join(map(_moved_sql, _OF_CLIENTS)))
def children_of_merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine child tables after a merge of duplicates: they point to the last keepers; documents whose content a keeper has already are gone."""
    moved = _client_roots(spark, sf_dir)
    children = {}
    for name, (of, parent) in _OF_CLIENTS.items():
        rows = table(spark, sf_dir, of)
        children[name] = (rows.select(parent, F.sha2("text", 256).alias("h")) if name == "documents" else rows.select(parent), parent)
    out = None
    for name, rows in repoint(children, moved, {"documents": ["h"]}).items():
        parent = children[name][1]
        counted = rows.agg(F.lit(name).alias("child"), F.count("*").alias("rows"), F.countDistinct(parent).alias("parents"), F.sum(parent).alias("total"))
        out = counted if out is None else out.unionByName(counted)
    return out
