"""Readers and connectors over whole tables: what is written in a source's form has to come back as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions.perrow import per_row
from veinwork.plans.base import query
from veinwork.sources import connectors, landed, readers
from veinwork.sources.tables import table
from veinwork.streaming.sinks import shared_folder

#: Messages in a mail box, rows in a delimited file.
BOX, FILE = 20, 50


@query(f"""
SELECT 'box-' || (doc_id // {BOX}) AS path, doc_id, 'Document ' || doc_id || ' é' AS subject, source || '@mail.example' AS sender,
       sha256(trim(coalesce(text, ''), chr(13) || chr(10))) AS body_sha256, 'file-' || doc_id || '.txt' AS file_name, CAST(length(lang) AS BIGINT) AS size, sha256(lang) AS file_sha256
FROM documents""")
def mail_box_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail boxes with encoded headers, base64 bodies and attachments, split and parsed."""
    d = table(spark, sf_dir, "documents").withColumn("box", F.floor(F.col("doc_id") / BOX))
    word = F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(F.concat(F.lit("Document "), "doc_id", F.lit(" é")), "UTF-8")), F.lit("?="))
    body = F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    message = F.concat(
        F.lit("From x Mon Jan 1 00:00:00 2001\nFrom: "), "source", F.lit("@mail.example\nSubject:\n "), word, F.lit("\nMessage-ID: <"), "doc_id", F.lit('@x>\nContent-Type: multipart/mixed; boundary="b0"\n\n'),
        F.lit("--b0\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), body,
        F.lit('\n--b0\nContent-Type: text/plain; name="file-'), "doc_id", F.lit('.txt"\nContent-Disposition: attachment; filename="file-'), "doc_id", F.lit('.txt"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.encode("lang", "UTF-8")), F.lit("\n--b0--\n"),
    )
    boxes = d.select("box", F.struct("doc_id", message.alias("m")).alias("x")).groupBy("box").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    files = boxes.select(F.concat(F.lit("box-"), "box").alias("path"), F.encode(F.array_join("xs.m", "\n"), "UTF-8").alias("content"))
    file = F.get("attachments", F.lit(0))
    return readers.mail_boxes(files).select(
        "path",
        F.split("message_id", "@")[0].cast("long").alias("doc_id"),
        "subject",
        "sender",
        F.sha2("body", 256).alias("body_sha256"),
        file["file_name"].alias("file_name"),
        file["size"].alias("size"),
        file["sha256"].alias("file_sha256"),
    )


def _delimited(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    """(k, text): customers in files of ``FILE`` lines, names quoted with a quote and the separator in them."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.floor(F.col("c_custkey") / FILE))
    line = F.concat_ws(sep, F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(f'""a""{sep}b"')), "c_mktsegment", F.lit(""))
    lines = c.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))).alias("xs"))
    return lines.select("k", F.concat(F.lit("﻿"), F.lit(sep.join(("id", "name", "segment", "")) + "\n"), F.array_join("xs.l", "\n")).alias("text"))


def _parsed(text: DataFrame, read) -> DataFrame:
    import json

    rows = per_row(lambda t: [json.dumps(r) for r in read(t)], "array<string>")
    at = lambda n: F.get_json_object("r", f"$.{n}")
    return text.select(F.explode(rows("text")).alias("r")).select(at("id").cast("long").alias("id"), at("name").alias("name"), at("segment").alias("segment"), at("column_4").alias("column_4"))


@query("""SELECT c_custkey AS id, c_name || '"a"' || CASE c_custkey // 50 % 3 WHEN 0 THEN ';' WHEN 1 THEN chr(9) ELSE ',' END || 'b' AS name, c_mktsegment AS segment, '' AS column_4 FROM customer""")
def delimited_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with one of three separators, told by their headers."""
    files = [_delimited(spark, sf_dir, s).filter(F.col("k") % 3 == k) for k, s in enumerate(";\t,")]
    return _parsed(files[0].unionByName(files[1]).unionByName(files[2]), readers.delimited_rows)


@query("""SELECT c_custkey AS id, c_name || '"a"' || CASE WHEN c_custkey // 50 % 2 = 0 THEN ';' ELSE ',' END || 'b' AS name, c_mktsegment AS segment, '' AS column_4 FROM customer""")
def delimited_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = [_delimited(spark, sf_dir, s).filter(F.col("k") % 2 == k) for k, s in enumerate(";,")]
    return _parsed(files[0].unionByName(files[1]), readers.simple_rows)


@query("""
SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 2 THEN 'text-1' ELSE CAST(n_nationkey AS VARCHAR) END AS id, CASE n_nationkey % 3 WHEN 2 THEN n_name ELSE n_name END AS name FROM nation
UNION ALL SELECT n_nationkey, 'text-2', 'second' FROM nation WHERE n_nationkey % 3 = 2""")
def import_in_any_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, delimited text and loose chunks through one reader."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    as_json = F.concat(F.lit("["), F.to_json(F.struct(F.col("k").alias("id"), "name")), F.lit("]"))
    text = F.when(F.col("k") % 3 == 0, as_json).when(F.col("k") % 3 == 1, F.concat(F.lit("id\tname\n"), "k", F.lit("\t"), "name")).otherwise(F.concat("name", F.lit("\n\n second")))
    found = n.select("k", F.explode(per_row(_import_rows, "array<struct<id:string,name:string>>")(text)).alias("r"))
    return found.select("k", "r.id", "r.name")


def _import_rows(text):
    return [{"id": str(r.get("id", r.get("source_id"))), "name": r.get("name", r.get("text"))} for r in readers.rows_of(text)]


@query("""
SELECT event_id, 'v' || event_type AS found FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 'p' || user_id FROM events WHERE event_id % 2 = 1""")
def embedded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a configuration, under a known key or anywhere."""
    e = table(spark, sf_dir, "events")
    known = F.concat(F.lit('{"records":"id;name\\n'), "event_id", F.lit(";v"), "event_type", F.lit('"}'))
    loose = F.concat(F.lit('{"x":[{"y":{"fullName":"p'), "user_id", F.lit('"}}],"z":1}'))
    rows = per_row(_record_names, "array<string>")(F.when(F.col("event_id") % 2 == 0, known).otherwise(loose))
    return e.select("event_id", F.explode(rows).alias("found"))


def _record_names(text):
    return [r.get("name") or r.get("fullName") for r in readers.embedded_rows(text)]


@query("""SELECT event_id, 'a' || user_id || ',' || event_type || ',' || CAST(json_extract_string(props, '$.k') AS VARCHAR) AS found FROM events""")
def deep_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of wanted keys however deep they stand and however the keys are written."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"Skill-s":[{"name":"a'), "user_id", F.lit('"},"'), "event_type", F.lit('"],"in":{"p":'), "props", F.lit(',"q":[{"K":null}]}}'))
    return e.select("event_id", F.array_join(per_row(_wanted, "array<string>")(text), ",").alias("found"))


def _wanted(text):
    return readers.deep_values(text, ["skills", "k"])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000 WHEN 2 THEN 1000000000000 END AS found FROM events""")
def source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates under known keys, as numbers or as text, an object's own before its children's; dates to come don't count."""
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"a":{"createdAt":5},"fecha":'), "ms", F.lit("}")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a":[1,{"created_at":"'), iso, F.lit('Z"}]}')))
        .when(F.col("event_id") % 4 == 2, F.lit('{"b":{"date":"2001-09-09T01:46:40Z"},"timestamp":"never"}'))
        .otherwise(F.lit('{"date":"2999-01-01"}'))
    )
    return e.select("event_id", per_row(_date, "long")(text).alias("found"))


def _date(text):
    return readers.source_date(text, 4_000_000_000_000)


def _pages(spark: SparkSession, sf_dir: str, size: int = 25) -> DataFrame:
    """Customers as landed pages; the source repeats its last page once."""
    c = table(spark, sf_dir, "customer").select((F.floor(F.col("c_custkey") / size) + 1).alias("page"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("row"))
    pages = c.groupBy("page").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    last = pages.agg(F.max(F.struct("page", "rows")).alias("x")).select((F.col("x.page") + 1).alias("page"), F.col("x.rows").alias("rows"))
    return pages.unionByName(last)


@query("""SELECT c_custkey AS id, c_name AS name, CAST(c_custkey // 25 + 1 AS BIGINT) AS page FROM customer""")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs over pages, each of at most so many pages from where the one before ended; repeated pages don't count."""
    feed = shared_folder(spark, "pages")
    landed.land(_pages(spark, sf_dir), f"{feed}/landed", ["page"])
    pages = landed.deliver(spark, f"{feed}/landed", "page long, rows array<struct<id:long,name:string>>", f"{feed}/read", most=400)
    return connectors.flat(connectors.new_pages(pages, None)).select("id", "name", "page")


@query("""SELECT c_custkey AS id, c_name AS name FROM customer""")
def paged_source_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connector over few large pages, more than a run takes: the cursor holds the page to go on from."""
    config, out = {}, None
    pages = _pages(spark, sf_dir, size=max(1, table(spark, sf_dir, "customer").count() // 150)).cache()
    for _ in range(4):
        sync = connectors.CONNECTORS["paged"](config, pages)
        config |= sync.config
        out = sync.rows if out is None else out.unionByName(sync.rows)
        if config["page"] is None:
            break
    return out.dropDuplicates(["id"]).select("id", "name")


@query("""SELECT c_custkey AS id FROM customer WHERE c_custkey < 30""")
def paged_source_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run: what stands before the first known id."""
    return connectors.CONNECTORS["paged"]({"known": ["30", "35"]}, _pages(spark, sf_dir)).rows.select("id")


@query("""
SELECT run, o_orderkey AS id FROM (
  SELECT o_orderkey, (row_number() OVER (ORDER BY offer, stage, page, o_orderkey) - 1) // 15 AS run
  FROM (SELECT o_orderkey, o_custkey % 7 AS offer, o_orderstatus AS stage, o_orderkey // 1000 AS page FROM orders)) WHERE run < 3""")
def nested_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over offers, stages and pages, each from the cursor that the one before left."""
    stages, config, out = _stages(spark, sf_dir), {}, None
    for run in range(3):
        sync = connectors.CONNECTORS["nested"](config, stages)
        config |= sync.config
        rows = sync.rows.select(F.lit(run).cast("long").alias("run"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("offer"), F.col("o_orderstatus").alias("stage"), F.floor(F.col("o_orderkey") / 1000).alias("page"), F.struct(F.col("o_orderkey").alias("id")).alias("row"))
    return o.groupBy("offer", "stage", "page").agg(F.array_sort(F.collect_list("row")).alias("rows"))


@query("""SELECT o_orderkey AS id, o_custkey % 7 AS offer, o_orderstatus AS stage, CAST(o_orderkey // 1000 AS BIGINT) AS page FROM orders""")
def nested_source_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications of all offers and stages, page by page in several runs of a stream whose offset is the cursor."""
    feed = shared_folder(spark, "stages")
    landed.land(_stages(spark, sf_dir), f"{feed}/landed", ["offer", "stage", "page"])
    known = landed.manifest(f"{feed}/landed")
    out = landed.deliver(spark, f"{feed}/landed", "offer long, stage string, page long, rows array<struct<id:long>>", f"{feed}/read", most=known["next"] // 3 + 1)
    return out.select("offer", "stage", "page", F.explode("rows.id").alias("id"))


@query("""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (ORDER BY event_id DESC) AS n FROM events)
SELECT 'historical' AS mode, event_id AS id FROM e WHERE n > 10
UNION ALL SELECT 'history', event_id FROM e WHERE n <= 10
UNION ALL SELECT 'overlap', event_id FROM e WHERE day >= (SELECT max(day) FROM e) - 1""")
def mail_feed_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed read from the start in several runs, then from its mark, then after the mark was lost."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    cut = e.orderBy(F.desc("event_id")).limit(10).agg(F.min("event_id")).first()[0]
    folder = shared_folder(spark, "mail")
    feed, read = f"{folder}/landed", f"{folder}/read"
    fields = "event_id long, mode string"
    landed.land(e.filter(F.col("event_id") < cut), feed, ["event_id"], "day")
    known = landed.manifest(feed)
    landed.deliver(spark, feed, fields, read, most=known["next"] // 2 + 1)
    known = landed.land(e.filter(F.col("event_id") >= cut), feed, ["event_id"], "day")
    landed.deliver(spark, feed, fields, read)
    unseen = landed.land(e.filter(F.col("event_id") >= cut), feed, ["event_id"], "day")  # retired before the stream has read them
    landed.land(e, feed, ["event_id"], "day")
    landed.retire(feed, unseen["next"])
    out = landed.deliver(spark, feed, fields, read)
    return out.select("mode", F.col("event_id").alias("id"))
