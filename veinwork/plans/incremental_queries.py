"""Cursors, queues and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.plans.base import query
from veinwork.sources.tables import contents, table, with_
from veinwork.streaming.sinks import shared_folder
from veinwork.streaming.stateful import QUEUE, far_future, leased, run_batches, serially
from veinwork.streaming.ingest import claim, deduplicated_counts, until_known


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders),
k AS (SELECT o_custkey, min(p) AS p FROM o WHERE o_orderkey % 5 = 0 GROUP BY o_custkey)
SELECT o.o_orderkey AS id FROM o LEFT JOIN k USING (o_custkey) WHERE k.p IS NULL OR o.p < k.p""")
def head_overlap_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each feed from its head up to the first one that is known."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return until_known(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], F.col("o_orderkey") % 5 == 0).select(F.col("o_orderkey").alias("id"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS changed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders),
k AS (SELECT o_custkey, min(p) AS p FROM o WHERE o_orderkey % 7 = 0 GROUP BY o_custkey)
SELECT o.o_orderkey AS id FROM o LEFT JOIN k USING (o_custkey) WHERE (k.p IS NULL OR o.p < k.p) AND (changed IS NULL OR changed > TIMESTAMP '1998-01-01')""")
def watermark_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, and only what changed since the last run; undated rows always pass."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    new = until_known(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], F.col("o_orderkey") % 7 == 0)
    changed = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate"))
    return new.filter(changed.isNull() | (changed > F.lit("1998-01-01").cast("timestamp_ntz"))).select(F.col("o_orderkey").alias("id"))


@query(with_("contents", """
SELECT id, attempts + 1 AS attempts, row_number() OVER (ORDER BY (length(raw_text) >= 80) DESC, created_at DESC, id) AS place FROM contents
WHERE processed_at IS NULL AND (attempts = 0 OR created_at + to_minutes(CAST(least(360, greatest(1, pow(2, least(8, greatest(0, attempts - 1))))) AS BIGINT)) <= TIMESTAMP '2000-02-01') QUALIFY place <= 48"""))
def claimable_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 48 documents to work on: due ones, readable first, newest first."""
    return claim(contents(spark, sf_dir), F.lit("2000-02-01 00:00:00").cast("timestamp_ntz"), 48).select("id", F.col("attempts"), "place")


@query("SELECT sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))) AS fingerprint, count(*) AS rows, min(page) AS page FROM (SELECT o_orderkey, o_orderkey // 100 AS page FROM orders) GROUP BY page")
def page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is known by its sorted ids; one that was seen is dropped."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.floor(F.col("o_orderkey") / 100).cast("long").alias("page"))
    pages = o.groupBy("page").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("fingerprint"), F.count("*").alias("rows"))
    return pages.groupBy("fingerprint").agg(F.min_by("rows", "page").alias("rows"), F.min("page").alias("page"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' ORDER BY ts, event_id OFFSET 120")
def carry_over_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of 120 messages leaves for the next one."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    done = e.orderBy("ts", "event_id").limit(120).select("event_id")
    return e.join(F.broadcast(done), "event_id", "left_anti").select(F.col("event_id").alias("id"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type, sum(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS errors FROM events)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place,
       count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id, errors ORDER BY ts, event_id) AS streak FROM e""")
def per_key_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events applied strictly in order, keys side by side: its place, and events since the last error. A fifth of the events come a batch late."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").cast("int").alias("error"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    part = F.when(F.col("ts") < F.lit(first + third), 0).when(F.col("ts") < F.lit(first + 2 * third), 1).otherwise(2) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), far_future().alias("ts"), F.lit(0).alias("error"))
    batches = [e.filter(part == k) for k in range(3)] + [e.filter(part == 3), closing]
    lateness = f"{int(2 * third.total_seconds()) + 1} seconds"
    job = lambda fed: serially(fed.withWatermark("ts", lateness), "user_id", "ts", {"event_id": "long", "error": "int"}, _streak, {"place": "long", "streak": "long"})
    out = run_batches(spark, shared_folder(spark, "serial"), "user_id long, event_id long, ts timestamp, error int", batches, job)
    return out.filter("event_id >= 0").select("event_id", "user_id", "place", "streak")


def _streak(state, event):
    place, streak = state or (0, 0)
    state = (place + 1, 0 if event[2] else streak + 1)
    return state, state


#: Rows that a claim takes of each shard, and shards.
_TAKE, _SHARDS = 20, 8


@query(f"""
WITH d AS (SELECT doc_id AS id, doc_id % {_SHARDS} AS shard, row_number() OVER (PARTITION BY doc_id % {_SHARDS} ORDER BY (length(text) >= 80) DESC, n_chars DESC, doc_id) AS p FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, 'a' AS worker, 1 AS attempts FROM d WHERE p <= {_TAKE}), b AS (SELECT *, 'b' AS worker, 1 AS attempts FROM d WHERE p > {_TAKE} AND p <= {2 * _TAKE}),
c AS (SELECT id, shard, p, 'c' AS worker, 2 - CAST(p > {2 * _TAKE} AS INTEGER) AS attempts FROM d WHERE (p <= {_TAKE} AND id % 3 <> 0) OR p > {2 * _TAKE} QUALIFY row_number() OVER (PARTITION BY shard ORDER BY p) <= {_TAKE})
SELECT id, worker, attempts, 'leased' AS state FROM (FROM a UNION ALL BY NAME FROM b UNION ALL BY NAME FROM c)
UNION ALL SELECT id, 'a', 1, 'done' FROM a WHERE id % 3 = 0
UNION ALL SELECT id, 'b', 2, 'ignored' FROM c WHERE p <= {_TAKE}
UNION ALL SELECT id, 'c', attempts, 'done' FROM c""")
def leased_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as work: two workers claim, one ends a third of its rows, its other leases go stale and a third worker gets them; another's result for them is ignored."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), (F.col("doc_id") % _SHARDS).cast("int").alias("shard"), (F.char_length("text") >= 80).alias("readable"), "n_chars")
    # The order of claims as one number: readable first, then long ones, then ids.
    place = F.when(F.col("readable"), 0).otherwise(1).cast("long") * (1 << 61) + (F.lit((1 << 21) - 1) - F.coalesce("n_chars", F.lit(0))) * (1 << 40) + F.col("id")
    none = F.lit(None).cast("string")
    put = d.select("shard", F.lit("enqueue").alias("event"), "id", place.alias("place"), none.alias("worker"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("most"), none.alias("outcome"))

    def claims(worker: str, at: int) -> DataFrame:
        return spark.range(_SHARDS).select(F.col("id").cast("int").alias("shard"), F.lit("claim").alias("event"), F.lit(0).cast("long").alias("id"), F.lit(ord(worker)).cast("long").alias("place"), F.lit(worker).alias("worker"), F.lit(at).cast("long").alias("at"), F.lit(_TAKE).alias("most"), none.alias("outcome"))

    def ended(held: DataFrame, worker: str, at: int) -> DataFrame:
        return held.select((F.col("id") % _SHARDS).cast("int").alias("shard"), F.lit("done").alias("event"), "id", F.lit(0).cast("long").alias("place"), F.lit(worker).alias("worker"), F.lit(at).cast("long").alias("at"), F.lit(0).alias("most"), F.lit("ok").alias("outcome"))

    folder = shared_folder(spark, "queue")
    grants = run_batches(spark, folder, QUEUE, [put.unionByName(claims("a", 1)).unionByName(claims("b", 301))], leased)
    mine = grants.filter("worker = 'a'").select("id")
    grants = run_batches(spark, folder, QUEUE, [ended(mine.filter("id % 3 = 0"), "a", 360), claims("c", 601)], leased, first=1)
    third = grants.filter("worker = 'c' AND state = 'leased'").select("id", "attempts")
    late = ended(third.filter("attempts = 2").select("id"), "b", 700)
    return run_batches(spark, folder, QUEUE, [late.unionByName(ended(third.select("id"), "c", 701))], leased, first=3).select("id", "worker", "attempts", "state")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER))), ',') AS ids FROM events GROUP BY user_id")
def delta_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids out of a nested change feed, distinct."""
    feed = F.from_json(F.concat(F.lit('{"history":[{"added":[{"message":{"id":'), F.get_json_object("props", "$.k"), F.lit("}}]}]}")), "history array<struct<added:array<struct<message:struct<id:int>>>>>")
    e = table(spark, sf_dir, "events").select("user_id", F.explode(feed["history"]).alias("h")).select("user_id", F.explode("h.added").alias("a"))
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("a.message.id")), ",").alias("ids"))


@query("SELECT event_type, count(DISTINCT event_id) AS events, round(sum(value), 4) AS worth FROM events GROUP BY event_type")
def stream_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file twice through a stream that keeps what it has seen: the counts are those of one delivery."""
    return deduplicated_counts(spark, f"{sf_dir}/events.parquet")


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def extension_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions by a gap of 30 minutes."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


