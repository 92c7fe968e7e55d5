"""Sinks and the state of retried work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.plans.base import query
from veinwork.sources.tables import contents, table, with_
from veinwork.streaming.sinks import after_try, rejecting, replayed_upsert, shared_folder, stale_runs

RULES = {"event_type": "incoming", "value": "greatest"}


@query("""
SELECT 'first' AS run, 'new' AS outcome, CAST(count(*) AS BIGINT) AS rows, round(sum(v), 3) AS worth FROM (SELECT user_id, max(value) AS v FROM events GROUP BY user_id)
UNION ALL SELECT 'second', 'unchanged', count(*), round(sum(v), 3) FROM (SELECT user_id, max(value) AS v FROM events GROUP BY user_id)""")
def upsert_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed through an upsert into a stored table, and the whole feed again: nothing changes the second time."""
    outcomes, stored = replayed_upsert(spark, f"{sf_dir}/events.parquet", "user_id", RULES, lambda feed: feed.select("user_id", F.concat(F.lit("u"), F.col("user_id")).alias("event_type"), "value"))
    return outcomes.crossJoin(F.broadcast(stored.agg(F.round(F.sum("value"), 3).alias("worth"))))


@query("""
SELECT CASE WHEN value IS NULL OR value < 0 THEN 'no value' WHEN event_type = 'error' THEN 'error event' ELSE 'accepted' END AS kind, count(*) AS rows, sum(event_id) AS ids FROM events GROUP BY 1""")
def reject_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch split into two stored tables, written twice: the replay replaces what it wrote."""
    folder = shared_folder(spark, "rejects")
    split = rejecting(f"{folder}/accepted", f"{folder}/refused", [("no value", F.col("value").isNull() | (F.col("value") < 0)), ("error event", F.col("event_type") == "error")])
    e = table(spark, sf_dir, "events")
    for _ in range(2):
        split(e, 0)
    accepted = spark.read.parquet(f"{folder}/accepted").select(F.lit("accepted").alias("kind"), "event_id")
    refused = spark.read.parquet(f"{folder}/refused").select(F.col("reason").alias("kind"), F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))
    return accepted.unionByName(refused).groupBy("kind").agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


@query(with_("contents", """
SELECT id, CASE WHEN mime_type IS NOT NULL AND length(raw_text) >= 80 THEN 'done' WHEN mime_type IS NOT NULL THEN 'unreadable' WHEN attempts + 2 >= 8 THEN 'given up' ELSE 'waiting' END AS state,
       CASE WHEN mime_type IS NULL AND attempts + 2 < 8 THEN CAST(least(360, greatest(1, pow(2, least(8, greatest(0, attempts + 1))))) AS BIGINT) END AS minutes FROM contents WHERE raw_text IS NOT NULL"""))
def retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work after a try: done, over with an error, waiting for its next try, or given up."""
    now = F.lit("2000-02-01 00:00:00").cast("timestamp_ntz")
    work = contents(spark, sf_dir).filter("raw_text is not null").select("id", (F.col("attempts") + 2).alias("attempts"), F.col("mime_type").isNotNull().alias("read"), (F.char_length("raw_text") >= 80).alias("readable"))
    found = after_try(work, now)
    return found.select("id", "state", F.timestamp_diff("MINUTE", now, F.col("due_at")).alias("minutes"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 3 MINUTE THEN 'error' WHEN o_orderstatus = 'O' THEN 'syncing' ELSE 'ok' END AS status FROM orders""")
def stale_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that have been syncing for more than three minutes are errors."""
    o = table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate")).first()[0]
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "syncing").otherwise("ok").alias("status"), F.col("o_orderdate").alias("started_at"))
    return stale_runs(runs, F.lit(str(now)).cast("timestamp_ntz")).select("id", "status")
