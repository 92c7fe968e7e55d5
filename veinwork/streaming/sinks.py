"""Sinks that survive replays: stored tables in buckets with numbered commits, upserts and appends by batch, and state of retried work.

A stored table keeps its rows in buckets by a hash of their key. A commit writes anew only the buckets that its rows
touch, as files of its own, and then publishes one small file that names, for every bucket, where its rows are. The
file comes into being by a rename that fails where its number is taken: readers see the version before or the new one
whatever step a writer dies at, and of two writers one has to begin again. A batch that is delivered again (after a crash, or by a
second run) finds its number or its rows there and changes nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinwork.functions.dates import backoff_minutes
from veinwork.operators.merge import merged_rows
from veinwork.sources.manifest import read_json, replace_json


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder under ``spark.checkpoint.dir``; only a local session without one (a test) gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veinwork-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Conflict(Exception):
    """Another writer has published this version."""


#: Versions whose files are kept for readers that began with them.
KEPT_VERSIONS = 3


class Stored:
    """A table in a folder: ``log/<version>.json`` names each bucket's files under ``data``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, log = self._files(), self._path("log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, version: int | None = None) -> dict | None:
        """A version's commit (the latest): version, batch, run, buckets, schema, and files by bucket."""
        known = self.versions()
        if not known:
            return None
        return read_json(f"{self.folder}/log", f"{known[-1] if version is None else version:010}.json")

    def version(self) -> tuple[int, str] | None:
        """(batch, run) of the latest commit."""
        found = self.commit()
        return None if found is None else (found["batch"], found["run"])

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, commit: dict | None = None) -> DataFrame | None:
        """The latest version's rows (or those of some of its buckets): the named files, no others."""
        found = commit or self.commit()
        if found is None:
            return None
        paths = [f"{self.folder}/data/{at}" for b, at in sorted(found["files"].items()) if only is None or int(b) in only]
        schema = T.StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, key: str, batch: int, run: str, touched: list[int] | None = None, after: dict | None = None) -> None:
        """The next version: ``df`` is all that the ``touched`` buckets (or all) hold from now on, ``after`` the commit that it was made from.

        Files are complete before they are named. A failed writer leaves files that nothing names.
        """
        before = after or self.commit()
        if before is not None and before["buckets"] != self.buckets:
            raise ValueError(f"the table has {before['buckets']} buckets")
        name = uuid.uuid4().hex
        df.withColumn("_bucket", self.bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{name}")
        fs, own = self._files(), self._path(f"data/{name}")
        made = [s.getPath().getName() for s in fs.listStatus(own) if s.isDirectory()]
        gone = set(range(self.buckets) if touched is None else touched)
        files = {b: at for b, at in (before or {"files": {}})["files"].items() if int(b) not in gone}
        files |= {d.partition("=")[2]: f"{name}/{d}" for d in made}
        version = before["version"] + 1 if before else 0
        self._publish(version, {"version": version, "batch": batch, "run": run, "buckets": self.buckets, "schema": json.loads(df.schema.json()), "files": files})
        self._forget(version)

    def _publish(self, version: int, commit: dict) -> None:
        draft = f".{uuid.uuid4().hex}"
        replace_json(f"{self.folder}/log", draft, commit)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(f"log/{draft}"), self._path(f"log/{version:010}.json"), no_overwrite)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass()):
                raise Conflict(f"version {version} exists") from None
            raise

    def _forget(self, version: int) -> None:
        """Drop versions before the last few, and files that none of the rest names."""
        fs, old = self._files(), [v for v in self.versions() if v <= version - KEPT_VERSIONS]
        if not old:
            return
        kept = {at for v in self.versions() if v not in old for at in self.commit(v)["files"].values()}
        gone = {at for v in old for at in self.commit(v)["files"].values()} - kept
        for v in old:
            fs.delete(self._path(f"log/{v:010}.json"), False)
        for at in gone:
            fs.delete(self._path(f"data/{at}"), True)


def upsert(stored: Stored, key: str, rules: dict[str, str], run: str, on_outcome: Callable[[int, DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function for ``foreachBatch``: merge by key, and report how many rows were new, updated or unchanged.

    Reads and writes the buckets that the batch's keys fall into. A batch of the same run that was written before is skipped;
    rows that come again with the same content are unchanged. If another writer was first, the batch is merged again into what that one left.
    """

    def merge(batch: DataFrame, number: int) -> None:
        values = batch.groupBy(key).agg(*[F.max_by(c, F.struct(*[x for x in batch.columns if x != key])).alias(c) for c in rules]).persist()
        while True:
            before = stored.commit()
            if before and before["run"] == run and before["batch"] >= number:
                break
            touched = sorted(r[0] for r in values.select(stored.bucket(key)).distinct().collect())  # at most the table's buckets
            old = stored.read(touched, before) if before else batch.sparkSession.createDataFrame([], values.schema)
            merged = merged_rows(old.select(values.columns), values, key, rules).persist()
            try:
                stored.write(merged.drop("outcome"), key, number, run, touched, before)
            except Conflict:
                merged.unpersist()
                continue
            if on_outcome:
                on_outcome(number, merged.filter("outcome <> 'kept'").groupBy("outcome").agg(F.count("*").alias("rows")))
            merged.unpersist()
            break
        values.unpersist()

    return merge


def rejecting(accepted: str, refused: str, rules: list[tuple[str, Column]]) -> Callable[[DataFrame, int], None]:
    """A batch function that appends passing rows to one folder and failing ones, with reason and payload, to another; each batch has its own folder, so a replay overwrites it."""

    def split(batch: DataFrame, number: int) -> None:
        reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules])
        named = batch.withColumn("reason", reason)
        named.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        named.filter("reason is not null").select("reason", F.to_json(F.struct(*batch.columns)).alias("payload")).write.mode("overwrite").parquet(f"{refused}/batch={number}")

    return split


def replayed_upsert(spark: SparkSession, path: str, key: str, rules: dict[str, str], prepare: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(outcomes by run, stored rows): a folder of files through the upsert, the whole feed delivered twice.

    The second run has no checkpoint of the first, as after a lost cursor.
    """
    folder = shared_folder(spark, "upsert")
    stored, schema, outcomes = Stored(spark, f"{folder}/table"), spark.read.parquet(path).schema, []
    parent, _, name = path.rpartition("/")
    for run in ("first", "second"):
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
        feed = reader.option("pathGlobFilter", name).parquet(parent) if _is_file(spark, path) else reader.parquet(path)
        note = lambda number, counts, run=run: outcomes.extend((run, r["outcome"], r["rows"]) for r in counts.collect())
        job = prepare(feed).writeStream.foreachBatch(upsert(stored, key, rules, run, note)).option("checkpointLocation", f"{folder}/cursor-{run}").trigger(availableNow=True).start()
        job.awaitTermination()
    return spark.createDataFrame(outcomes, "run string, outcome string, rows long").groupBy("run", "outcome").agg(F.sum("rows").alias("rows")), stored.read()


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


#: Tries after which work is given up.
MOST_TRIES = 8


def after_try(work: DataFrame, now: Column) -> DataFrame:
    """State of work after a try: ``work`` has attempts (with this one), read (bytes were there), readable (they gave a text).

    Read and readable is done; read but unreadable is over with an error; not
    read waits, longer each time, until ``MOST_TRIES``.
    """
    wait = F.make_dt_interval(mins=backoff_minutes(F.col("attempts")))
    state = F.when(F.col("read") & F.col("readable"), "done").when(F.col("read"), "unreadable").when(F.col("attempts") >= MOST_TRIES, "given up").otherwise("waiting")
    return work.withColumn("state", state).withColumn("due_at", F.when(F.col("state") == "waiting", now + wait))


def stale_runs(runs: DataFrame, now: Column, minutes: int = 3) -> DataFrame:
    """Runs with ``status`` and ``started_at``: those that have been syncing for too long are errors."""
    late = (F.col("status") == "syncing") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumn("status", F.when(late, "error").otherwise(F.col("status"))).withColumn("message", F.when(late, F.lit("no sign of life")))
