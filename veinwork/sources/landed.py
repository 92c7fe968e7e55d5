"""Landed feeds: what clients of remote sources fetched, in the order of its delivery, read through a Python data source.

A feed is a folder. ``land`` appends records (pages, applications, messages) and
gives each the next position; a manifest names what is complete. The data source
``landed`` reads a feed as a table or as a stream:

* a batch read takes all positions, a task for each range of them;
* a stream's offset is the cursor: the next position, and the day of the last record before it. A run takes at most
  ``most`` positions and leaves the rest for the next one, so nothing is lost whatever the budget, and the
  cursor moves only over what was planned.

A feed may ``retire`` its oldest records. A stream whose cursor points at retired
ones has expired: it falls back to all records of the days since its last one, less
one day of overlap, and marks them ``overlap``; a consumer drops those it has by their key.

Option ``cursor`` names a folder in which a stream keeps the end of the last range it planned. Spark asks for the latest offset without
telling the current one; with this a stream that was killed goes on with its budget. Without it a
run takes all there is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from veinwork.operators.ordering import positions
from veinwork.sources.manifest import file_system, read_json, replace_json

#: Least positions in one file folder, which is what a task reads; and the most file folders of a landing, so that a large one has larger files.
RANGE, FOLDERS = 500, 256


MANIFEST = "manifest.json"


def manifest(folder: str) -> dict:
    """The feed's complete landings: name, positions in a file folder, first position, count, first and last day; and the next free position."""
    return read_json(folder, MANIFEST) or {"next": 0, "landings": []}


def land(records: DataFrame, folder: str, order: list[str], day: str | None = None) -> dict:
    """Append records in their order to a feed; the manifest after it.

    A landing that fails leaves files that no manifest names.
    """
    known = manifest(folder)
    name = f"landing-{uuid.uuid4().hex}"
    placed = positions(records, *order).withColumn("position", F.col("position") + known["next"])
    if day is not None:
        placed = placed.withColumn("_day", F.col(day).cast("date").cast("string"))
    # ``positions`` has written the rows down: counting them reads no source again.
    size = max(RANGE, -(-placed.count() // FOLDERS))
    placed.withColumn("_file", F.floor(F.col("position") / size)).repartition("_file").sortWithinPartitions("_file", "position").write.partitionBy("_file").parquet(f"{folder}/{name}")
    spark = records.sparkSession
    written = spark.read.schema("position long, _day string").parquet(f"{folder}/{name}") if day is not None else spark.read.schema("position long").parquet(f"{folder}/{name}").withColumn("_day", F.lit(None).cast("string"))
    count, first_day, last_day = written.agg(F.count("*"), F.min("_day"), F.max("_day")).first()
    if count:
        known["landings"].append({"name": name, "range": size, "first": known["next"], "count": count, "first_day": first_day, "last_day": last_day})
        known["next"] += count
    replace_json(folder, MANIFEST, known)
    return known


def retire(folder: str, before: int) -> dict:
    """Give up landings that lie wholly before a position."""
    known = manifest(folder)
    known["landings"] = [x for x in known["landings"] if x["first"] + x["count"] > before]
    replace_json(folder, MANIFEST, known)
    return known


@dataclass
class Piece(InputPartition):
    """Positions ``first`` to ``end`` (exclusive) of one file folder; with ``since``, only records of that day and later."""

    path: str
    first: int
    end: int
    mode: str
    since: str | None = None


def _pieces(folder: str, known: dict, first: int, end: int, mode: str, since: str | None = None) -> list[Piece]:
    out = []
    for x in known["landings"]:
        a, b = max(first, x["first"]), min(end, x["first"] + x["count"])
        if since is not None and x["last_day"] is not None and x["last_day"] < since:
            continue
        size = x["range"]
        for k in range(a // size, (b - 1) // size + 1) if a < b else ():
            out.append(Piece(f"{folder}/{x['name']}/_file={k}", max(a, k * size), min(b, (k + 1) * size), mode, since))
    return out


def _records(piece: Piece, schema) -> Iterator:
    """The piece's records as Arrow batches with the columns of ``schema``; ``mode`` says how they came."""
    import pyarrow as pa
    import pyarrow.dataset as ds
    from pyspark.sql.pandas.types import to_arrow_schema

    files, path = file_system(piece.path)
    wanted = to_arrow_schema(schema)
    stored = ds.dataset(path, filesystem=files, format="parquet")
    keep = (ds.field("position") >= piece.first) & (ds.field("position") < piece.end)
    if piece.since is not None:
        keep &= ds.field("_day") >= piece.since
    for batch in stored.scanner(columns=[f.name for f in wanted if f.name != "mode"], filter=keep).to_batches():
        if batch.num_rows:
            mode = pa.array([piece.mode] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([mode if f.name == "mode" else batch.column(f.name).cast(f.type) for f in wanted], schema=wanted)


class Landed(DataSource):
    """``spark.read.format("landed").schema(...).load(folder)``, or ``readStream``; the schema names stored columns, ``position`` and ``mode``."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self):
        raise ValueError("the schema of a landed feed has to be given")

    def reader(self, schema):
        return _Table(self.options["path"], schema)

    def streamReader(self, schema):
        return _Feed(self.options["path"], schema, int(self.options.get("most", 0)), self.options.get("cursor"))


class _Table(DataSourceReader):
    def __init__(self, folder: str, schema):
        self.folder, self.kind = folder, schema

    def partitions(self):
        known = manifest(self.folder)
        return _pieces(self.folder, known, 0, known["next"], "table")

    def read(self, partition):
        return _records(partition, self.kind)


class _Feed(DataSourceStreamReader):
    def __init__(self, folder: str, schema, most: int, cursor: str | None):
        if most and not cursor:
            raise ValueError("a budget (most) needs a cursor folder")
        self.folder, self.kind, self.most, self.cursor = folder, schema, most, cursor
        self.planned = read_json(cursor, "planned.json") if cursor else None

    def initialOffset(self) -> dict:
        known = manifest(self.folder)
        self.planned = {"position": 0, "day": "", "historical": known["next"]}
        return self.planned

    def latestOffset(self) -> dict:
        known, at = manifest(self.folder), self.planned
        start = at["position"] if at else 0
        first = min((x["first"] for x in known["landings"]), default=known["next"])
        expired = at is not None and start < first and start > 0
        end = known["next"]
        if self.most and not expired:
            end = min(end, max(start, first) + self.most)
        end = max(end, start)
        # The last day up to the end: of whole landings, so never too late for the overlap by more than the landing itself.
        days = [x["first_day"] for x in known["landings"] if x["first"] < end and x["first_day"]]
        whole = [x["last_day"] for x in known["landings"] if x["first"] + x["count"] <= end and x["last_day"]]
        day = max([*whole, *days, at["day"] if at else ""], default="")
        return {"position": end, "day": day, "historical": at["historical"] if at else known["next"]}

    def partitions(self, start: dict, end: dict):
        known = manifest(self.folder)
        if self.cursor:
            replace_json(self.cursor, "planned.json", end)
        self.planned = end
        first = min((x["first"] for x in known["landings"]), default=known["next"])
        if 0 < start["position"] < first:
            import datetime as dt

            since = str(dt.date.fromisoformat(start["day"]) - dt.timedelta(days=1)) if start["day"] else ""
            return _pieces(self.folder, known, first, end["position"], "overlap", since)
        split = min(max(start["historical"], start["position"]), end["position"])
        return [*_pieces(self.folder, known, start["position"], split, "historical"), *_pieces(self.folder, known, split, end["position"], "history")]

    def read(self, partition):
        return _records(partition, self.kind)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landed)


def deliver(spark: SparkSession, feed: str, schema: str, folder: str, most: int = 0, runs: int | None = None) -> DataFrame:
    """Run a feed's stream into a Parquet sink, a run after the other, until nothing is left (or ``runs`` are done); all that was delivered.

    Cursor, checkpoint and output lie under ``folder``; calling it again goes on from there. Without a number of runs, those with a
    budget are the micro-batches of one started stream: each takes at most ``most`` and moves the cursor, and none waits for a start.
    """
    register(spark)
    for _ in range(runs or 10_000):
        stream = spark.readStream.format("landed").schema(schema).option("most", most).option("cursor", f"{folder}/cursor").load(feed)
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        if most and runs is None:
            query = sink.trigger(processingTime="0 seconds").start()
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        else:
            sink.trigger(availableNow=True).start().awaitTermination()
        planned = read_json(f"{folder}/cursor", "planned.json")
        if planned is None or planned["position"] >= manifest(feed)["next"]:
            break
    return spark.read.schema(schema).parquet(f"{folder}/out")
