"""Changes of clients applied in their numbers' order, by two chained ``transformWithState`` stages.

A change has a client and a number ``n``; numbers come out of order, repeat and
have gaps. The first stage keeps, for each (client, n), the first arrival and
rejects the rest; it is dealt by both, so a hot client spreads. The second
stage, by client, holds unique rows until their number is next, applies them,
and skips a gap when the earliest row held behind it has waited long enough.

Groups are *lanes*, and states of many keys share an entry of a lane's map (a
*bucket*, some ``BUCKET_CLIENTS`` clients and their numbers): Spark's Python runner sends several messages and an Arrow
batch for each group, and two messages for each entry that is read and written, which for one
row each cost 1.5 ms and 0.3 ms. Keys stay apart inside their bucket. A task holds the rows of
one lane in one batch, and the bucket it is at; what a bucket's clients hold is bounded by the rows of ``PATIENCE`` days.
Every batch carries a tick for each lane, so that starts of batches reach lanes
without rows, and the last one's ticks close the feed.

Cases: an empty table gives an empty result. Rows equal in all columns are one
row. A null client is a client like others. A null number comes after all
others of its client; a null change_id counts as an empty text, whose
checksum is 0; rows without ``valid_at`` vanish. Rows equal in client, number, day and
change_id are told apart by op, city and balance; the smallest, nulls first,
is the first arrival. An op other than I, U and D is applied and changes
nothing. A balance that isn't a number counts as null. Further columns only tell rows apart and aren't in the result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from veinwork.llm.common import arrow_batches, checkpointed, shared_folder

#: Days that the earliest held row waits for the numbers before it.
PATIENCE = 3
#: Clients of one bucket, in the mean.
BUCKET_CLIENTS = 64
#: Rows of a file of the feed, in the mean, at least.
FILE_ROWS = 50_000
#: Numbers of a client are ranked in ranges of so many values; ranges are added up afterwards.
RANGE_BITS = 12

#: State that is larger than memory needs RocksDB; a version of it is a log of changes, and files take only the disk they need.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}

#: Ids travel as text ('' for null), since pandas has no nullable integers by default; ``arrival`` orders change_ids.
CHANGE = "client string, n long, day int, arrival long, change_id string, op string, city string, balance double"
FED = f"{CHANGE}, bucket long, home long, lane int, tick boolean, closing boolean, horizon int"
PASSED = f"{FED}, batch int, rejected boolean"
DONE = "change_id string, client string, n long, op string, status string, batch int, missed long, city string, balance double"
RESULT = [x.split()[0] for x in DONE.split(", ")]
NONE_YET = -(2**31)


class FirstArrivals(StatefulProcessor):
    """Marks all rows of a (client, n) but its first one as rejected."""

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "bucket long", "pairs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows), ignore_index=True)
        columns = [d[c].tolist() for c in ("tick", "bucket", "client", "n", "day", "arrival", "op", "city", "balance")]
        # By key, then by arrival; op, city and balance only settle ties (nulls first).
        order = sorted((tick, bucket, client, n, day, arrival, *((v == v and v is not None, v) for v in rest), at) for at, (tick, bucket, client, n, day, arrival, *rest) in enumerate(zip(*columns)))
        rejected = [False] * len(d)
        for (tick, bucket), group in groupby(order, key=lambda r: r[:2]):
            if tick:
                continue
            found = self.seen.getValue((bucket,))
            seen = pickle.loads(found[0]) if found else set()
            for r in group:
                if r[2:4] in seen:
                    rejected[r[-1]] = True
                else:
                    seen.add(r[2:4])
            self.seen.updateValue((bucket,), (pickle.dumps(seen),))
        d["rejected"] = rejected
        yield d

    def close(self) -> None:
        pass


@dataclass
class Client:
    """The next number, the values so far, and the held rows by number: (day, change_id, op, city, balance)."""

    next: int = 1
    city: str | None = None
    balance: float | None = None
    held: dict[int, tuple] = field(default_factory=dict)

    def due(self, horizon: int) -> bool:
        return bool(self.held) and self.earliest() + PATIENCE <= horizon

    def earliest(self) -> int:
        return min(x[0] for x in self.held.values())

    def skip(self, name: str, batch: int, horizon: int | None) -> Iterator[tuple]:
        """Jump to the smallest held number while the earliest held row has waited long enough (always, without a horizon)."""
        while self.held and (horizon is None or self.due(horizon)):
            missed = min(self.held) - self.next
            self.next += missed
            yield from self.apply(name, batch, missed)

    def apply(self, name: str, batch: int, missed: int = 0) -> Iterator[tuple]:
        """Apply held rows from the next number on, as far as they follow one another."""
        while self.next in self.held:
            n = self.next
            _, change_id, op, city, balance = self.held.pop(n)
            if op == "I":
                self.city, self.balance = city, balance
            elif op == "U":
                self.city, self.balance = self.city if city is None else city, self.balance if balance is None else balance
            elif op == "D":
                self.city = self.balance = None
            self.next += 1
            yield change_id, name, n, op, "applied", batch, missed, self.city, self.balance
            missed = 0


class Sequencer(StatefulProcessor):
    """Applies the unique rows of each client of a lane in the order of their numbers."""

    def init(self, handle) -> None:
        self.buckets = handle.getMapState("buckets", "bucket long", "clients binary")
        self.waiting = handle.getMapState("waiting", "bucket long", "earliest int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # rejected by the first stage
            for d in rows:
                yield d.assign(status="rejected", missed=0, city=None, balance=None)[RESULT]
            return
        d = pd.concat(list(rows), ignore_index=True)
        batch, horizon, closing = int(d["batch"].iat[0]), int(d["horizon"].iat[0]), bool(d["closing"].any())
        columns = (d[c].tolist() for c in ("tick", "home", "client", "n", "day", "change_id", "op", "city", "balance"))
        unique = sorted(((*r[1:8], r[8] if r[8] == r[8] else None) for r in zip(*columns) if not r[0]), key=lambda r: r[:3])
        arrived = {home: list(group) for home, group in groupby(unique, key=lambda r: r[0])}
        before = {bucket: earliest for (bucket,), (earliest,) in self.waiting.iterator()}
        touched = arrived.keys() | {b for b, earliest in before.items() if closing or earliest + PATIENCE <= horizon}
        out: list[tuple] = []
        for bucket in sorted(touched):
            found = self.buckets.getValue((bucket,))
            clients: dict[str, Client] = {c: Client(*x) for c, x in pickle.loads(found[0]).items()} if found else {}
            if before.get(bucket, horizon) + PATIENCE <= horizon:
                for name, client in clients.items():
                    out += client.skip(name, batch, horizon)
            for name, group in groupby(arrived.get(bucket, ()), key=lambda x: x[1]):
                client = clients.setdefault(name, Client())
                for _, _, n, *row in group:
                    if n < client.next:
                        out.append((row[1], name, n, row[2], "rejected", batch, 0, None, None))
                    else:
                        client.held[n] = tuple(row)
                out += client.apply(name, batch)
            if closing:
                for name, client in clients.items():
                    out += client.skip(name, batch + 1, None)
            self.buckets.updateValue((bucket,), (pickle.dumps({c: (x.next, x.city, x.balance, x.held) for c, x in clients.items()}),))
            earliest = min((x.earliest() for x in clients.values() if x.held), default=None)
            if earliest is not None:
                self.waiting.updateValue((bucket,), (earliest,))
            elif bucket in before:
                self.waiting.removeKey((bucket,))
        if out:
            yield pd.DataFrame(out, columns=RESULT)

    def close(self) -> None:
        pass


def dense_numbers(changes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n) for each distinct pair: the dense rank of the value within its key, a null value last.

    Ranks are taken within ranges of 4,096 values, then moved by the sizes of the ranges before: a window
    never holds all values of a hot key where they lie close together.
    """
    pairs = changes.groupBy(key, value).agg(F.first(F.lit(1)).alias("one_")).withColumn("range_", F.shiftright(value, RANGE_BITS))
    last = F.col(value).asc_nulls_last()
    ranked = pairs.withColumn("k_", F.row_number().over(Window.partitionBy(key, "range_").orderBy(last)))
    sizes = pairs.groupBy(key, "range_").agg(F.count("*").alias("size_"))
    before = F.sum("size_").over(Window.partitionBy(key).orderBy(F.col("range_").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.select(F.col(key).alias("key_"), F.col("range_").alias("of_"), F.coalesce(before, F.lit(0)).alias("before_"))
    return ranked.join(moved, F.col(key).eqNullSafe(F.col("key_")) & F.col("range_").eqNullSafe(F.col("of_"))).select(key, value, (F.col("k_") + F.col("before_")).cast("long").alias("n"))


def _dealt(many: int, *by: Column | str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(many))


def write_feed(rows: DataFrame, folder: str, batches: int, lanes: int, buckets: int) -> None:
    """Write ``rows`` (as in CHANGE, with ``batch`` from 1) and the ticks of all lanes as one folder for each batch.

    A row knows its batch's horizon, the largest day of earlier batches.
    """
    spark = rows.sparkSession
    found = rows.groupBy("batch").agg(F.max("day").alias("day"), F.count("*").alias("rows")).collect()  # a row for each batch
    largest, pieces = {r.batch: r.day for r in found}, 1 + max((r.rows for r in found), default=0) // FILE_ROWS
    horizon, found = [], NONE_YET
    for b in range(1, batches + 1):
        horizon.append((b, found))
        found = max(found, largest.get(b, found))
    of_batch = F.broadcast(spark.createDataFrame(horizon, "batch int, horizon int"))
    change = [x.split() for x in CHANGE.split(", ")]
    ticks = spark.range(lanes).withColumn("b_", F.explode(F.sequence(F.lit(1), F.lit(batches))))
    ticks = ticks.select(*[F.lit("" if t == "string" else 0).cast(t).alias(c) for c, t in change], F.lit(-1).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("home"), F.col("id").cast("int").alias("lane"), F.lit(True).alias("tick"), (F.col("b_") == batches).alias("closing"), F.col("b_").alias("batch"))
    bucket = _dealt(buckets, "client", "n")
    fed = rows.select(*[c for c, _ in change], bucket.alias("bucket"), _dealt(buckets, "client").alias("home"), (bucket % lanes).cast("int").alias("lane"), F.lit(False).alias("tick"), F.lit(False).alias("closing"), "batch")
    fed.unionByName(ticks).join(of_batch, "batch").repartition("batch", _dealt(pieces, "bucket")).write.partitionBy("batch").parquet(f"{folder}/feed")


def sequenced(fed: DataFrame, lanes: int) -> DataFrame:
    """The two stages over a stream of FED rows with their ``batch``: keyed by client and number, then by client."""
    once = fed.groupBy("lane").transformWithStateInPandas(FirstArrivals(), _fields(fed), "append", "None")
    rejected = -1 - _dealt(lanes, "change_id", "client", "n").cast("int")
    by_client = once.withColumn("lane", F.when(F.col("rejected"), rejected).when(F.col("tick"), F.col("lane")).otherwise((F.col("home") % lanes).cast("int")))
    return by_client.groupBy("lane").transformWithStateInPandas(Sequencer(), DONE, "append", "None")


def _fields(fed: DataFrame) -> str:
    """The first stage passes rows on, in the stream's order of columns."""
    kinds = dict(x.split() for x in PASSED.split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in [*fed.columns, "rejected"])


def apply_batches(spark: SparkSession, folder: str, batches: int, lanes: int) -> DataFrame:
    """Feed the batches under ``folder`` in order, each to a query started anew on one checkpoint; all of the results.

    A batch that was under way when its query failed is taken up again by the next start: what state and sink have
    committed isn't done twice.
    """
    arrow_batches(spark)
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        for b in range(1, batches + 1):
            upto = ",".join(str(k) for k in range(1, b + 1))
            fed = spark.readStream.schema(f"{FED}, batch int").option("basePath", f"{folder}/feed").parquet(f"{folder}/feed/batch={{{upto}}}")
            query = sequenced(fed, lanes).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    done = spark.read.schema(DONE).parquet(f"{folder}/out")
    ids = {c: F.when(F.col(c) != "", F.col(c)) for c in ("client", "change_id")}
    return done.withColumns(ids)


def change_digest(changes: DataFrame, batches: int = 12, first_day: int = 19723, days: int = 160, lanes: int | None = None) -> DataFrame:
    """Every row that takes part, with its outcome: the contract's columns, ``n`` and ``op``.

    ``lanes`` are two for each partition of the state unless given.
    """
    spark = changes.sparkSession
    lanes = lanes or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = ["change_id", "client_id", "seq", "op", "valid_at", "city", "balance"]
    rows = checkpointed(changes.distinct().select(*own))
    numbers = dense_numbers(rows, "client_id", "seq").select(F.col("client_id").alias("c_"), F.col("seq").alias("s_"), "n")
    h = F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")), F.lit(0))
    day = (F.datediff("valid_at", F.lit("1970-01-01").cast("date")) + 9 * (h % 4)).cast("int")
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / days))).cast("int")
    rows = rows.join(numbers, F.col("client_id").eqNullSafe(F.col("c_")) & F.col("seq").eqNullSafe(F.col("s_")))
    rows = rows.filter(F.col("valid_at").isNotNull() & (h % 11 != 0)).withColumn("day", day).withColumn("batch", batch)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("client_id", "change_id")}
    arrival = F.coalesce(F.col("change_id"), F.lit(-(2**63)).cast("long"))
    rows = checkpointed(rows.select(text["client_id"].alias("client"), "n", "day", arrival.alias("arrival"), text["change_id"].alias("change_id"), "op", "city", "balance", "batch"))
    buckets = max(lanes, rows.select("client").distinct().count() // BUCKET_CLIENTS)
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    write_feed(rows, folder, batches, lanes, buckets)
    done = apply_batches(spark, folder, batches, lanes).withColumns({"client": F.col("client").cast("long"), "change_id": F.col("change_id").cast("long")})
    applied = F.col("status") == "applied"
    last = done.filter(applied).groupBy("client").agg(F.max("n").alias("l_")).select(F.col("client").alias("c_"), "l_")
    found = done.join(last, F.col("client").eqNullSafe(F.col("c_")) & (F.when(applied, F.col("n")) == F.col("l_")), "left")
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    current = F.col("l_").isNotNull() & ~F.col("op").eqNullSafe("D")
    return found.select("change_id", F.col("client").alias("client_id"), "status", "batch", "missed", "city", cents.alias("cents"), current.alias("current"), "n", "op")
