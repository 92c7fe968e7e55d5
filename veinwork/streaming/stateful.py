"""Keyed state over micro-batches: a work queue with leases, and work that is serial by key.

Both are ``transformWithState`` operators on RocksDB; a stream that was killed goes on from its checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The state store of these operators.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """Within it, streams start with RocksDB as their state store; the session's settings come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# A work queue with leases

#: Minutes after which a claim without a result is stale; claims after which work is given up.
LEASE_MINUTES, MOST_CLAIMS = 10, 8
#: Entries of a shard's state that its rows share.
QUEUE_BUCKETS = 1024
QUEUE = "shard int, event string, id long, place long, worker string, at long, most int, outcome string"
GRANTS = "id long, worker string, at long, attempts int, state string"


class LeaseQueue(StatefulProcessor):
    """One shard of a work queue: rows wait, are leased to a worker, and end or come back.

    Events (rows of QUEUE; ``at`` in seconds) of a micro-batch take effect in the order of ``at``, then as listed:

    * ``done``: the worker that holds the lease ends the row's work with ``outcome`` ok (state done) or
      error (waiting again, or given up after ``MOST_CLAIMS`` claims); of any other worker it's ignored (state ignored);
    * ``enqueue``: a row waits, in order of ``place``; a row that is known is ignored;
    * ``claim``: ``worker`` takes at most ``most`` rows: waiting ones and those whose lease is
      ``LEASE_MINUTES`` old, by place; each with one attempt more (state leased). A stale row that has had ``MOST_CLAIMS`` is given up.

    Only work that goes on is read for a claim; what has ended is looked up by id. A shard is one key, so two claims can't meet a row at once: a lease is part of the shard's state.
    Rows share ``QUEUE_BUCKETS`` entries of that state (by a hash of the id): an entry for each row would be a message each.
    """

    ORDER = {"done": 0, "enqueue": 1, "claim": 2}

    def init(self, handle) -> None:
        self.items = handle.getMapState("items", "bucket long", "rows binary")
        self.ended = handle.getMapState("ended", "bucket long", "attempts binary")

    @staticmethod
    def bucket(i: int) -> int:
        return (int(i) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) % 2**60 * QUEUE_BUCKETS >> 60

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        events["_order"] = events["event"].map(self.ORDER)
        stored = {b: pickle.loads(x) for (b,), (x,) in self.items.iterator()}
        items = {i: x for found in stored.values() for i, x in found.items()}  # of work that goes on: [place, attempts, worker, since]
        changed: set[int] = set()  # rows whose entry has to be written
        over: dict[int, dict[int, int]] = {}  # entries of ended work that were looked up
        closed: set[int] = set()

        def ended(i: int) -> dict[int, int]:
            b = self.bucket(i)
            if b not in over:
                found = self.ended.getValue((b,))
                over[b] = pickle.loads(found[0]) if found else {}
            return over[b]

        out: list[tuple] = []

        def end(i: int) -> None:
            ended(i)[i] = items.pop(i)[1]
            changed.add(i)
            closed.add(self.bucket(i))

        for e in events.sort_values(["at", "_order", "place", "id"]).itertuples(index=False):
            if e.event == "enqueue":
                if e.id not in items and e.id not in ended(e.id):
                    items[e.id] = [e.place, 0, None, 0]
                    changed.add(e.id)
            elif e.event == "done":
                x = items.get(e.id)
                if x is None or x[2] != e.worker:
                    out.append((e.id, e.worker, e.at, x[1] if x else ended(e.id).get(e.id, 0), "ignored"))
                elif e.outcome == "ok" or x[1] >= MOST_CLAIMS:
                    out.append((e.id, e.worker, e.at, x[1], "done" if e.outcome == "ok" else "given up"))
                    end(e.id)
                else:
                    out.append((e.id, e.worker, e.at, x[1], "waiting"))
                    x[2:] = [None, 0]
                    changed.add(e.id)
            else:
                taken = 0
                for _, i in sorted((x[0], i) for i, x in items.items() if x[2] is None or x[3] + 60 * LEASE_MINUTES <= e.at):
                    x = items[i]
                    if x[1] >= MOST_CLAIMS:  # stale, and the last of its claims
                        out.append((i, e.worker, e.at, x[1], "given up"))
                        end(i)
                    elif taken < e.most:
                        taken += 1
                        x[1:] = [x[1] + 1, e.worker, e.at]
                        out.append((i, e.worker, e.at, x[1], "leased"))
                        changed.add(i)
        touched: dict[int, dict[int, list]] = {self.bucket(i): {} for i in changed}
        for i, x in items.items():
            if (b := self.bucket(i)) in touched:
                touched[b][i] = x
        for b, found in touched.items():
            if found:
                self.items.updateValue((b,), (pickle.dumps(found),))
            elif b in stored:
                self.items.removeKey((b,))
        for b in closed:
            self.ended.updateValue((b,), (pickle.dumps(over[b]),))
        if out:
            yield pd.DataFrame(out, columns=["id", "worker", "at", "attempts", "state"])

    def close(self) -> None:
        pass


def leased(events: DataFrame) -> DataFrame:
    """GRANTS out of a stream of QUEUE events; each shard is a key of its own."""
    return events.groupBy("shard").transformWithStateInPandas(LeaseQueue(), GRANTS, "append", "None")


# Serial work by key


#: Entries of a lane's state that share its keys.
BUCKETS = 64


class Serial(StatefulProcessor):
    """Applies each key's events strictly in the order of (time, id), across micro-batches.

    An event is held until the watermark has passed its time; then nothing that comes can precede it. What comes later still
    is handed on as late by Spark (it is dropped) and never applied out of order. ``step(state, event)`` returns the next
    state and an output value; events are tuples.

    A group is a lane (a hash of the key), and keys of a lane share ``BUCKETS`` entries of its state: a group or timer for each key
    would cost milliseconds for a few rows. Keys stay apart inside their entry. A lane has one timer, at its earliest held event.
    """

    def __init__(self, step: Callable, at: str, columns: list[str], key: str, result: list[str]):
        self.step, self.at, self.columns, self.key, self.result = step, at, columns, key, result

    def init(self, handle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "bucket long", "keys binary")
        self.waiting = handle.getMapState("waiting", "bucket long", "earliest long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, dict[str | None, list[tuple]]] = {}
        for d in rows:
            times = (d[self.at].astype("int64") // 10 ** (9 if d[self.at].dtype.str.endswith("[ns]") else 6)).tolist()
            for bucket, name, *event in zip(d["bucket"].tolist(), d[self.key].tolist(), times, *(d[c].tolist() for c in self.columns)):
                arrived.setdefault(bucket, {}).setdefault(name, []).append(tuple(event))
        waiting = self._waiting()
        for bucket, events in arrived.items():
            keys = self._keys(bucket)
            for name, new in events.items():
                state, held = keys.get(name, (None, []))
                keys[name] = state, sorted([*held, *new])
            self._keep(bucket, keys, waiting)
        self._set_timer(waiting, self.timer.get()[0] if self.timer.exists() else None)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, waiting = timerValues.getCurrentWatermarkInMs(), self._waiting()
        for bucket in sorted(b for b, earliest in waiting.items() if earliest * 1000 <= passed):
            keys, out = self._keys(bucket), []
            for name, (state, held) in keys.items():
                ready = [e for e in held if e[0] * 1000 <= passed]
                for e in ready:
                    state, value = self.step(state, e)
                    out.append((name, *e[1:], *value))
                keys[name] = state, held[len(ready) :]
            self._keep(bucket, keys, waiting)
            if out:
                yield pd.DataFrame(out, columns=[self.key, *self.columns, *self.result])
        self._set_timer(waiting, None)

    def _waiting(self) -> dict[int, int]:
        return {bucket: earliest for (bucket,), (earliest,) in self.waiting.iterator()}

    def _keys(self, bucket: int) -> dict[str | None, tuple]:
        found = self.keys.getValue((bucket,))
        return pickle.loads(found[0]) if found else {}

    def _keep(self, bucket: int, keys: dict, waiting: dict[int, int]) -> None:
        """Store a bucket's keys, and when its first held event is due, here and in ``waiting``."""
        self.keys.updateValue((bucket,), (pickle.dumps(keys),))
        earliest = min((held[0][0] for _, held in keys.values() if held), default=None)
        if earliest is not None:
            waiting[bucket] = earliest
            self.waiting.updateValue((bucket,), (earliest,))
        elif waiting.pop(bucket, None) is not None:
            self.waiting.removeKey((bucket,))

    def _set_timer(self, waiting: dict[int, int], timer: int | None) -> None:
        """One timer, at the time of the lane's first held event."""
        due = 1000 * min(waiting.values()) if waiting else None
        if due == timer:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        if due is None:
            self.timer.clear()
            return
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def close(self) -> None:
        pass


def serially(events: DataFrame, key: str, at: str, columns: dict[str, str], step: Callable, result: dict[str, str]) -> DataFrame:
    """``step`` over each key's events in order of ``at`` and the first of ``columns``; ``events`` has a watermark on ``at``.

    Gives the key, the event's ``columns`` and the step's ``result`` (types by name) for each event. Lanes are two for each partition of the state.
    """
    kind = dict(events.dtypes)[key]
    lanes = max(64, 2 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = ", ".join(f"`{c}` {t}" for c, t in ({key: "string"} | columns | result).items())
    h = F.xxhash64(key)
    # Keys travel as text, since pandas has no nullable integers by default.
    own = events.select(F.pmod(h, F.lit(lanes)).cast("int").alias("lane"), F.pmod(F.shiftright(h, 32), F.lit(BUCKETS)).cast("long").alias("bucket"), F.col(key).cast("string").alias(key), at, *columns)
    done = own.groupBy("lane").transformWithStateInPandas(Serial(step, at, list(columns), key, list(result)), schema, "append", "EventTime")
    return done.withColumn(key, F.col(key).cast(kind))


def run_batches(spark: SparkSession, folder: str, schema: str, batches: list[DataFrame], job: Callable[[DataFrame], DataFrame], first: int = 0) -> DataFrame:
    """Feed batches one after the other, each to the job started anew on one checkpoint; all that it put out. ``first`` is the number of the first one, where others were fed before."""
    with keyed_state(spark):
        for k, batch in enumerate(batches, first):
            batch.write.parquet(f"{folder}/in/batch={k}")
            upto = ",".join(map(str, range(k + 1)))
            fed = spark.readStream.schema(schema).parquet(f"{folder}/in/batch={{{upto}}}")
            job(fed).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def far_future() -> Column:
    """The time of an event that closes a feed: it moves the watermark past all others (and still fits nanoseconds)."""
    return F.lit("2200-01-01").cast("timestamp")
