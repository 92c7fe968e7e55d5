"""Sources that deliver pages into a landing folder, and the cursors that resume them.

There is no network here: what a client would fetch is a table of landed pages.
A connector's ``sync`` takes its configuration and the pages, and returns rows
together with the changes to the configuration (the cursor); running it again with the
changed configuration delivers only what is new.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of a run of a full sweep, and of one that begins at the head where ids are known.
FULL_PAGES, HEAD_PAGES = 60, 3
#: Known ids that a cursor keeps.
MOST_KNOWN = 200
#: New rows of a run of a nested source.
RUN_ROWS = 15


@dataclass(frozen=True)
class Sync:
    """What a run delivers: rows, a message, and what changes in the configuration."""

    rows: DataFrame
    message: str
    config: dict = field(default_factory=dict)


Connector = Callable[[dict, DataFrame], Sync]
CONNECTORS: dict[str, Connector] = {}


def connector(name: str) -> Callable[[Connector], Connector]:
    def register(f: Connector) -> Connector:
        CONNECTORS[name] = f
        return f

    return register


def new_pages(pages: DataFrame, most: int | None) -> DataFrame:
    """Pages up to ``most`` whose ids aren't those of an earlier page: a source that repeats its last page ends there.

    ``pages`` has page (from 1) and rows (array of structs with id).
    """
    ids = F.array_join(F.array_sort(F.transform("rows", lambda r: r["id"].cast("string"))), ",")
    upto = F.lit(True) if most is None else F.col("page") <= most
    marked = pages.filter(upto & (F.size("rows") > 0)).withColumn("fingerprint", F.sha2(ids, 256))
    first = marked.groupBy("fingerprint").agg(F.min_by("rows", "page").alias("rows"), F.min("page").alias("page"))
    return first.select("page", "rows")


def flat(pages: DataFrame) -> DataFrame:
    """Rows in order of page and place, each id once, the first time it comes."""
    rows = pages.select("page", F.posexplode("rows").alias("place", "row"))
    return rows.groupBy("row.id").agg(F.min(F.struct("page", "place", "row")).alias("first")).select("first.page", "first.place", "first.row.*")


@connector("paged")
def paged(config: dict, pages: DataFrame) -> Sync:
    """Sweeps from the first page to the first known id, or to the end.

    A run takes ``FULL_PAGES`` pages, or ``HEAD_PAGES`` where ids are known. A sweep that
    hasn't come to its end goes on in the next run from the page that the cursor
    holds, one page back, since rows that came in meanwhile push others to later pages. The ids that the
    sweep began with become the known ones when it ends.
    """
    known, at, head = [str(x) for x in config.get("known", [])], config.get("page"), config.get("head")
    last = (at or 1) + (HEAD_PAGES if known and at is None else FULL_PAGES) - 1
    rows = flat(new_pages(pages.filter(F.col("page") >= max(1, (at or 1) - 1)), last))
    ended = pages.filter((F.col("page") > last) & (F.size("rows") > 0)).isEmpty()
    if known:
        spot = rows.filter(F.col("id").cast("string").isin(known)).agg(F.min(F.struct("page", "place")).alias("end"))
        ended = ended or spot.first()["end"] is not None
        rows = rows.crossJoin(F.broadcast(spot)).filter(F.col("end").isNull() | (F.struct("page", "place") < F.col("end"))).drop("end")
    if head is None:
        head = [str(r["id"]) for r in rows.select("id", "page", "place").orderBy("page", "place").limit(MOST_KNOWN).collect()]
    if not ended:
        return Sync(rows, f"up to page {last}", {"known": known, "page": last + 1, "head": head})
    return Sync(rows, "at the end", {"known": [*head, *[k for k in known if k not in head]][:MOST_KNOWN], "page": None, "head": None})


@connector("nested")
def nested(config: dict, stages: DataFrame) -> Sync:
    """Offers, their stages, and applications page by page: the cursor is the last application taken.

    ``stages`` has offer, stage, page, and rows (array of structs with id). A run
    takes at most ``RUN_ROWS`` applications after the cursor, each id once; the next one goes on from there.
    """
    rows = stages.select("offer", "stage", "page", F.posexplode("rows").alias("place", "row"))
    spot = F.struct("offer", "stage", "page", "place")
    first = rows.groupBy("row.id").agg(F.min(F.struct("offer", "stage", "page", "place", "row")).alias("f")).select("f.offer", "f.stage", "f.page", "f.place", "f.row.*")
    at = config.get("cursor")
    if at:
        kinds = dict(first.dtypes)
        first = first.filter(spot > F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(("offer", "stage", "page", "place"), at)]))
    taken = first.orderBy("offer", "stage", "page", "place").limit(RUN_ROWS)
    last = taken.orderBy(F.desc("offer"), F.desc("stage"), F.desc("page"), F.desc("place")).select("offer", "stage", "page", "place").first()
    return Sync(taken, "at the end" if last is None else "more to come", {"cursor": list(last) if last else at})


@connector("mail")
def mail(config: dict, changes: DataFrame) -> Sync:
    """A feed of messages with a history number: everything at first, then what comes after the high-water mark.

    ``changes`` has message_id, history (growing) and day. A mark that the feed
    no longer covers falls back to the days since the last run, less one of
    overlap. What a run may take is fixed when it begins (``run``: its mode, the newest history and day it
    covers); of it, ``budget`` messages are delivered at a time, in the order of history and id, and
    ``run.at`` is the last one delivered. Mark and day move when nothing of the run is left.
    """
    mark, budget, run = config.get("mark"), int(config.get("budget", 120)), config.get("run")
    if run is None:
        oldest, newest, last_day = changes.agg(F.min("history"), F.max("history"), F.max("day")).first()
        expired = mark is not None and oldest is not None and mark < oldest - 1
        run = {"mode": "historical" if mark is None else "overlap" if expired else "history", "upto": newest, "last_day": None if last_day is None else str(last_day), "at": None}
    found = changes.filter(F.col("history") <= F.lit(run["upto"]))
    if run["mode"] == "overlap" and config.get("day") is not None:
        found = found.filter(F.col("day") >= F.date_sub(F.lit(config["day"]).cast("date"), 1))
    elif run["mode"] == "history":
        found = found.filter(F.col("history") > mark)
    ids = found.groupBy("message_id").agg(F.min("history").alias("history"))
    if run["at"] is not None:
        history, message = run["at"]
        kind = dict(ids.dtypes)["message_id"]
        ids = ids.filter((F.col("history") > history) | ((F.col("history") == history) & (F.col("message_id") > F.lit(message).cast(kind))))
    now = ids.orderBy("history", "message_id").limit(budget)
    last = now.orderBy(F.desc("history"), F.desc("message_id")).first()
    at = run["at"] if last is None else [last["history"], str(last["message_id"])]
    left = 0 if last is None else ids.filter((F.col("history") > last["history"]) | ((F.col("history") == last["history"]) & (F.col("message_id") > last["message_id"]))).count()
    if left:
        return Sync(now, f"{run['mode']}: {left} left", {"mode": run["mode"], "run": {**run, "at": at}})
    return Sync(now, f"{run['mode']}: nothing left", {"mode": run["mode"], "run": None, "mark": mark if run["upto"] is None else run["upto"], "day": run["last_day"] or config.get("day")})
