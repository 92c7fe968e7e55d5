"""Chains and rings of keepers, children that follow them, and state over micro-batches, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from veinwork.operators import identity
from veinwork.streaming import stateful


def brute(pairs):
    links = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            links[a] = min(b, links.get(a, b))
    out = {}
    for a in links:
        seen, x = [a], a
        while x in links:
            x = links[x]
            if x in seen:
                x = min(seen[seen.index(x) :])
                break
            seen.append(x)
        if x != a:
            out[a] = x
    return out


CASES = {
    "none": [],
    "one": [(2, 1)],
    "chain": [(k + 1, k) for k in range(100)],
    "ring": [(1, 2), (2, 3), (3, 1)],
    "rings with tails": [(k, (k + 1) % 37) for k in range(37)] + [(100 + k, 99 + k) for k in range(1, 60)] + [(100, 5), (500, 501), (501, 500), (400, 500), (3000, 3000)],
    "long tail into a short ring": [(10 + k, 9 + k) for k in range(1, 70)] + [(10, 2), (2, 1), (1, 2)],
    "several keepers": [(5, 4), (5, 3), (4, 1), (None, 2), (7, None)],
    "random": [(k, (k * 7919 + 13) % 200) for k in range(200)],
}


@pytest.mark.parametrize("name", CASES)
def test_resolved(spark, name):
    df = spark.createDataFrame(CASES[name], "old long, new long")
    got = {r.old: r.new for r in identity.resolved(df).collect()}
    assert got == brute(CASES[name])


def test_children_follow_and_clashes_go(spark):
    moved = spark.createDataFrame([(3, 1), (2, 1)], "old long, new long")
    docs = spark.createDataFrame([(1, "h", 10), (2, "h", 20), (3, "h", 30), (3, "g", 31), (2, "g", 21), (2, "g", 23), (2, None, 22), (3, None, 32), (9, "h", 90)], "person long, hash string, id long")
    notes = spark.createDataFrame([(2, "x"), (9, "y")], "owner long, note string")
    out = identity.repoint({"docs": (docs, "person"), "notes": (notes, "owner")}, moved, {"docs": ["hash"]})
    assert sorted(map(tuple, out["docs"].collect()), key=repr) == sorted([(1, "h", 10), (1, "g", 21), (1, "g", 23), (1, None, 22), (1, None, 32), (9, "h", 90)], key=repr)
    assert sorted(map(tuple, out["notes"].collect())) == [(1, "x"), (9, "y")]


def test_merged_keepers(spark):
    rows = spark.createDataFrame([(1, "a", ["x"], 5), (2, "b", ["y", "x"], 9), (4, "d", None, None)], "id long, name string, tags array<string>, quality int")
    moved = spark.createDataFrame([(2, 1)], "old long, new long")
    got = sorted(map(tuple, identity.merged_keepers(rows, "id", moved, ["tags"], ["quality"]).collect()))
    assert got[0] == (1, "a", ["x", "y"], 9) and got[-1][0] == 4


def test_leases(spark, tmp_path):
    q = lambda rows: spark.createDataFrame([(0, *r) for r in rows], stateful.QUEUE)
    put = lambda i, at=0: ("enqueue", i, i, None, at, 0, None)
    claim = lambda w, at, n: ("claim", 0, 0, w, at, n, None)
    done = lambda i, w, at, how="ok": ("done", i, 0, w, at, 0, how)
    batches = [
        [*map(put, range(1, 7)), claim("a", 1, 2), claim("b", 1, 2)],
        [done(1, "a", 300), done(2, "b", 301), done(3, "b", 302, "error"), put(1, 303)],
        [claim("c", 599, 1), claim("c", 601, 3)],
        [done(2, "a", 700), done(2, "c", 701), claim("d", 800, 9)],
    ]
    out = stateful.run_batches(spark, str(tmp_path), stateful.QUEUE, [q(b) for b in batches], stateful.leased)
    got = sorted((r.at, r.id, r.worker, r.attempts, r.state) for r in out.collect())
    assert got == sorted([
        (1, 1, "a", 1, "leased"), (1, 2, "a", 1, "leased"), (1, 3, "b", 1, "leased"), (1, 4, "b", 1, "leased"),
        (300, 1, "a", 1, "done"), (301, 2, "b", 1, "ignored"), (302, 3, "b", 1, "waiting"),
        (599, 3, "c", 2, "leased"), (601, 2, "c", 2, "leased"), (601, 4, "c", 2, "leased"), (601, 5, "c", 1, "leased"),
        (700, 2, "a", 2, "ignored"), (701, 2, "c", 2, "done"), (800, 6, "d", 1, "leased"),
    ])


def test_work_that_fails_too_often_is_given_up(spark, tmp_path, monkeypatch):
    rows = [(0, "enqueue", 1, 1, None, 0, 0, None)]
    for k in range(10):
        rows += [(0, "claim", 0, 0, "w", 700 * k + 1, 1, None)]
    out = stateful.run_batches(spark, str(tmp_path), stateful.QUEUE, [spark.createDataFrame(rows, stateful.QUEUE)], stateful.leased)
    got = sorted((r.at, r.attempts, r.state) for r in out.collect())
    assert [x[2] for x in got] == ["leased"] * 8 + ["given up"]


def test_serial_work_across_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k % 7, k, f"2001-01-{1 + k // 20:02} {k % 20:02}:00:00", rng.choice("abx")) for k in range(200)]
    early, late = [r for r in rows if r[1] % 5], [r for r in rows if not r[1] % 5]
    schema = "user long, id long, ts timestamp, kind string"
    frame = lambda x: spark.createDataFrame(x, "user long, id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = lambda x, a, b: [r for r in x if a <= r[1] < b]
    batches = [frame(cut(early, 0, 100)), frame([*cut(early, 100, 200), *cut(late, 0, 100)][::-1]), frame(cut(late, 100, 200)), spark.range(1).select(F.lit(-1).cast("long").alias("user"), F.lit(-1).cast("long").alias("id"), stateful.far_future().alias("ts"), F.lit("").alias("kind"))]

    def step(state, event):
        path = "" if event[2] == "x" else (state or "") + event[2]
        return path, (path,)

    job = lambda s: stateful.serially(s.withWatermark("ts", "11 days"), "user", "ts", {"id": "long", "kind": "string"}, step, {"path": "string"})
    out = stateful.run_batches(spark, str(tmp_path), schema, batches, job)
    want, state = [], {}
    for user, k, _, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        state[user] = "" if kind == "x" else state.get(user, "") + kind
        want.append((user, k, kind, state[user]))
    assert sorted(tuple(r) for r in out.filter("id >= 0").collect()) == sorted(want)
