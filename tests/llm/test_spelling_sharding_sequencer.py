"""Spelling variants, shards and sequenced changes against brute force, on given tables and awkward rows."""

from __future__ import annotations

import datetime as dt
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import SMALL
from tests.llm.fixtures import documents, empty
from veinwork.llm import sequencer, sharding, spelling
from veinwork.llm.common import table

# Spelling variants


def brute_words(rows) -> dict[str, int]:
    found: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(words: dict[str, int]) -> dict[str, tuple]:
    by = defaultdict(set)
    for w in words:
        for part in (w, *(w[:k] + w[k + 1 :] for k in range(len(w)))):
            by[part].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (w, form.get(w), root(w), words[w], len(near[w]), words[form[w]] if w in form else None) for w in words}


def variants(spark):
    extra = [(900 + k, t, "en", "src", 1) for k, t in enumerate(["straße straßen Strasse houses house hause", "aaaaaa aaaaaaa aaaaa aaaaab baaaaa", "ÀÉîõü ÀÉîõü× naïve naive NAIVE", "x" * 3000 + " " + "x" * 2999 + "y"])] * 4
    return documents(spark, extra + [(None, "houses houses hxuses hxuses hxuses", None, None, None)])


@pytest.mark.parametrize("make", [variants, lambda s: table(s, SMALL, "documents")])
def test_spelling_forms(spark, make, monkeypatch):
    docs = make(spark)
    want = brute_forms(brute_words(docs.select("doc_id", "text").collect()))
    assert len(want) > 5 and any(x[1] for x in want.values())
    for block in (spelling.BLOCK, 2):  # groups in one block, and split
        monkeypatch.setattr(spelling, "BLOCK", block)
        got = spelling.spelling_forms(docs).collect()
        assert {r.word: tuple(r) for r in got} == want and len(got) == len(want)


def test_spelling_of_nothing_and_clashing_columns(spark):
    assert spelling.spelling_forms(empty(spark)).count() == 0
    docs = table(spark, SMALL, "documents")
    wide = docs.withColumns({c: F.lit("mine") for c in ("word", "n", "gram", "form", "block")})
    assert sorted(map(tuple, spelling.spelling_forms(wide).collect())) == sorted(map(tuple, spelling.spelling_forms(docs).collect()))


def test_chains_of_forms_end_in_their_root(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w40"}


# Shards


@pytest.mark.parametrize("sizes", [[], [0], [3], [1000, 0, 7, 250], [50] * 30])
def test_matrix_has_its_sums(sizes):
    m = sharding.communication_matrix(sizes, 24, 5)
    assert m.sum(1).tolist() == sizes and (m >= 0).all()
    if sizes:
        assert m.sum(0).max() - m.sum(0).min() <= 1


def test_draws_follow_the_law():
    from math import comb

    rng = np.random.default_rng(3)
    good, bad, draws = 30, 70, 20
    seen = np.bincount([sharding._hypergeometric(rng, good, bad, draws) for _ in range(4000)], minlength=21)
    law = np.array([comb(good, k) * comb(bad, draws - k) / comb(100, draws) for k in range(21)])
    assert np.abs(seen / 4000 - law).max() < 0.03


def test_large_urns_are_drawn_by_inversion_of_the_same_law(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(sharding, "URN", 1)
    got = [sharding._hypergeometric(rng, 400, 600, 100) for _ in range(4000)]
    assert abs(np.mean(got) - 40) < 0.4 and abs(np.std(got) - (100 * 0.4 * 0.6 * 900 / 999) ** 0.5) < 0.3


def test_shards_have_exact_sizes_and_gapless_slots(spark):
    docs = documents(spark, [(7, "copy", "en", "s", 4)] * 500).repartition(3)
    out = sharding.shard_digest(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    n = docs.count()
    assert sorted(by) == list(range(24)) and {len(v) for v in by.values()} <= {n // 24, n // 24 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want


def test_shards_are_uniform_whatever_the_blocks(spark):
    rows = spark.range(4000).repartition(7)
    out = sharding.shuffled(rows.withColumns({"shard": F.lit("mine"), "key": F.lit("mine"), "block": F.lit(1)}), 8).collect()
    assert all(r.key == "mine" and r.block == 1 for r in out)
    by = np.zeros((10, 8))
    for r in out:
        by[r.id // 400, r.shard] += 1
    assert ((by - 50) ** 2 / 50).sum() < 130  # 70 degrees of freedom
    place = np.corrcoef([r.id for r in out], [r.slot for r in out])[0, 1]
    assert abs(place) < 0.06


def test_few_rows_and_none(spark):
    assert sharding.shard_digest(empty(spark)).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shuffled(spark.range(3), 24).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_written_shards_hold_whole_rows_in_order(spark, tmp_path):
    docs = documents(spark)
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))


# Sequenced changes


def brute_changes(rows, batches=12) -> list[tuple]:
    """The contract, row by row."""
    distinct = list(dict.fromkeys(map(tuple, rows)))
    seqs = defaultdict(set)
    for _, client, seq, *_ in distinct:
        seqs[client].add(seq)
    number = {c: {s: k + 1 for k, s in enumerate(sorted(v, key=lambda x: (x is None, x or 0)))} for c, v in seqs.items()}
    live = []
    for change_id, client, seq, op, valid_at, city, balance in distinct:
        h = zlib.crc32(str(change_id).encode())
        if valid_at is None or h % 11 == 0:
            continue
        day = (valid_at.date() - dt.date(1970, 1, 1)).days + 9 * (h % 4)
        live.append((max(1, min(batches, 1 + math.floor((day - 19723) * batches / 160))), day, change_id, client, number[client][seq], op, city, balance))
    following, held, values, final, out = defaultdict(lambda: 1), defaultdict(dict), defaultdict(lambda: (None, None)), {}, []

    def apply(client, batch, missed):
        while following[client] in held[client]:
            _, change_id, op, city, balance = held[client].pop(following[client])
            following[client] += 1
            old = values[client]
            values[client] = {"I": (city, balance), "U": (old[0] if city is None else city, old[1] if balance is None else balance), "D": (None, None)}[op]
            city, balance = values[client]
            final[client] = len(out)
            out.append([change_id, client, "applied", batch, missed, city, None if balance is None else math.floor(100 * balance + 0.5), op])
            missed = 0

    def skip(batch, horizon):
        for client in list(held):
            while held[client] and (horizon is None or min(x[0] for x in held[client].values()) + 3 <= horizon):
                missed = min(held[client]) - following[client]
                following[client] += missed
                apply(client, batch, missed)

    horizon = -1
    for b in range(1, batches + 1):
        skip(b, horizon)
        now = sorted((r[1:] for r in live if r[0] == b), key=lambda r: r[:2])
        for day, change_id, client, n, op, city, balance in now:
            if n in held[client] or n < following[client]:
                out.append([change_id, client, "rejected", b, 0, None, None, op])
            else:
                held[client][n] = (day, change_id, op, city, balance)
                apply(client, b, 0)
        horizon = max([horizon, *(r[0] for r in now)])
    skip(batches + 1, None)
    last = set(final.values())
    return sorted(((*r[:7], k in last and r[7] != "D") for k, r in enumerate(out)), key=lambda r: r[0])


OWN = ("change_id", "client_id", "seq", "op", "valid_at", "city", "balance")
CONTRACT = ("change_id", "client_id", "status", "batch", "missed", "city", "cents", "current")


def test_changes_of_the_given_table(spark):
    changes = table(spark, SMALL, "client_changes")
    got = sequencer.change_digest(changes, lanes=8).select(*CONTRACT).collect()
    want = brute_changes(changes.select(*OWN).collect())
    assert sorted(map(tuple, got), key=lambda r: r[0]) == want and len({r[3] for r in want}) == 13 and any(r[4] > 1 for r in want)


def test_awkward_changes(spark):
    at = dt.datetime(2024, 1, 3)
    rows = [(k, k % 3 or None, 5 * (k // 4) - 20, "IUD"[k % 3], at + dt.timedelta(days=k % 100), None if k % 5 == 0 else f"c{k % 7}", None if k % 4 == 0 else k / 8) for k in range(1, 150)]
    rows += [(500, 1, 3, "U", None, "x", 1.0), rows[3], rows[3], (501, 2, 2**62, "I", at, "far", -0.005), (502, 2, -(2**62), "U", at, None, None)]
    changes = spark.createDataFrame(rows, "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double")
    clashing = changes.withColumns({c: F.lit("mine") for c in ("n", "day", "batch", "lane", "status", "horizon", "range_")})
    got = sequencer.change_digest(clashing, batches=3, lanes=2).select(*CONTRACT).collect()
    keyed = [(r[0], -1 if r[1] is None else r[1], *r[2:]) for r in map(tuple, changes.collect())]  # the null client, in an order of tuples
    want = {r[0]: (r[0], None if r[1] == -1 else r[1], *r[2:]) for r in brute_changes(keyed, batches=3)}
    assert {r.change_id: tuple(r) for r in got} == want


def test_no_changes(spark):
    changes = spark.createDataFrame([], "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, city string, balance double")
    assert sequencer.change_digest(changes, batches=2, lanes=2).count() == 0


def test_numbers_are_dense_ranks(spark, monkeypatch):
    monkeypatch.setattr(sequencer, "RANGE_BITS", 2)
    rows = [(k % 3 or None, s) for k in range(60) for s in (k * 7 % 50 - 20, None)]
    got = {(r.c, r.s): r.n for r in sequencer.dense_numbers(spark.createDataFrame(rows, "c long, s long"), "c", "s").collect()}
    for c in (None, 1, 2):
        mine = sorted({s for x, s in rows if x == c}, key=lambda s: (s is None, s or 0))
        assert [got[c, s] for s in mine] == list(range(1, len(mine) + 1))


def test_stores_write_no_second_file_for_each_of_theirs(spark):
    """Checksums beside each file of a checkpoint cost an executor threads and files for every store that it opens."""
    rows = [(k, k % 3, k, "I", dt.datetime(2024, 1, 1 + k), "x", 1.0) for k in range(9)]
    changes = spark.createDataFrame(rows, "change_id long, client_id long, seq long, op string, valid_at timestamp, city string, balance double")
    before = set(Path(sequencer.shared_folder(spark).removeprefix("file:")).glob("changes-*"))
    assert sequencer.change_digest(changes, batches=2, lanes=2).count()
    (made,) = set(Path(sequencer.shared_folder(spark).removeprefix("file:")).glob("changes-*")) - before
    files = [f.name for f in (made / "checkpoint/state").rglob("*") if f.is_file()]
    assert files and not [f for f in files if f.endswith(".crc") and not f.startswith(".")]
