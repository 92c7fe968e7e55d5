"""Readers over files made here, connectors resumed from their cursors, sinks over replays."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veinwork.operators.ordering import group_positions, positions
from veinwork.sources import connectors, landed, readers
from veinwork.streaming.sinks import Stored, rejecting, upsert

BOX = b"""From a@x Mon Jan  1 00:00:00 2001
From: =?utf-8?q?Zo=C3=A9_Prado?= <zoe@mail.example>
Subject: Mi
 postulacion
Message-ID: <1@x>
Content-Type: multipart/mixed; boundary="out"

--out
Content-Type: multipart/alternative; boundary="in"

--in
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

Hola, se=F1or=
es
--in
Content-Type: text/html

<p>Hola <b>todos</b></p>
--in--
--out
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="=?utf-8?b?Y3bDsS50eHQ=?="
Content-Transfer-Encoding: base64

aG9sYQ==
--out--

From nobody

From b@x Tue
Subject: only html
Content-Type: text/html

<style>p{}</style><p>a&amp;b</p>
"""


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_mail():
    first, second = map(readers.parse_message, readers.split_mbox(BOX))
    assert (first["sender"], first["subject"], first["message_id"], first["body"]) == ("Zoé Prado <zoe@mail.example>", "Mi postulacion", "1@x", "Hola, señores")
    assert [(a["file_name"], a["content"], a["size"]) for a in first["attachments"]] == [("cvñ.txt", b"hola", 4)]
    assert second["body"] == "a&b" and not second["attachments"]
    assert readers.split_mbox(b"") == [] and readers.parse_message(b"no header at all")["subject"] == ""


def test_large_attachments_are_hashed_only(monkeypatch):
    monkeypatch.setattr(readers, "MOST_BYTES", 3)
    file = readers.parse_message(readers.split_mbox(BOX)[0])["attachments"][0]
    assert file["content"] is None and file["size"] == 4 and len(file["sha256"]) == 64


def test_mail_boxes_in_folders_and_archives(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(BOX)
    (tmp_path / "b.zip").write_bytes(archive({"Mail/in.mbox": BOX, "note.txt": b"From x\n\nno"}))
    (tmp_path / "c.zip").write_bytes(b"PK broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = readers.mail_boxes(files).select(F.regexp_extract("box", "([^/!]+)$", 1).alias("box"), "position", "subject").collect()
    assert sorted(map(tuple, got)) == sorted((b, k, s) for b in ("a.mbox", "in.mbox") for k, s in enumerate(("Mi postulacion", "only html")))


def test_documents():
    word = archive({"word/document.xml": "<w:p><w:r><w:t>Ana &amp; co</w:t></w:r></w:p><w:p><w:t>dos</w:t></w:p>", "word/footer1.xml": "<w:p><w:t>pie</w:t></w:p>", "docProps/app.xml": "<x>no</x>"})
    assert readers.document_text("a.docx", word) == "Ana & co\ndos\npie"
    pdf = b"%PDF-1.4\n1 0 obj stream\nBT /F1 12 Tf (Hola \\(dos\\)) Tj [(par) -20 (te)] TJ ET\nendstream"
    assert readers.document_text("x.pdf", pdf) == "Hola (dos)\nparte"
    assert readers.document_text("x.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Se\'f1or\b0\par fin}") == "Señor\nfin"
    assert readers.document_text("x.txt", "ñ".encode()) == "ñ" and readers.document_text("x.exe", b"MZ\x00") == ""
    assert readers.document_text("a.docx", b"PK no") == "" and readers.document_text(None, None) == ""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('﻿a;b;\n1;"x;""y"\n\n2', [{"a": "1", "b": 'x;"y', "column_3": ""}, {"a": "2", "b": "", "column_3": ""}]),
        ("a\tb\n1\t2,5;6", [{"a": "1", "b": "2,5;6"}]),
        ("one column\n1", []),
        ("", []),
    ],
)
def test_delimited(text, want):
    assert readers.delimited_rows(text) == want


def test_rows_in_any_form():
    assert readers.rows_of('{"items":[{"a":1},2]}') == [{"a": 1}] and readers.rows_of('{"a":1}') == [{"a": 1}]
    assert readers.rows_of("x\n\ny\nz") == [{"text": "x", "source_id": "text-1"}, {"text": "y\nz", "source_id": "text-2"}]
    assert len(readers.rows_of(json.dumps([{"a": k} for k in range(9)]), most=4)) == 4 and readers.rows_of(None) == []
    assert len(readers.rows_of(json.dumps([{"a": k} for k in range(6000)]))) == 6000 and len(readers.rows_of("a,b\n" + "1,2\n" * 6000)) == 6000
    assert readers.embedded_rows('{"historicalData":"name,mail\\nAda,x"}') == [{"name": "Ada", "mail": "x"}]
    assert readers.embedded_rows('{"a":{"b":[{"email":"x"}]},"records":[]}') == [{"email": "x"}] and readers.embedded_rows("no") == []


def pages(spark, n):
    rows = [(p, [{"id": 10 * p + k} for k in range(10)]) for p in range(1, n + 1)] + [(n + 1, [{"id": 10 * n + k} for k in range(9, -1, -1)]), (n + 2, [])]
    return spark.createDataFrame(rows, "page long, rows array<struct<id:long>>")


def test_paged_source_resumes(spark):
    sync = connectors.CONNECTORS["paged"]
    first = sync({}, pages(spark, 4))
    assert sorted(r.id for r in first.rows.collect()) == list(range(10, 50)) and len(first.config["known"]) == 40
    again = sync(first.config, pages(spark, 4))
    assert again.rows.count() == 0 and again.config == first.config
    head = sync({"known": ["25"]}, pages(spark, 4))
    assert sorted(r.id for r in head.rows.collect()) == list(range(10, 25))


def test_paged_source_goes_on_where_a_run_stopped(spark, monkeypatch):
    monkeypatch.setattr(connectors, "FULL_PAGES", 6)
    monkeypatch.setattr(connectors, "HEAD_PAGES", 2)
    config, seen = {}, []

    def run(n):
        nonlocal config
        sync = connectors.CONNECTORS["paged"](config, pages(spark, n))
        seen.extend(r.id for r in sync.rows.collect())
        config = config | sync.config

    while config.get("page", 1) is not None:
        run(20)
    assert sorted(set(seen)) == list(range(10, 210)) and config["known"][0] == "10"
    # rows that came in at the head, on more pages than a run looks at: ids 1010 and so on, before the known ones
    fresh = spark.createDataFrame([(p, [{"id": 1000 + 10 * p + k} for k in range(10)]) for p in range(1, 8)] + [(p + 7, [{"id": 10 * p + k} for k in range(10)]) for p in range(1, 21)], "page long, rows array<struct<id:long>>")
    seen.clear()
    for _ in range(5):
        sync = connectors.CONNECTORS["paged"](config, fresh)
        seen.extend(r.id for r in sync.rows.collect())
        config |= sync.config
        if config["page"] is None:
            break
    assert set(seen) == set(range(1010, 1080)) and config["known"][0] == "1010" and config["page"] is None


def test_nested_source_delivers_every_page(spark):
    stages = spark.createDataFrame([(1, "a", p, [{"id": 10 * p + k} for k in range(2)]) for p in range(30)], "offer long, stage string, page long, rows array<struct<id:long>>")
    config, seen = {}, []
    for _ in range(6):
        sync = connectors.CONNECTORS["nested"](config, stages)
        seen += [r.id for r in sync.rows.collect()]
        config |= sync.config
    assert sorted(seen) == sorted(10 * p + k for p in range(30) for k in range(2)) and sync.message == "at the end"


MESSAGES = "message_id string, history long, day date"


def messages(spark, first, last, per_day=40):
    return spark.createDataFrame([(f"m{k:05}", k, dt.date(2001, 1, 1) + dt.timedelta(days=k // per_day)) for k in range(first, last + 1)], MESSAGES)


@pytest.mark.parametrize("budget", [40, 119, 1000])
@pytest.mark.parametrize("start", [{}, {"mark": 100, "day": "2001-01-03"}, {"mark": 10, "day": "2001-01-13"}])
def test_mail_delivers_every_message_over_any_budget(spark, budget, start):
    feed = messages(spark, 50, 600).cache()  # older ones are gone: mark 10 has expired
    config, seen, runs = {"budget": budget, **start}, [], 0
    while True:
        run = connectors.CONNECTORS["mail"](config, feed)
        seen += [r.message_id for r in run.rows.collect()]
        if run.config["run"] is not None:
            assert "mark" not in run.config and "day" not in run.config  # neither moves while anything is left
        config, runs = config | run.config, runs + 1
        if config["run"] is None:
            break
    first = {None: 50, 100: 101, 10: 40 * 11}[start.get("mark")]
    assert sorted(seen) == [f"m{k:05}" for k in range(first, 601)] and len(set(seen)) == len(seen)
    assert config["mark"] == 600 and config["day"] == str(dt.date(2001, 1, 16)) and runs == -(-(601 - first) // budget)


def test_mail_that_comes_in_during_a_run_waits_for_the_next(spark):
    config = {"budget": 30}
    first = connectors.CONNECTORS["mail"](config, messages(spark, 1, 50))
    config |= first.config
    feed = messages(spark, 1, 70)
    seen = [r.message_id for r in first.rows.collect()]
    for _ in range(3):
        run = connectors.CONNECTORS["mail"](config, feed)
        seen += [r.message_id for r in run.rows.collect()]
        config |= run.config
    assert sorted(seen) == [f"m{k:05}" for k in range(1, 71)] and config["mark"] == 70


# Landed feeds


FIELDS = "position long, id long, mode string"


def test_landed_feed_is_read_in_order_by_table_and_by_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "RANGE", 7)
    feed, read = str(tmp_path / "feed"), str(tmp_path / "read")
    landed.land(spark.range(100).select((1000 - F.col("id")).alias("id")).repartition(5), feed, ["id"])
    landed.register(spark)
    whole = spark.read.format("landed").schema(FIELDS).load(feed)
    assert [tuple(r) for r in whole.orderBy("position").collect()] == [(k, 901 + k, "table") for k in range(100)]
    assert whole.rdd.getNumPartitions() == 15
    out = landed.deliver(spark, feed, FIELDS, read, most=30, runs=2)
    assert sorted(r.position for r in out.collect()) == list(range(60))
    landed.land(spark.range(5), feed, ["id"])
    out = landed.deliver(spark, feed, FIELDS, read, most=30)
    got = sorted(map(tuple, out.collect()))
    assert got == [(k, 901 + k, "historical") for k in range(100)] + [(100 + k, k, "history") for k in range(5)]


def test_landed_feed_survives_a_kill(spark, tmp_path):
    feed, read = str(tmp_path / "feed"), str(tmp_path / "read")
    landed.land(spark.range(90), feed, ["id"])
    landed.register(spark)

    def broken(batch, number):
        batch.count()
        raise RuntimeError("killed")

    stream = lambda: spark.readStream.format("landed").schema(FIELDS).option("most", 40).option("cursor", f"{read}/cursor").load(feed)
    with pytest.raises(Exception, match="killed"):
        stream().writeStream.foreachBatch(broken).option("checkpointLocation", f"{read}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    seen: dict[int, list[int]] = {}
    for _ in range(4):
        stream().writeStream.foreachBatch(lambda batch, number: seen.setdefault(number, sorted(r.id for r in batch.collect()))).option("checkpointLocation", f"{read}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert seen[0] == list(range(40)) and sorted(x for v in seen.values() for x in v) == list(range(90))


def test_landing_that_failed_isnt_read(spark, tmp_path):
    feed = str(tmp_path / "feed")
    landed.land(spark.range(3), feed, ["id"])
    spark.range(9).withColumn("position", F.col("id")).write.parquet(f"{feed}/landing-lost/_file=0")
    landed.register(spark)
    assert spark.read.format("landed").schema("id long").load(feed).count() == 3
    assert landed.land(spark.range(0), feed, ["id"])["next"] == 3


def test_positions_follow_a_total_order(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("k")).repartition(7)
    got = {(r.k, r.id): r.position for r in positions(df, F.desc("k"), "id").collect()}
    assert [got[k] for k in sorted(got, key=lambda x: (-x[0], x[1]))] == list(range(500))


def test_upsert_survives_replays(spark, tmp_path):
    stored, counts = Stored(spark, str(tmp_path / "t")), []
    note = lambda n, c: counts.append({r["outcome"]: r["rows"] for r in c.collect()})
    rows = lambda *x: spark.createDataFrame(list(x), "id long, name string, tags array<string>")
    merge = upsert(stored, "id", {"name": "incoming", "tags": "union"}, "a", note)
    one, two = rows((1, "x", ["p"]), (2, "y", [])), rows((2, None, ["q"]), (3, "z", []), (1, "x", ["p"]))
    merge(one, 0)
    merge(two, 1)
    merge(two, 1)  # delivered again
    upsert(stored, "id", {"name": "incoming", "tags": "union"}, "b", note)(two, 0)
    assert counts == [{"new": 2}, {"updated": 1, "new": 1, "unchanged": 1}, {"unchanged": 3}]
    assert sorted(map(tuple, stored.read().collect())) == [(1, "x", ["p"]), (2, "y", ["q"]), (3, "z", [])]


ONE = "id long, name string"


def _people(spark, *rows):
    return spark.createDataFrame(list(rows), ONE)


def _rows(stored):
    return sorted(map(tuple, stored.read().collect()))


def test_upsert_writes_touched_buckets_alone(spark, tmp_path):
    stored = Stored(spark, str(tmp_path / "t"), buckets=8)
    upsert(stored, "id", {"name": "incoming"}, "a")(_people(spark, *[(k, f"p{k}") for k in range(100)]), 0)
    before = stored.commit()["files"]
    upsert(stored, "id", {"name": "incoming"}, "a")(_people(spark, (5, "new")), 1)
    after = stored.commit()["files"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert dict(_rows(stored))[5] == "new" and len(_rows(stored)) == 100


@pytest.mark.parametrize("step", ["data", "draft", "rename", "outcome"])
def test_a_crash_at_any_step_leaves_a_whole_version(spark, tmp_path, monkeypatch, step):
    stored = Stored(spark, str(tmp_path / "t"), buckets=4)
    merge = upsert(stored, "id", {"name": "incoming"}, "a")
    merge(_people(spark, (1, "x"), (2, "y")), 0)
    new = _people(spark, (1, "z"), (3, "w"))

    def crash(*args, **kwargs):
        raise OSError("killed")

    with monkeypatch.context() as m:
        if step == "data":
            m.setattr(Stored, "bucket", crash)
        elif step == "draft":
            m.setattr("veinwork.streaming.sinks.replace_json", crash)
        elif step == "rename":
            m.setattr(Stored, "_publish", crash)
        note = crash if step == "outcome" else None
        with pytest.raises(OSError, match="killed"):
            upsert(stored, "id", {"name": "incoming"}, "a", note)(new, 1)
    done = step == "outcome"
    assert _rows(stored) == ([(1, "z"), (2, "y"), (3, "w")] if done else [(1, "x"), (2, "y")])
    merge(new, 1)  # delivered again
    assert _rows(stored) == [(1, "z"), (2, "y"), (3, "w")]


def test_of_two_writers_one_begins_again(spark, tmp_path, monkeypatch):
    stored = Stored(spark, str(tmp_path / "t"), buckets=2)
    upsert(stored, "id", {"name": "incoming"}, "a")(_people(spark, (1, "x")), 0)
    real, met = Stored._publish, []

    def slow(self, version, commit):
        if not met:
            met.append(version)
            upsert(Stored(spark, str(tmp_path / "t"), buckets=2), "id", {"name": "incoming"}, "b")(_people(spark, (2, "y")), 0)
        real(self, version, commit)

    monkeypatch.setattr(Stored, "_publish", slow)
    upsert(stored, "id", {"name": "incoming"}, "a")(_people(spark, (3, "z")), 1)
    assert _rows(stored) == [(1, "x"), (2, "y"), (3, "z")] and stored.versions() == [0, 1, 2]


def test_old_versions_go_and_named_files_stay(spark, tmp_path):
    stored = Stored(spark, str(tmp_path / "t"), buckets=2)
    for k in range(6):
        upsert(stored, "id", {"name": "incoming"}, "a")(_people(spark, (k, "x")), k)
    assert stored.versions() == [3, 4, 5] and len(_rows(stored)) == 6


def test_rejects(spark, tmp_path):
    split = rejecting(str(tmp_path / "ok"), str(tmp_path / "no"), [("small", F.col("v") < 3)])
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    split(df, 0)
    split(df, 0)
    assert sorted((r.v is None, r.v) for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == [(False, 5), (True, None)]
    assert [(r.reason, json.loads(r.payload)) for r in spark.read.parquet(str(tmp_path / "no")).collect()] == [("small", {"v": 1})]


def test_group_positions(spark):
    df = spark.createDataFrame([(k % 3 or None, k * 7 % 50) for k in range(50)], "g long, v long").repartition(6)
    got = {(r.g, r.v): r.n for r in group_positions(df, ["g"], [F.desc("v")], "n").collect()}
    for g in (None, 1, 2):
        mine = sorted((v for x, v in got if x == g), reverse=True)
        assert [got[g, v] for v in mine] == list(range(1, len(mine) + 1))
