"""Each stage against a brute-force version on its own input, and the stages chained."""

from __future__ import annotations

import re

import corpus_pipeline as pipeline
from tests.llm.fixtures import documents, empty
from tests.llm.test_operators import brute_groups
from veinwork.llm.decontamination import WuManber

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stage_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "source_mix"]


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = documents(spark)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, SMALL)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = [r.asDict() for r in docs.collect()]
        if name != "source_mix":
            assert docs.columns == COLUMNS
        ids = {r["doc_id"] for r in after}
        if name == "language_id":
            gone = {r["doc_id"] for r in before} - ids
            assert gone == {100, 101, 102, 103}
        if name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"])
            assert sum(len(r["text"] or "") for r in after) < sum(len(r["text"] or "") for r in before)
        if name == "jaccard_join":
            groups = brute_groups([(r["doc_id"], r["text"]) for r in before])
            assert len(after) == len({g if n else (i,) for i, n, g in groups})
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            search = WuManber(items).search
            assert ids == {r["doc_id"] for r in before if not search(r["text"])[1]}
        if name == "source_mix":
            assert len(after) == len(before)
            assert {r["doc_id"]: r["size"] for r in after} == {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
            assert all(r["taken"] <= 2 * r["size"] for r in after)


def test_stages_on_an_empty_table(spark):
    docs = empty(spark)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = out if name != "source_mix" else docs


def test_run(spark):
    out = pipeline.run(spark, SMALL)
    assert 100 < out.count() <= 200 and set(out.columns) >= {"doc_id", "size", "source_size", "target", "taken"}
