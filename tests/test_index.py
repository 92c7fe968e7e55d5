"""The stored index against brute force over the texts, through updates, and what its plans read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veinwork.functions.text import plain_text
from veinwork.operators import textindex
from veinwork.operators.textindex import TextIndex

WORDS = "casa perro gato niño Canción árbol río de la el que trabajó trabajando house the".split()


def some_texts(seed=4, n=120):
    rng = random.Random(seed)
    return {k: " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 3, 20, 200)))) for k in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def split(text):
    return re.findall(r"[^\W_]+", plain_text(text or ""))


def brute_hits(texts, groups):
    out = {}
    for k, text in texts.items():
        padded = f" {' '.join(split(text))} "
        if n := sum(any(f" {t} " in padded for t in g) for g in groups):
            out[k] = n
    return out


def brute_top(texts, lexemes, most):
    scores = {}
    for k, text in texts.items():
        words = split(text)
        if s := sum(n / (n + 1) for x in lexemes if (n := words.count(x))):
            scores[k] = round(s, 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most]


GROUPS = (("cancion", "arbol"), ("de la", "que el casa"), ("missing",), ("house the", "rio"))


def test_index_follows_its_texts(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    texts = {**some_texts(), 900: None, 901: "", 902: "..."}
    index = TextIndex(spark, str(tmp_path / "index"))
    assert index.hits(GROUPS).count() == 0 and index.top(["casa"], 5).count() == 0
    assert index.refresh(frame(spark, texts)) == {"new": 122, "changed": 0, "gone": 0}
    held = lambda: {r.id: r.hits for r in index.hits(GROUPS).collect()}
    assert held() == brute_hits(texts, GROUPS)
    assert index.refresh(frame(spark, texts)) == {"new": 0, "changed": 0, "gone": 0} and len(index.segments()) == 1
    for k in range(0, 120, 5):
        texts[k] = "canción de la casa"
    for k in range(1, 120, 10):
        del texts[k]
    texts[2], texts[500] = None, "el árbol"
    assert index.refresh(frame(spark, texts)) == {"new": 1, "changed": 24, "gone": 13}
    assert held() == brute_hits(texts, GROUPS)
    texts[1] = "río"  # comes back
    assert index.refresh(frame(spark, texts)) == {"new": 1, "changed": 0, "gone": 0}
    assert held() == brute_hits(texts, GROUPS) and len(index.segments()) == 3
    index.compact()
    assert held() == brute_hits(texts, GROUPS) and len(index.segments()) == 1
    assert index.refresh(frame(spark, texts)) == {"new": 0, "changed": 0, "gone": 0}


@pytest.mark.parametrize("most", [1, 7, 500])
def test_ranked_search_reads_few_blocks_and_misses_nothing(spark, tmp_path, most):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    texts = some_texts(9)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.refresh(frame(spark, texts))
    got = [(r.id, r.score) for r in index.top(["casa", "rio", "missing"], most).collect()]
    assert sorted(got, key=lambda x: (-x[1], x[0])) == brute_top(texts, ["casa", "rio"], most)


def test_search_prunes_files(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.refresh(frame(spark, some_texts()))
    found = index.postings(["cancion"])
    assert re.search(r"PartitionFilters: \[.*bucket", found._jdf.queryExecution().executedPlan().toString())
    everything = spark.read.parquet(f"{index.folder}/{index.segments()[0]}/postings")
    assert found.select(F.input_file_name()).distinct().count() == 1 < len(everything.inputFiles())
    assert found.count() == sum("cancion" in split(t) for t in some_texts().values())


def test_stemmed_index_holds_stems_of_words_with_a_meaning(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), stemmed=True)
    index.refresh(frame(spark, {1: "Trabajó en la casa", 2: "trabajando de la noche", 3: "la de el"}))
    stem = textindex.text_functions.plain_text(textindex.spanish.stem("trabajando"))
    assert {(r.id, tuple(r.positions)) for r in index.postings([stem]).collect()} == {(1, (0,)), (2, (0,))}
    assert index.postings(["la", "de"]).count() == 0


def test_a_writer_that_fails_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.refresh(frame(spark, {1: "casa"}))
    monkeypatch.setattr(textindex, "replace_json", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        index.refresh(frame(spark, {1: "perro"}))
    assert {r.id for r in index.hits((("casa",),)).collect()} == {1} and index.hits((("perro",),)).count() == 0
