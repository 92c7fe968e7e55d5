"""Work that has to grow no faster than its input."""

import unicodedata

from veinwork.functions import names, profile
from veinwork.functions import vocabulary as words
from tests.helpers import SMALL


def test_people_are_dealt_to_all_cores(spark):
    from veinwork.plans.name_queries import people
    from veinwork.plans.profile_queries import documents_of_people

    cores = spark.sparkContext.defaultParallelism
    assert people(spark, SMALL).rdd.getNumPartitions() >= cores
    assert documents_of_people(spark, SMALL).rdd.getNumPartitions() >= cores


def test_folding_looks_at_each_character_once(monkeypatch):
    seen = []
    real = unicodedata.normalize
    monkeypatch.setattr(names.unicodedata, "normalize", lambda form, s: seen.append(s) or real(form, s))
    assert profile.folded("Ñandú Ωmega İzmir\x00 ß ﬁ" * 1000) == "nandu ωmega izmir  ß ﬁ" * 1000
    assert len(seen) < 50
    assert names.plain("ÁRBOL é Σ") == "arbol e σ"


def test_words_with_marks_are_still_found():
    text = "abogada, asesor legal y tecnica en sistemas"
    for table in (words.ROLE_FORMS, words.SKILL_FORMS, words.LANGUAGE_FORMS):
        want = [(m.start(), k, label) for k, (label, forms) in enumerate(table.items()) if (m := words.compiled(forms).search(text))]
        assert words.places(text, table) == want


def test_similar_pairs_against_all_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veinwork.functions.text import names_likely_same
    from veinwork.operators import similar

    monkeypatch.setattr(similar, "SHARE", 3)  # a common name is dealt to several groups
    given = ["x", "X", "ana ana", "b ana", "ana bo", "Ánà  BO", None, "", "", "bo ana de", "ana bo cruz", "cruz bo lima", "lima de bo", *["red ring"] * 8, "ring red"]
    df = spark.createDataFrame([(k, n, k % 5 and "one" or "two") for k, n in enumerate(given * 2)] + [(99, "x", None)], "id long, name string, block string")
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")) & names_likely_same(F.col("a.name"), F.col("b.name"))).select("a.id", F.col("b.id").alias("o"))
    got = similar.similar_pairs(df, "id", "name", "block")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_everybody_near_a_place_is_ranked(spark):
    from tests.helpers import database, same
    from veinwork.plans.registry import oracle_sql, queries

    middle = "/root/testdata/sf0.01"
    found = queries()["requested_near_a_place"](spark, middle)
    assert found.count() == spark.read.parquet(f"{middle}/customer.parquet").filter("c_custkey % 4 < 2").count() > 300
    same(found, database(middle), oracle_sql()["requested_near_a_place"])


def test_a_large_landing_has_few_files_and_one_stream(spark, tmp_path):
    import json

    from veinwork.sources import landed

    feed, read = str(tmp_path / "landed"), str(tmp_path / "read")
    n = 3 * landed.RANGE * landed.FOLDERS
    known = landed.land(spark.range(n).select("id"), feed, ["id"])
    assert len(landed._pieces(feed, known, 0, n, "table")) <= landed.FOLDERS + 1
    out = landed.deliver(spark, feed, "position long, id long", read, most=n // 5)
    assert out.count() == out.distinct().count() == n
    # Each batch kept to the budget, and all were of one start of the stream.
    ends = [json.loads((tmp_path / "read/checkpoint/offsets" / str(k)).read_text().splitlines()[-1])["position"] for k in range(5)]
    assert ends == [min(n, (k + 1) * (n // 5)) for k in range(5)]
    assert landed.deliver(spark, feed, "position long, id long", read, most=n // 5).count() == n


def test_an_index_has_a_row_for_many_texts(spark, tmp_path):
    from veinwork.operators.lexemes import located, spaced
    from veinwork.operators.textindex import TextIndex

    texts = [(k, "the same words " * (k % 3 + 1)) for k in range(400)]
    index = TextIndex(spark, str(tmp_path / "index"))
    index.refresh(spark.createDataFrame(texts, "id long, text string").coalesce(1))
    stored = spark.read.parquet(f"{tmp_path}/index/{index.segments()[0]}/postings")
    assert stored.count() < 30 and {r.id: r.positions for r in index.postings(["same"]).collect()} == {k: [1, 4, 7][: k % 3 + 1] for k, _ in texts}
    # Words are told apart at once as one by one, in texts beyond Latin-1 too.
    odd = ["Ñandú éa Éa İx", "Σ’ας 中文 naïve_x ½ ² é", "ß Æ\xa0Æ\x85ª"]
    for form in ("folded", "plain"):
        rows = located([7, 8, 9], [spaced(t, form == "folded") for t in odd], form).to_pylist()
        places = {(r["lexeme"], i): r["positions"][b:e] for r in rows for i, b, e in zip(r["ids"], [0, *r["ends"]], r["ends"])}
        assert places["ea", 7] == [1, 2] and places["nandu", 7] == [0] and places["æ", 9] == [1, 2] and places["x", 8] == [4] and places["½", 8] == [5]
        assert (("ix", 7) in places) == (form == "folded")  # a mark that stands alone parts words only before folding


def test_postings_of_a_text_need_no_shuffle(spark):
    from veinwork.operators.postings import postings, updated

    rows = spark.createDataFrame([(1, "Casa casa Ñandú"), (2, None), (3, "casas"), (4, "de la")], "id long, text string")
    for stemmed, want in ((False, {("casa", 1, (0, 1)), ("nandu", 1, (2,)), ("casas", 3, (0,)), ("de", 4, (0,)), ("la", 4, (1,))}), (True, {("cas", 1, (0, 1)), ("nandu", 1, (2,)), ("cas", 3, (0,))})):
        found = postings(rows, stemmed)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.lexeme, r.id, tuple(r.positions)) for r in found.collect()} == want
    after = spark.createDataFrame([(1, "Casa casa Ñandú"), (3, "otra")], "id long, text string")
    assert {(r.lexeme, r.id) for r in updated(postings(rows, False), rows, after, False).collect()} == {("casa", 1), ("nandu", 1), ("otra", 3)}


def test_an_object_is_parsed_once_for_all_fields(monkeypatch):
    import json

    from veinwork.sources import readers

    text = json.dumps({"a": [{"Nombre": "Ana", "x": {"email": "a@b.uy"}}], "city": {"name": {"label": "Salto"}, "correo": "in@city.uy"}, "apellido": "Paz", "phones": [1234567, None, True, "1234567"]})
    wanted = {"n": ["nombre"], "e": ["email", "correo"], "c": ["city"], "both": ["city", "nombre"], "p": ["phones"]}
    assert readers.deep_fields(json.loads(text), wanted) == {k: readers.deep_values(text, v) for k, v in wanted.items()}
    assert readers.deep_values(text, ["email", "correo"]) == ["a@b.uy", "in@city.uy"] and readers.deep_values(text, ["city"]) == ["Salto"]
    parsed, real = [], json.loads
    monkeypatch.setattr(json, "loads", lambda s: parsed.append(s) or real(s))
    assert profile.from_json(text)["full_name"] == "Ana Paz" and len(parsed) == 1


def test_references_are_cut_by_a_number(spark):
    from veinwork.operators import relational
    from veinwork.plans.text_queries import reference_cut

    found = reference_cut(spark, SMALL)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for text, head in (("año\nReferencias Laborales: x", "año\n"), ("referencias laborales: x", "referencias laborales: x"), ("Ω ñ REFERENCIAS PERSONALES", "Ω ñ "), ("nada", "nada")):
        assert profile.before_references(text) == head and profile.references_at(text) == (len(head) if head != text else 0)
    latin = "".join(map(chr, range(1, 256)))
    assert profile.folded(latin) == latin.translate(profile._FOLDS)
    assert relational.SPREAD_BYTES * spark.sparkContext.defaultParallelism >= 512 << 20


class _Cell:
    """A value or map state, with the number of writes."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def updateValue(self, key, value):
        self.held[key] = value
        self.writes += 1

    getValue = lambda self, key: self.held.get(key)
    removeKey = lambda self, key: self.held.pop(key)
    iterator = lambda self: iter(list(self.held.items()))
    exists = lambda self: () in self.held
    get = lambda self: self.held[()]
    update = lambda self, value: self.updateValue((), value)
    clear = lambda self: self.held.clear()


def test_serial_state_has_few_entries_and_one_timer_for_many_keys():
    from types import SimpleNamespace

    import pandas as pd

    from veinwork.streaming import stateful

    cells, timers = {}, set()
    cell = lambda name, *_: cells.setdefault(name, _Cell())
    handle = SimpleNamespace(getMapState=cell, getValueState=cell, registerTimer=timers.add, deleteTimer=timers.remove)
    work = stateful.Serial(lambda s, e: ((s or 0) + 1, ((s or 0) + 1,)), "ts", ["id"], "user", ["place"])
    work.init(handle)
    feed = lambda ids: work.handleInputRows((0,), iter([pd.DataFrame({"bucket": [i % 500 % 8 for i in ids], "user": [str(i % 500) for i in ids], "ts": pd.to_datetime([10_000 + i for i in ids], unit="s"), "id": ids})]), None)
    list(feed(list(range(2000, 0, -1))))
    assert cells["keys"].writes == 8 and timers == {10_001_000}
    passed = SimpleNamespace(getCurrentWatermarkInMs=lambda: 11_500_000)
    timers.clear()
    found = pd.concat(work.handleExpiredTimer((0,), passed, None))
    assert sorted(found["id"]) == list(range(1, 1501)) and timers == {11_501_000}
    by_user = found.groupby("user")
    assert all(g["id"].is_monotonic_increasing and list(g["place"]) == list(range(1, len(g) + 1)) for _, g in by_user)


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_folded_once_for_months_of_experience(spark):
    from pyspark.sql import functions as F

    from veinwork.functions.experience import relevant_months

    months = relevant_months(F.col("t"), ("cajero", "cajera", "caja"), F.lit("2001-09-01").cast("timestamp_ntz"))
    assert _optimized(spark.range(9).select(F.concat(F.lit("Cajera "), "id").alias("t")).select(months.alias("m"))).count("translate(") == 1


def test_parts_of_a_page_are_cleaned_once(monkeypatch):
    seen = []
    real = names.clean_name
    monkeypatch.setattr(names, "clean_name", lambda text: seen.append(text) or real(text))
    assert names.people_in("<tr><td>Ana Paz</td><td>ana@mail.example</td></tr>") == [("Ana Paz", "ana@mail.example")]
    assert len(seen) == len(set(seen)) == 1


def test_names_are_checked_after_people_are_dealt(spark):
    from pyspark.sql import functions as F

    from veinwork.operators.ranking import rank
    from veinwork.plans.interpret import interpret
    from veinwork.plans.request_queries import REQUEST, hydrated_people

    found = rank(hydrated_people(spark, SMALL), interpret(REQUEST), F.lit("2001-09-01").cast("timestamp_ntz"), most=100)
    dealt = _optimized(found).split("Repartition", 1)[1]
    assert "RLIKE" not in dealt.split("\n", 1)[1]


def test_people_are_ranked_once_for_all_orders(spark):
    from veinwork.plans.request_queries import resorted_results

    assert "Relation" not in _optimized(resorted_results(spark, SMALL))


def test_rows_of_a_queue_share_entries_of_its_state():
    import pandas as pd

    from veinwork.streaming import stateful

    class State(dict):
        calls = 0

        def updateValue(self, key, value):
            State.calls += 1
            self[key] = value

        def getValue(self, key):
            State.calls += 1
            return self.get(key)

        def containsKey(self, key):
            State.calls += 1
            return key in self

        def removeKey(self, key):
            del self[key]

        def iterator(self):
            return iter(list(self.items()))

    class Handle:
        def getMapState(self, *_):
            return State()

    queue = stateful.LeaseQueue()
    queue.init(Handle())
    columns = [c.split()[0] for c in stateful.QUEUE.split(", ")]
    put = [(0, "enqueue", 8 * k, k, None, 0, 0, None) for k in range(20_000)]
    got = [r for d in queue.handleInputRows((0,), iter([pd.DataFrame([*put, (0, "claim", 0, 0, "a", 1, 2, None)], columns=columns)]), None) for r in d.itertuples(index=False)]
    assert [(r.id, r.state) for r in got] == [(0, "leased"), (8, "leased")]
    assert State.calls <= 2 * stateful.QUEUE_BUCKETS
    done = pd.DataFrame([(0, "done", 0, 0, "a", 2, 0, "ok"), (0, "enqueue", 0, 0, None, 3, 0, None), (0, "claim", 0, 0, "b", 4, 1, None)], columns=columns)
    assert [(r.id, r.state) for d in queue.handleInputRows((0,), iter([done]), None) for r in d.itertuples(index=False)] == [(0, "done"), (16, "leased")]
