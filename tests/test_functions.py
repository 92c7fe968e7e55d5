import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veinwork.functions import dates, experience, geo, text
from veinwork.operators.merge import merged_rows
from veinwork.operators.ranking import credible_name, rank
from veinwork.plans.interpret import interpret, place_of, retrieval_terms


def values(spark, inputs, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r.out for r in df.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_fold_and_keys(spark):
    assert values(spark, ["  Ñandú  ÇA ", None, ""], text.fold) == ["nandu ca", None, ""]
    assert values(spark, ["San José-de  Mayo"], text.place_key) == ["san jose de mayo"]


def test_phone_identity(spark):
    assert values(spark, ["+598 9123 4567", "091234567", "12", None], text.phone_identity) == ["091234567", "091234567", "", None]


def test_clean_phones(spark):
    df = spark.createDataFrame([(["091 234 567", "0000000", "2222222", "20240131", "123456789012", "59891234567", "091 234 567"],)], "v array<string>")
    assert df.select(text.clean_phones(F.col("v"))).first()[0] == ["091 234 567", "59891234567"]


def test_mojibake(spark):
    assert values(spark, ["AdministraciÃ³n", "Ángel", "plain", "日本"], text.repair_mojibake) == ["Administración", "Ángel", "plain", "日本"]


def test_html_and_documents(spark):
    assert values(spark, ["<p>A&amp;B</p><script>x<y</script> c"], text.html_text) == ["A&B c"]
    assert values(spark, ["%PDF-1.4 obj", "a\r\n\n\n\nb\t c"], text.clean_document) == ["", "a\n\nb c"]


def test_names(spark):
    df = spark.createDataFrame([("Ana de los Llanos Prado", "PRADO ANA"), ("Ana Prado", "Ana Ríos"), ("Ana", "Ana"), ("Ana", "Ana Prado")], "a string, b string")
    assert [r[0] for r in df.select(text.names_likely_same(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    assert values(spark, ["Ana Prado", "X", "Ana 2", "Only"], credible_name) == [True, False, False, False]


def test_union_of_intervals_against_brute_force(spark):
    rng = random.Random(4)
    data = [(p, a, a + rng.randint(1, 9)) for p in range(6) for a in (rng.randint(0, 60) for _ in range(12))]
    got = {r.p: r.months for r in dates.union_months(spark.createDataFrame(data, "p int, a int, b int"), "p", "a", "b").collect()}
    assert got == {p: len({m for q, a, b in data if q == p for m in range(a, b)}) for p in range(6)}


def test_dates(spark):
    assert values(spark, ["2024-01-05", "2024-01-05T10:11:12", "1704449472000", "soon", None], lambda c: dates.safe_timestamp(c).cast("string")) == ["2024-01-05 00:00:00", "2024-01-05 10:11:12", "2024-01-05 10:11:12", None, None]
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 9, 40)], "n int")
    assert [r[0] for r in df.select(dates.backoff_minutes(F.col("n"))).collect()] == [1, 1, 2, 16, 256, 256]


def test_distances(spark):
    a, b = place_of("Pocitos"), place_of("Buceo")
    km = spark.range(1).select(geo.km(*[F.lit(x) for x in (a[3], a[4], b[3], b[4])])).first()[0]
    assert km == pytest.approx(2.4, abs=0.2)
    assert place_of("Cordón")[0] == "Cordon" and place_of("nowhere") is None


def test_interpretation():
    p = interpret("Busco abogada con inglés cerca de Carrasco, mas de 3 años de experiencia, mujer")
    assert p.roles == ("abogado",) and p.languages == ("ingles",) and p.places == ("carrasco",)
    assert p.least_months == 36 and p.more_than and p.ignored == ("gender",)
    assert not any("mujer" in t for t in retrieval_terms(p))
    assert interpret("chofer de ambulancia").roles == ("chofer de ambulancia",)
    assert interpret("cajero, se valora ingles").groups == (("cajero", "cajera", "caja"),)
    assert interpret("tiene que vivir en Prado").strict_place and interpret("").concepts == ()


def people(spark, rows):
    full = [
        {"id": k, "full_name": "Ada Ejemplo", "current_role": None, "city": None, "tags": [], "email": [f"x{k}@mail.example"], "phone": [], "summary": None, "quality_score": 70, "document_name": None, "document_text": "", "documents": 1, "latest": dt.datetime(2024, 1, 1)} | r
        for k, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, "id int, full_name string, current_role string, city string, tags array<string>, email array<string>, phone array<string>, summary string, quality_score int, document_name string, document_text string, documents int, latest timestamp")


def ids(df):
    return [r.id for r in df.orderBy("position").collect()]


def now():
    return F.lit("2024-01-05 00:00:00").cast("timestamp")


def test_profession_and_language_are_both_required(spark):
    df = people(spark, [{"current_role": "Abogada", "document_text": "nivel de inglés alto"}, {"current_role": "Abogado"}, {"current_role": "Cajero", "document_text": "inglés"}])
    assert ids(rank(df, interpret("abogado con ingles"), now())) == [0]


def test_rows_without_a_credible_name_are_not_ranked(spark):
    names = ["Ada Ejemplo", "Ada", "Ada Ejemplo 2", "Auxiliar Administrativo", "Paso Molino", "Curriculum Vitae", "Nombre Apellido", "Ana María D'Prado-Ríos", None]
    df = people(spark, [{"full_name": n, "current_role": "Cajera"} for n in names])
    assert sorted(ids(rank(df, interpret("cajera"), now()))) == [0, 7]
    assert len(ids(rank(df, interpret("cajera"), now(), any_name=True))) == len(names)


def test_a_skill_only_scores(spark):
    df = people(spark, [{"current_role": "Vendedor"}, {"current_role": "Vendedora", "document_text": "excel"}, {"current_role": "Mozo", "document_text": "excel"}])
    assert ids(rank(df, interpret("vendedor excel"), now())) == [1, 0]


def test_places_order_and_drop(spark):
    df = people(spark, [{"current_role": "Operario", "city": "Salto"}, {"current_role": "Operario", "city": "Prado"}, {"current_role": "Operario", "city": None}, {"current_role": "Operario", "city": "Paso Molino"}])
    ranked = rank(df, interpret("operario cerca del prado"), now())
    assert ids(ranked) == [1, 3, 2]
    assert {r.id: r.score <= 79 for r in ranked.collect()}[2]


def test_months_of_experience(spark):
    cases = {
        "Abogado 03/2019 - 02/2021": 24,
        "abogado, enero de 2020 hasta dic. 2020": 12,
        "Abogado 2022 – actualidad": 25,
        "abogado 2018 a 2019; abogado 06/2019-12/2020": 36,
        "abogado 2021-2019": None,
        "abogado 1950-2010": None,
        "Abogado 13/2019 - 00/2020": 2,
        "abogado" + " x" * 200 + " 2019-2020": None,
        "Abogado con más de 4 años": 48,
        "7 meses de experiencia como abogado": 7,
        "abogado con 2 años y con 5 años": 24,
        "2 años y 5 años como abogado": 24,
        "abogado. con 5 años": None,
        "abogado con 60 años": None,
        "x " * 9000 + "Abogado 2019-2020": 24,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "id long, t string")
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    got = df.select("id", experience.relevant_months(F.col("t"), ("Abogado",), as_of).alias("m"), experience.relevant_months(F.col("t"), (), as_of).alias("none")).collect()
    assert {r.id: r.m for r in got} == dict(enumerate(cases.values())) and all(r.none is None for r in got)


def test_occurrences_know_where_they_are(spark):
    df = spark.createDataFrame([("12 ab 3",), ("",), ("x",), ("77",)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(experience.occurrences(F.col("t"), "[0-9]+")).collect()]
    assert got == [[(0, "12"), (6, "3")], [], [], [(0, "77")]]


def test_required_experience_drops_the_unproven(spark):
    df = people(spark, [{"current_role": "Abogada", "document_text": t} for t in ("Abogada 2015 - 2019", "Abogada 01/2021 - 12/2023", "Abogada", "Abogada 2010 - 2012 " + "x " * 300 + "cajera 2013 - 2022")])
    ranked = rank(df, interpret("Abogada, mas de 3 años"), now())
    assert {r.id: r.experience_months for r in ranked.collect()} == {0: 60}
    assert sorted(ids(rank(df, interpret("Abogada, al menos 3 años"), now()))) == [0, 1, 3]
    assert len(ids(rank(df, interpret("Abogada"), now()))) == 4
    late = df.filter("id = 2").withColumn("document_text", F.lit("x " * 9000 + "abogada 2015 - 2020"))
    assert ids(rank(late, interpret("Abogada, mas de 3 años"), now())) == [2]


def test_one_row_for_each_person(spark):
    twin = {"current_role": "Cajera", "email": ["same@mail.example"], "document_name": "resume one.pdf"}
    df = people(spark, [twin, twin | {"quality_score": 60}, twin | {"document_name": "other file.pdf"}])
    assert ids(rank(df, interpret("cajera"), now())) == [0, 2]


def test_gender_changes_nothing(spark):
    df = people(spark, [{"current_role": "Cajera"}, {"current_role": "Cajero"}])
    plain, asked = (rank(df, interpret(t), now()) for t in ("cajero", "cajero mujer"))
    assert [(r.id, r.score) for r in plain.orderBy("position").collect()] == [(r.id, r.score) for r in asked.orderBy("position").collect()]


def test_merge_outcomes(spark):
    a = spark.createDataFrame([(1, "x", ["a"]), (2, "y", []), (3, "z", ["q"])], "id int, v string, l array<string>")
    b = spark.createDataFrame([(1, "x", ["a"]), (2, None, ["n"]), (4, "w", [])], "id int, v string, l array<string>")
    got = {r.id: (r.v, r.l, r.outcome) for r in merged_rows(a, b, "id", {"v": "incoming", "l": "union"}).collect()}
    assert got == {1: ("x", ["a"], "unchanged"), 2: ("y", ["n"], "updated"), 3: ("z", ["q"], "kept"), 4: ("w", [], "new")}
