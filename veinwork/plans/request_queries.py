"""Searches that begin with a request in words, over documents made from known facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.operators.fits import KINDS, domain_fit
from veinwork.operators.ranking import basic_fit, factory_work, rank, resorted, studied, together
from veinwork.plans.base import query
from veinwork.plans.interpret import interpret
from veinwork.plans.name_queries import PEOPLE, people
from veinwork.plans.profile_queries import ROLES, documents_of_people
from veinwork.sources.tables import AS_OF

REQUEST = "Busco abogada con ingles"


def hydrated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranking takes, for everybody: roles by turns, a document each, no dates."""
    k = F.col("id")
    role = F.element_at(F.array(*[F.lit(r.partition(" en ")[0]) for r, _, _ in ROLES]), (k % len(ROLES) + 1).cast("int"))
    return documents_of_people(spark, sf_dir).select(
        "id",
        F.col("name").alias("full_name"),
        role.alias("current_role"),
        F.lit(None).cast("string").alias("city"),
        F.array().cast("array<string>").alias("tags"),
        F.array(F.concat(F.lit("p"), k, F.lit("@mail.example"))).alias("email"),
        F.array().cast("array<string>").alias("phone"),
        F.lit(None).cast("string").alias("summary"),
        (k % 100).cast("int").alias("quality_score"),
        F.concat(F.lit("file-"), k).alias("document_name"),
        F.col("text").alias("document_text"),
        F.lit(1).alias("documents"),
        F.when(k % 3 > 0, F.timestamp_add("DAY", -(k % 500).cast("int"), F.lit("2000-01-01").cast("timestamp_ntz"))).alias("latest"),
    )


#: Both concepts stand in the document (55 + 25), the role in the profile (5), there is a document (5) and a contact (5); ages over a year add nothing but to those within one.
_RANKED = f"""
WITH {PEOPLE}, d AS (
  SELECT id, name, id % 100 AS quality, CASE WHEN id % 3 > 0 THEN TIMESTAMP '2000-01-01' - to_days(CAST(id % 500 AS INTEGER)) END AS latest FROM people WHERE id % 5 = 0 AND id % 7 <> 6),
r AS (SELECT *, row_number() OVER (ORDER BY quality DESC, id) AS position FROM d)"""


@query(_RANKED + " SELECT position, id, name AS full_name, 95 AS score FROM r WHERE position <= 100")
def requested_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request in words, interpreted, then ranked over everybody's documents: the first 100."""
    found = rank(hydrated_people(spark, sf_dir), interpret(REQUEST), F.lit(AS_OF).cast("timestamp_ntz"), most=100)
    return found.filter("position <= 100").select("position", "id", "full_name", "score")


@query(_RANKED + """, t AS (SELECT * FROM r WHERE position <= 300)
SELECT 'recent' AS by, id, row_number() OVER (ORDER BY coalesce(latest, TIMESTAMP '1970-01-01') DESC, position) AS position FROM t
UNION ALL SELECT 'oldest', id, row_number() OVER (ORDER BY latest ASC NULLS LAST, position) FROM t
UNION ALL SELECT 'name', id, row_number() OVER (ORDER BY lower(name), position) FROM t""")
def resorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 first results in three other orders."""
    found = rank(hydrated_people(spark, sf_dir), interpret(REQUEST), F.lit(AS_OF).cast("timestamp_ntz"), least=90, most=300).checkpoint(eager=True)  # 300 rows: everybody is ranked once for all orders
    return reduce(DataFrame.unionByName, [resorted(found, by).select(F.lit(by).alias("by"), "id", "position") for by in ("recent", "oldest", "name")])


#: One text for each signal, and the order of signals as bits of a number.
_SHOWN = {
    "mechanic": ("electromecanico", "autoelevadores", "planta industrial", "hidraulica", "mantenimiento preventivo"),
    "refrigeration": ("frigorista", "camara frigorifica", "amoniaco", "mantenimiento correctivo"),
    "warehouse": ("pesaje de cargas", "control documental", "jefe"),
}


def _fit_sql(domain: str) -> str:
    bit = lambda k: f"(id >> {k}) & 1 = 1"
    if domain == "mechanic":
        s, h, p, y, u = map(bit, range(5))
        return f"CASE WHEN {s} AND {h} AND {y} THEN 7 WHEN {h} AND {u} AND ({s} OR {y}) THEN 6 WHEN {s} AND {p} AND {u} THEN 6 WHEN {s} AND ({p} OR {y}) THEN 5 WHEN {s} AND {h} THEN 4 WHEN {s} AND {u} THEN 3 ELSE 0 END"
    if domain == "refrigeration":
        s, c, g, u = map(bit, range(4))
        return f"CASE WHEN {s} AND {c} AND {u} THEN 6 WHEN {s} AND {u} THEN 5 WHEN {c} AND {u} THEN 4 WHEN {c} THEN 3 WHEN {g} AND {u} THEN 3 ELSE 0 END"
    t, r, b = map(bit, range(3))
    return f"CASE WHEN {t} THEN 6 WHEN {r} AND NOT ({b}) THEN 4 WHEN {b} THEN -1 ELSE 1 END"


@query(f"WITH {PEOPLE} " + " UNION ALL ".join(f"SELECT id, '{d}' AS domain, {_fit_sql(d)} AS fit FROM people" for d in _SHOWN))
def domain_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well evidence fits three special kinds of work, over every combination of signals."""
    p, out = people(spark, sf_dir), []
    for domain, shown in _SHOWN.items():
        parts = [F.when(F.shiftright("id", k) % 2 == 1, F.lit(t)) for k, t in enumerate(shown)]
        role = parts.pop(0 if domain == "refrigeration" else 2) if domain != "mechanic" else F.lit("")
        out.append(p.select("id", F.lit(domain).alias("domain"), domain_fit(domain, F.coalesce(role, F.lit("")), F.concat_ws(" y ", *parts)).alias("fit")))
    assert set(_SHOWN) == set(KINDS)
    return reduce(DataFrame.unionByName, out)


@query(f"""
WITH {PEOPLE} SELECT id, id % 4 NOT IN (0, 3) AS allowed, id % 4 IN (1, 3) AS basic, id % 4 = 1 AS factory, id % 5 < 2 AS driving, id % 6 < 2 AS studies FROM people""")
def work_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basic profiles, factory work, patients' transport near driving, and studies in their context."""
    k = F.col("id")
    role = F.when(k % 4 == 0, "contadora").when(k % 4 == 1, "operario").when(k % 4 == 2, "pintor").otherwise("ingeniero")
    text = F.when(k % 4 == 3, "stock y limpieza").otherwise(role)
    drive = F.when(k % 5 == 0, "manejo de camioneta, traslado de pacientes").when(k % 5 == 1, "ambulancia como conductor").when(k % 5 == 2, F.concat(F.lit("chofer "), F.repeat(F.lit("x"), 120), F.lit(" ambulancia"))).otherwise("traslado de pacientes")
    study = F.when(k % 6 == 0, "egresada de la carrera de contador publico").when(k % 6 == 1, "estudios: economia, luego contadora").when(k % 6 == 2, "contador en una firma").otherwise("carrera de letras")
    allowed, basic = basic_fit(role, text)
    return people(spark, sf_dir).select(
        "id",
        allowed.alias("allowed"),
        basic.alias("basic"),
        factory_work(role, F.lit(""), F.lit("")).alias("factory"),
        together(drive, "chofer|conductor|driver|manejo|conduccion", "ambulancia|traslado de pacientes").alias("driving"),
        studied(study, interpret("estudiante de contador publico").studies[0]).alias("studies"),
    )


#: Requests, and what has to be understood of them: roles, languages, domain, studies, months, retrieval.
REQUESTS = (
    ("Abogada con inglés, más de 3 años de experiencia", "abogado", "ingles", None, 0, 36),
    ("Técnico frigorista, sistemas de refrigeración y amoniaco", "tecnico en refrigeracion", "", "refrigeration", 0, None),
    ("Mecánico industrial para autoelevadores", "mecanico industrial", "", "mechanic", 0, None),
    ("Vendedor de terreno con cartera de clientes", "vendedor de terreno", "", "field sales", 0, None),
    ("Chofer de ambulancia para traslado de pacientes", "chofer de ambulancia", "", "ambulance", 0, None),
    ("Estudiante avanzado de contador público", "contador", "", None, 1, None),
    ("Administrativo. Tareas: control de remitos y pesaje en depósito, verificación de mercadería", "administrativo", "", "warehouse", 0, None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r}', '{l}', {'NULL' if d is None else repr(d)}, {s}, {'NULL' if m is None else m})" for k, (_, r, l, d, s, m) in enumerate(REQUESTS)) + ") t(request, role, languages, domain, studies, months)")
def requests_interpreted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is understood of requests: interpretation runs once for a request, on the driver."""
    plans = [interpret(text) for text, *_ in REQUESTS]
    rows = [(k, p.roles[0] if p.roles else None, ",".join(p.languages), p.domain, len(p.studies), p.least_months) for k, p in enumerate(plans)]
    return spark.createDataFrame(rows, "request int, role string, languages string, domain string, studies int, months int")


@query(f"""
WITH {PEOPLE}, r AS (SELECT id, name, id % 4 AS k, id % 100 AS quality FROM people WHERE id % 4 < 2)
SELECT CAST(row_number() OVER (ORDER BY CASE k WHEN 0 THEN 0 ELSE 1 END, quality DESC, id) AS BIGINT) AS position, id, CASE k WHEN 0 THEN 'nearby' ELSE 'broad' END AS place_verdict FROM r""")
def requested_near_a_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request that names a place: those who verifiably live near it come first, then the merely possible; others are left out."""
    k = F.col("id") % 4
    city = F.when(k == 0, "Pocitos").when(k == 1, "Montevideo").when(k == 2, "Salto").otherwise("Rivera")
    rows = hydrated_people(spark, sf_dir).withColumns({"current_role": F.lit("Cajera"), "city": city, "document_text": F.lit("cajera"), "latest": F.lit(None).cast("timestamp_ntz")})
    found = rank(rows, interpret("cajera en Pocitos"), F.lit(AS_OF).cast("timestamp_ntz"), least=50, whole=True)
    return found.select("position", "id", "place_verdict")
