"""Documents of people over a whole table. Texts are made from known facts, so that SQL can say what has to be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import profile
from veinwork.functions.experience import relevant_months
from veinwork.functions.perrow import per_row
from veinwork.plans.base import query
from veinwork.plans.name_queries import PEOPLE, people
from veinwork.sources.tables import AS_OF

ROLES = (("Abogada", "abogado", "abogado"), ("Vendedora en Casa Tres", "call center", "call center,ventas"), ("Enfermero", "enfermeria", "enfermeria,salud"), ("Cajera", "cajero", "cajero"), ("Soldador", "soldador", "soldador"))
CITIES = (("Domicilio: Calle Salto 1234, Pocitos", "Pocitos"), ("Vive en Villa Nueva", "Villa Nueva"), ("Direccion: Camino Maldonado 5", "Montevideo"), ("Contacto: Malvín Norte", "Malvin"))
LEVELS = ("avanzado", "intermedio", "B2")


def _at(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _sql_at(values: tuple[str, ...], k: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({k} % {len(values)} + 1 AS INTEGER)]"


def documents_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, text): a document of each person; every seventh can't be read, every ninth names places of work only."""
    k = F.col("id")
    low = F.replace(F.lower("name"), F.lit(" "), F.lit("."))
    place = F.when(k % 9 == 8, F.lit("Persona responsable y puntual")).otherwise(_at(tuple(c for c, _ in CITIES), k))
    text = F.concat_ws(
        "\n",
        "name",
        F.when(k % 9 == 8, F.lit("Sin mas datos de momento")).otherwise(F.concat(low, F.lit("@mail.example 099 12"), F.lpad((k % 10000).cast("string"), 4, "0"))),
        F.concat(place, F.lit(", Telefono aparte")),
        F.lit("Experiencia laboral previa"),
        F.concat(F.lit("Desde marzo 2015 hasta actualidad: "), _at(tuple(r for r, _, _ in ROLES), k), F.lit(" en una firma de Salto")),
        F.lit("Tareas varias del cargo, con mucha dedicacion diaria"),
        F.lit("Estudios y otros titulos logrados"),
        F.lit("Bachillerato completo en la empresa del Liceo Dos"),
        F.concat(F.lit("Idiomas: inglés "), _at(LEVELS, k), F.lit(". Manejo de Excel y SQL.")),
        F.concat(F.lit("Cuento con "), (k % 40 + 1).cast("string"), F.lit(" años de experiencia.")),
        F.lit("Referencias laborales: Juan Paz, electricista en Rocha, 098 765 432"),
    )
    return people(spark, sf_dir).select("id", "name", F.when(k % 7 == 6, F.lit("%PDF-1.4 endobj xref")).otherwise(text).alias("text"))


READABLE = "id % 7 <> 6"
_FOUND = f"""
WITH {PEOPLE}, d AS (
  SELECT id, name, {READABLE} AS ok, {_sql_at(tuple(p for _, p, _ in ROLES), 'id')} AS role, {_sql_at(tuple(r for _, _, r in ROLES), 'id')} AS roles,
         CASE WHEN id % 9 <> 8 THEN {_sql_at(tuple(c for _, c in CITIES), 'id')} END AS city, lower({_sql_at(LEVELS, 'id')}) AS level, id % 40 + 1 AS years FROM people)"""


@query(_FOUND + """
SELECT id, CASE WHEN ok THEN role END AS primary_role, CASE WHEN ok THEN roles END AS roles, CASE WHEN ok AND role = 'cajero' THEN 'caja,excel,sql' WHEN ok THEN 'excel,sql' END AS skills, CASE WHEN ok THEN 'ingles ' || level END AS languages,
       CAST(CASE WHEN ok THEN years END AS INTEGER) AS years, CASE WHEN ok THEN city END AS city, CASE WHEN ok THEN 'high' END AS confidence FROM d""")
def documents_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with the employer's, skills, languages with levels, years, residence and confidence; references don't count."""
    kind = "struct<primary_role:string,roles:string,skills:string,languages:string,years:int,city:string,confidence:string>"
    return documents_of_people(spark, sf_dir).select("id", per_row(_analysed, kind)("text").alias("f")).select("id", "f.*")


def _analysed(text):
    f = profile.analyse(text)
    return f and (f["primary"], ",".join(sorted(f["roles"])), ",".join(sorted(f["skills"])), ",".join(f"{n} {v}" for n, v in f["languages"]), f["years"], f["city"], f["confidence"])


@query(_FOUND + f"""
SELECT id, CASE WHEN ok THEN 'Desde marzo 2015 hasta actualidad: ' || {_sql_at(tuple(r for r, _, _ in ROLES), 'id')} || ' en una firma de Salto|Tareas varias del cargo, con mucha dedicacion diaria' END AS experience,
       CASE WHEN ok THEN 'Bachillerato completo en la empresa del Liceo Dos' END AS education FROM d""")
def section_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telling lines of the sections on work and studies."""
    return documents_of_people(spark, sf_dir).select("id", per_row(_highlights, "struct<experience:string,education:string>")("text").alias("f")).select("id", "f.*")


def _highlights(text):
    f = profile.analyse(text)
    return f and ("|".join(f["experience"]), "|".join(f["education"]))


@query(_FOUND + """
SELECT id, CASE WHEN ok THEN role ELSE 'Old role' END AS current_role, CASE WHEN ok AND city IS NOT NULL THEN city WHEN ok THEN NULL ELSE '123' END AS city, CAST(CASE WHEN ok THEN years ELSE 99 END AS INTEGER) AS years,
       CASE WHEN ok AND id % 9 <> 8 THEN 2 ELSE 1 END AS n_email, CASE WHEN ok THEN 'kept,' || list_aggregate(list_sort(string_split(roles, ',') || ['excel', 'sql', 'ingles'] || CASE WHEN role = 'cajero' THEN ['caja'] ELSE [] END), 'string_agg', ',') ELSE '77,kept' END AS tags,
       CASE WHEN NOT ok THEN 5 WHEN id % 9 <> 8 THEN 100 ELSE 85 END AS quality_score FROM d""")
def records_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what their documents say: the document wins, lists are joined, values without a letter go."""
    kind = "struct<current_role:string,city:string,years:int,n_email:int,tags:string,quality_score:int>"
    return documents_of_people(spark, sf_dir).select("id", per_row(_enriched, kind)("text").alias("f")).select("id", "f.*")


def _enriched(text):
    old = {"email": ["old@mail.example"], "phone": [], "current_role": "Old role", "city": "123", "years": 99, "tags": ["77", "kept"], "quality_score": 5}
    r = profile.enriched(old, text)
    tags = ["kept", *sorted(t for t in r["tags"] if t != "kept")] if r is not old else old["tags"]
    return r["current_role"], r["city"], r["years"], len(r["email"]), ",".join(tags), r["quality_score"]


@query(_FOUND + """
SELECT id, CASE WHEN ok THEN name ELSE 'Otra Persona' END AS full_name, CASE WHEN ok THEN 'heading' ELSE 'file' END AS name_source, CASE WHEN NOT ok THEN 65 WHEN id % 9 = 8 THEN 85 ELSE 95 END AS name_confidence,
       CASE WHEN ok AND id % 9 <> 8 THEN lower(replace(name, ' ', '.')) || '@mail.example' ELSE '' END AS email, CASE WHEN ok THEN role ELSE 'imported' END AS current_role FROM d""")
def records_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of free texts: names by document, then file, sender and address."""
    kind = "struct<full_name:string,name_source:string,name_confidence:int,email:string,current_role:string>"
    return documents_of_people(spark, sf_dir).select("id", per_row(_from_text, kind)("text").alias("f")).select("id", "f.*")


def _from_text(text):
    r = profile.from_text(text, "mail", "CV otra persona 2020.pdf", "No Reply <noreply@mail.example>")
    return r and (r["full_name"], r["name_source"], r["name_confidence"], ",".join(r["email"]), r["current_role"])


@query(f"""
WITH {PEOPLE} SELECT id, name AS full_name, lower(replace(name, ' ', '.')) || '@mail.example' AS email, CASE WHEN id % 2 = 0 THEN 'Salto' ELSE 'Rivera' END AS city, 'Cajera' AS current_role, CAST(id AS VARCHAR) AS source_id FROM people""")
def records_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of two sources' objects, by the known names of each field at any depth."""
    k, first, last = F.col("id"), F.split("name", " ")[0], F.split("name", " ")[1]
    mail = F.concat(F.replace(F.upper("name"), F.lit(" "), F.lit(".")), F.lit("@MAIL.EXAMPLE"))
    flat = F.to_json(F.struct(k.alias("user_id"), first.alias("first_name"), last.alias("last_name"), F.array(mail).alias("email"), F.struct(F.lit("Salto").alias("name")).alias("city"), F.array(F.struct(F.lit("Cajera").alias("position"))).alias("professional_experience")))
    deep = F.to_json(F.struct(k.alias("IdPostulacion"), F.struct(first.alias("PrimerNombre"), last.alias("PrimerApellido"), mail.alias("Correo"), F.struct(F.lit("Rivera").alias("Nombre")).alias("Ciudad")).alias("Postulante"), F.struct(F.lit("Cajera").alias("CargoVacante")).alias("oferta")))
    kind = "struct<full_name:string,email:string,city:string,current_role:string,source_id:string>"
    return people(spark, sf_dir).select("id", per_row(_from_json, kind)(F.when(k % 2 == 0, flat).otherwise(deep)).alias("f")).select("id", "f.*")


def _from_json(text):
    r = profile.from_json(text)
    return r and (r["full_name"], ",".join(r["email"]), r["city"], r["current_role"], r["source_id"])


@query("""
WITH t AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS named, c_custkey // 2 % 2 = 0 AS contact, c_custkey // 4 % 2 = 0 AS document, (['mail', 'board', 'upload'])[CAST(c_custkey // 8 % 3 + 1 AS INTEGER)] AS source FROM customer)
SELECT id, CASE source WHEN 'mail' THEN document AND (named OR contact) WHEN 'board' THEN document AND named ELSE contact OR named END AS usable FROM t""")
def records_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    bit = lambda n: F.floor(k / n) % 2 == 0
    source = _at(("mail", "board", "upload"), F.floor(k / 8))
    name = F.when(bit(1), F.col("name")).otherwise(F.lit("Responsable de tareas 7"))
    packed = F.to_json(F.struct(name.alias("name"), bit(2).alias("contact"), bit(4).alias("document"), source.alias("source")))
    return people(spark, sf_dir).select("id", per_row(_usable, "boolean")(packed).alias("usable"))


def _usable(text):
    import json

    r = json.loads(text)
    return profile.usable(r["name"], r["contact"], r["document"], False, r["source"])


@query(f"""
WITH {PEOPLE} SELECT id, name AS full_name, 'a' || id || '@mail.example' AS email, '+59899123456' AS phone, NULL AS city, 'Cajera' AS current_role, 'x' AS tags FROM people""")
def records_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.concat(F.lit("A"), "id", F.lit("@Mail.example "))
    packed = F.to_json(F.struct(F.concat(F.lit("cv "), F.lower("name"), F.lit(".pdf")).alias("full_name"), F.array(mail, F.lit("no")).alias("email"), F.array(F.lit("+598 99 123-456"), F.lit("1111111"), F.lit("12")).alias("phone"), F.lit("12345").alias("city"), F.lit(" Cajera ").alias("current_role"), F.array(F.lit("x"), F.lit("pdf"), F.lit("x")).alias("tags")))
    kind = "struct<full_name:string,email:string,phone:string,city:string,current_role:string,tags:string>"
    return people(spark, sf_dir).select("id", per_row(_sanitised, kind)(packed).alias("f")).select("id", "f.*")


def _sanitised(text):
    import json

    r = profile.sanitised(json.loads(text))
    return r["full_name"], ",".join(r["email"]), ",".join(r["phone"]), r["city"], r["current_role"], ",".join(r["tags"])


@query(f"""WITH {PEOPLE} SELECT id, CASE id % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'system' WHEN 2 THEN 'other' ELSE 'candidate' END AS kind FROM people""")
def mail_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    packed = F.to_json(
        F.struct(
            F.when(k % 4 == 1, F.lit("Notifications <no-reply@x.example>")).otherwise(F.concat("name", F.lit(" <p@mail.example>"))).alias("sender"),
            F.when(k % 4 == 0, F.concat(F.lit("CV "), "name", F.lit(".pdf"))).when(k % 4 == 1, F.lit("invoice.pdf")).when(k % 4 == 3, F.lit("scan0001.pdf")).alias("file"),
            F.when(k % 4 == 3, F.lit("Escribir a ana@mail.example, mi experiencia es larga")).alias("text"),
        )
    )
    return people(spark, sf_dir).select("id", per_row(_mail_class, "string")(packed).alias("kind"))


def _mail_class(text):
    import json

    r = json.loads(text)
    return profile.mail_class(r.get("sender"), "hola", "texto", r.get("file"), r.get("text"))


@query(f"""WITH {PEOPLE} SELECT id, CASE id % 4 WHEN 0 THEN 'Pocitos Uruguay' WHEN 1 THEN 'Salto' WHEN 2 THEN 'Rivera Uruguay' ELSE 'Malvin' END AS residence FROM people""")
def effective_residences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's residence unless it is only the department of a more precise city."""
    k = F.col("id")
    cv = F.when(k % 4 == 0, F.lit("Montevideo")).when(k % 4 == 1, F.lit("Salto")).when(k % 4 == 3, F.lit("Malvin"))
    city = F.when(k % 4 == 2, F.lit("Rivera")).when(k % 4 == 3, F.lit("Montevideo")).otherwise(F.lit("Pocitos"))
    return people(spark, sf_dir).select("id", per_row(profile.effective_residence, "string")(cv, city, F.lit("Uruguay")).alias("residence"))


@query(f"""
WITH {PEOPLE}, m AS (SELECT id, CASE id % 6 WHEN 0 THEN 12 * (2 + id % 5) WHEN 1 THEN 25 WHEN 2 THEN 24 WHEN 3 THEN NULL WHEN 4 THEN 12 * (1 + id % 50) ELSE (2001 * 12 + 9) - (1999 * 12 + 2) END AS months FROM people)
SELECT id, CAST(months AS INTEGER) AS months, coalesce(months >= 24, FALSE) AS enough, coalesce(months > 24, FALSE) AS more FROM m""")
def experience_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that texts show in an area: ranges of dates near its terms, overlaps once, other work not; or a statement; then the threshold."""
    k = F.col("id")
    year = lambda n: F.lit(n).cast("string")
    far = " y mucho mas que contar de otra cosa" * 8
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Cajera 1990 - "), (k % 5 + 1991).cast("string")))
        .when(k % 6 == 1, F.lit("Caja de enero de 1995 a ene. 1996, cajero 06/1995 hasta 01/1997"))
        .when(k % 6 == 2, F.lit(f"Cajera en tienda 1990 - 1991{far} soldador 1995 - 2000"))
        .when(k % 6 == 3, F.lit("Soldador 1990 - 2000, cinco años"))
        .when(k % 6 == 4, F.concat(F.lit("Trabajo como cajera con "), (k % 50 + 1).cast("string"), F.lit(" años")))
        .otherwise(F.concat(F.lit("Cajera marzo "), year(1999), F.lit(" — actualidad")))
    )
    months = relevant_months(text, ("cajero", "cajera", "caja"), F.lit(AS_OF).cast("timestamp_ntz"))
    found = people(spark, sf_dir).select("id", months.alias("months"))
    return found.select("id", "months", F.coalesce(F.col("months") >= 24, F.lit(False)).alias("enough"), F.coalesce(F.col("months") > 24, F.lit(False)).alias("more"))
