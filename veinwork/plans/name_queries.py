"""Names, labels and contacts over whole tables. Inputs are made from known names, so that SQL can say what has to come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import names
from veinwork.functions.perrow import per_row
from veinwork.functions.text import clean_emails, repair_mojibake
from veinwork.operators.relational import spread
from veinwork.plans.base import query
from veinwork.sources.tables import candidates, table, with_

FIRST = ("Ana", "Bruno", "Carla", "Diego", "Elena", "Fabio", "Gala")
LAST = ("Acosta", "Bentos", "Cabrera", "Duarte", "Ferrari")


def _pick(words: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name): a two-word name for each customer, dealt to all cores: a file of customers is small, and the work on each is not."""
    k = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("id"), F.concat_ws(" ", _pick(FIRST, k), _pick(LAST, F.floor(k / 7))).alias("name"))


def _sql_pick(words: tuple[str, ...], k: str) -> str:
    return f"([{', '.join(repr(w) for w in words)}])[CAST({k} % {len(words)} + 1 AS INTEGER)]"


PEOPLE = f"people AS (SELECT c_custkey AS id, {_sql_pick(FIRST, 'c_custkey')} || ' ' || {_sql_pick(LAST, '(c_custkey // 7)')} AS name FROM customer)"


def _dressed() -> Column:
    n, k = F.col("name"), F.col("id")
    return (
        F.when(k % 8 == 0, F.concat(F.lit("CV "), n, F.lit(" actualizado 2020.pdf")))
        .when(k % 8 == 1, F.concat(F.lit("Re: Fwd: Copia de "), F.replace(n, F.lit(" "), F.lit("_")), F.lit("_final_v2.docx")))
        .when(k % 8 == 2, F.concat(F.lit("Curriculum Vitae - "), n))
        .when(k % 8 == 3, F.concat(F.lit("Lic. "), n, F.lit(" Ventas")))
        .when(k % 8 == 4, F.concat(n, F.lit(" Teléfono: 099 123 456")))
        .when(k % 8 == 5, F.concat(n, F.lit(" (1).txt")))
        .when(k % 8 == 6, F.concat(F.lit("Auxiliar "), n, F.lit(" Gómez B")))
        .otherwise(F.concat(F.lit("  "), n, F.lit("  ")))
    )


@query(f"WITH {PEOPLE} SELECT id, CASE WHEN id % 8 = 6 THEN name || ' Gómez' ELSE name END AS cleaned, TRUE AS real FROM people")
def names_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of file names, subjects and forms."""
    cleaned = per_row(names.clean_name, "string")(_dressed())
    found = people(spark, sf_dir).select("id", cleaned.alias("cleaned"))
    return found.select("id", "cleaned", per_row(names.looks_real, "boolean")("cleaned").alias("real"))


@query(f"""
WITH {PEOPLE} SELECT id, CASE id % 6 WHEN 3 THEN split_part(name, ' ', 1) WHEN 4 THEN '' WHEN 5 THEN '' ELSE name END AS found FROM people""")
def names_found_in_files_headers_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir)
    low, k = F.lower("name"), F.col("id")
    dotted = F.concat(F.replace(low, F.lit(" "), F.lit(".")), F.lit("77@mail.example"))
    file = F.when(k % 6 == 0, F.concat(low, F.lit(" cv.pdf"))).when(k % 6 == 3, F.concat(F.split("name", " ")[0], F.lit(".pdf")))
    header = F.when(k % 6 == 1, F.concat(F.lit('"'), "name", F.lit('" <x1@mail.example>'))).when(k % 6 == 4, F.concat("name", F.lit(" <noreply@mail.example>")))
    address = F.when(k % 6 == 2, dotted).when(k % 6 == 5, F.concat(F.lit("talento."), dotted))
    found = F.coalesce(
        F.when(file.isNotNull(), per_row(names.name_from_file, "string")(file)),
        F.when(header.isNotNull(), per_row(names.name_from_header, "string")(header)),
        per_row(names.name_from_address, "string")(address),
    )
    return p.select("id", found.alias("found"))


@query(f"""
WITH {PEOPLE} SELECT id, CASE id % 5 WHEN 2 THEN NULL ELSE name END AS name, CASE id % 5 WHEN 0 THEN 'label' WHEN 1 THEN 'heading' WHEN 3 THEN 'heading' WHEN 4 THEN 'label' END AS kind,
       CASE id % 5 WHEN 0 THEN 100 WHEN 1 THEN 95 WHEN 3 THEN 90 WHEN 4 THEN 100 END AS confidence FROM people""")
def name_evidence_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines, headings near the top and further down, and texts that name nobody."""
    n, k = F.col("name"), F.col("id")
    filler = "\n".join(f"linea {j} de texto que termina." for j in range(7))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Curriculum Vitae\nOtra Persona\nNombre completo: "), n, F.lit("\nEmail: x@y.example")))
        .when(k % 5 == 1, F.concat(F.lit("CURRICULUM VITAE\nDatos personales:\n"), n, F.lit("\nDomicilio: Calle 1")))
        .when(k % 5 == 2, F.concat(F.lit("Experiencia laboral\nx@y.example\n"), n, F.lit(" trabajó en muchas empresas.")))
        .when(k % 5 == 3, F.concat(F.lit(filler + "\n"), n))
        .otherwise(F.concat(F.lit("Postulante - "), n, F.lit(" "), n))
    )
    evidence = per_row(names.name_evidence, "struct<name:string,kind:string,confidence:int>")(text)
    return people(spark, sf_dir).select("id", evidence.alias("e")).select("id", "e.*")


@query(f"""
WITH {PEOPLE} SELECT id, CASE id % 4 WHEN 0 THEN name || ' Gómez' WHEN 1 THEN name || ' Gómez' WHEN 2 THEN name ELSE 'Zoe ' || name END AS canonical,
       CASE id % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN 'Otra Persona' ELSE name END AS replaced FROM people""")
def names_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The more complete of two forms, never another person's; and whether a document's name replaces the stored one."""
    n, k = F.col("name"), F.col("id")
    longer = F.concat(n, F.lit(" Gómez"))
    stored = F.when(k % 4 == 1, longer).otherwise(n)
    incoming = F.when(k % 4 == 0, F.translate(longer, "ó", "ó")).when(k % 4 == 1, F.lower(n)).when(k % 4 == 2, F.lit("Otra Persona")).otherwise(F.concat(F.lit("Zoe "), n))
    text = F.concat(F.lit("Nombre: "), F.when(k % 4 == 2, F.lit("Otra Persona")).otherwise(n))
    emails = F.when(k % 4 == 2, F.array(F.lit("otra.persona@mail.example"))).otherwise(F.array(F.concat(F.replace(F.lower(n), F.lit(" "), F.lit(".")), F.lit("@mail.example"))))
    held = F.when(k % 4 == 3, F.lit("perfil 99")).otherwise(n)
    return people(spark, sf_dir).select("id", per_row(names.canonical_name, "string")(stored, incoming).alias("canonical"), per_row(names.replaced_name, "string")(held, text, emails).alias("replaced"))


@query(f"""
WITH {PEOPLE} SELECT id, CASE id % 3 WHEN 0 THEN lower(split_part(name, ' ', 2)) || '@b.example,' || lower(split_part(name, ' ', 1)) || '@c.example'
       WHEN 1 THEN 'zz@a.example' ELSE 'zz@a.example,' || lower(split_part(name, ' ', 2)) || '@b.example' END AS kept FROM people""")
def emails_for_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two addresses that fit a name or the sender best; the first if none does."""
    part = lambda j: F.lower(F.split("name", " ")[j])
    given = F.array(F.lit("zz@a.example"), F.concat(part(1), F.lit("@b.example")), F.concat(part(0), F.lit("@c.example")))
    k = F.col("id")
    name = F.when(k % 3 == 1, F.lit("Xx Yy")).otherwise(F.col("name"))
    sender = F.when(k % 3 == 2, F.lit("ZZ@a.example"))
    return people(spark, sf_dir).select("id", F.array_join(per_row(names.emails_by_name, "array<string>")(name, given, sender), ",").alias("kept"))


@query(f"""
WITH {PEOPLE} SELECT id, name AS cased, name AS shown, CASE id % 3 WHEN 0 THEN 'cv.pdf' WHEN 1 THEN 'my cv.docx' ELSE 'x.pdf' END AS file,
       CASE id % 4 WHEN 0 THEN name WHEN 1 THEN '' WHEN 2 THEN '' ELSE '' END AS label FROM people""")
def names_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casing, torn and glued names, file names, labels."""
    n, k = F.col("name"), F.col("id")
    file = F.when(k % 3 == 0, F.lit("cv_compressed.p d f")).when(k % 3 == 1, F.lit("my  cv .docx.docx")).otherwise(F.lit("x -.pdf.pdf.pdf"))
    label = F.when(k % 4 == 0, n).when(k % 4 == 1, F.lit("Gmail")).when(k % 4 == 2, F.concat(F.lit("Postulación laboral "), n)).otherwise(F.concat(F.lit("Para "), n))
    return people(spark, sf_dir).select(
        "id",
        per_row(names.name_case, "string")(F.lower("name")).alias("cased"),
        per_row(names.display_name, "string")(F.replace(n, F.lit(" "), F.lit(""))).alias("shown"),
        per_row(names.clean_file_name, "string")(file).alias("file"),
        per_row(names.compact_label, "string")(label).alias("label"),
    )


@query("""SELECT id, array_to_string(list_distinct_in_order, ',') AS tags FROM (
  SELECT c_custkey AS id, ['mail', lower(c_mktsegment), 'tag' || c_custkey % 3] AS list_distinct_in_order FROM customer)""")
def tags_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source first, then labels worth showing, each once."""
    c = table(spark, sf_dir, "customer")
    seg = F.lower("c_mktsegment")
    labels = F.array(seg, F.lit("Gmail"), seg, F.lit("futuras vacantes"), F.concat(F.lit("tag"), F.col("c_custkey") % 3), F.lit("mail"))
    return c.select(F.col("c_custkey").alias("id"), F.array_join(per_row(names.safe_tags, "array<string>")(F.lit("mail"), labels), ",").alias("tags"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Montevideo' WHEN 1 THEN NULL WHEN 2 THEN 'Villa Nueva' END AS place,
       CASE WHEN c_custkey % 2 = 0 THEN 'Summary ' || c_custkey ELSE 'A first sentence that is long enough. Another sentence that is long enough.' END AS summary,
       'n_ ' || c_custkey || '.pdf' AS ascii_name, '%C3%B1_%20' || c_custkey || '.pdf' AS encoded_name FROM customer""")
def places_summaries_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    place = F.when(k % 4 == 0, F.lit("Barrio X, montevideo 11200")).when(k % 4 == 1, F.lit("Calle Larga 1234")).when(k % 4 == 2, F.lit("Villa  Nueva"))
    summary = F.when(k % 2 == 0, F.concat(F.lit("Summary "), k))
    text = F.lit("Short. A first sentence that is long enough. Write to ana@mail.example for all of it. Another sentence that is long enough.")
    both = per_row(names.download_name, "struct<a:string,b:string>")(F.concat(F.lit("ñ? "), k, F.lit(".pdf")))
    d = table(spark, sf_dir, "customer").select(k.alias("id"), per_row(_place, "string")(place).alias("place"), per_row(names.readable_summary, "string")(summary, text).alias("summary"), both.alias("d"))
    return d.select("id", "place", "summary", F.col("d.a").alias("ascii_name"), F.col("d.b").alias("encoded_name"))


def _place(text):
    return names.display_place(text, ["Montevideo", "Maldonado"])


@query(with_("candidates", """
SELECT id, coalesce(array_to_string(list_transform(email, lambda x: lower(x)), ','), '') AS emails FROM candidates"""))
def emails_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in any case with blanks around them; what isn't one, or is too long, goes."""
    bad = F.array(F.lit("not an address"), F.lit("a@b"), F.concat(F.repeat(F.lit("a"), 250), F.lit("@mail.example")), F.lit("x@y.example z"))
    given = F.concat(F.transform("email", lambda e: F.concat(F.lit(" "), F.upper(e), F.lit(" "))), bad)
    return candidates(spark, sf_dir).select("id", F.array_join(clean_emails(given), ",").alias("emails"))


@query("""SELECT c_custkey AS id, '+59899' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ',29001234' AS phones FROM customer""")
def phones_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of texts, without those of references."""
    n = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    text = F.concat(F.lit("Tel: +598 99 "), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 3), F.lit(" o (2900) 1234, otra vez 29001234. 12 años.\nReferencias: 099 888 777"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(per_row(names.phones_in, "array<string>")(text), ",").alias("phones"))


@query(f"""
WITH {PEOPLE} SELECT id, name || '=' || 'p' || id || '@mail.example' || CASE WHEN id % 2 = 0 THEN ';Otra Persona=/profile/9' ELSE '' END AS found FROM people""")
def people_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People out of HTML: links, names beside an address, rows."""
    mail = F.concat(F.lit("p"), "id", F.lit("@mail.example"))
    row = F.concat(F.lit("<table><tr><td>"), "name", F.lit("</td><td>"), mail, F.lit("</td></tr></table>"))
    extra = F.when(F.col("id") % 2 == 0, F.lit('<p><a href="/profile/9"><b>Otra Persona</b></a></p>')).otherwise(F.lit("<a href='/jobs'>Datos de contacto</a>"))
    found = per_row(_people, "array<string>")(F.concat(F.lit("<script>var a='Ana Falsa';</script>"), row, extra))
    return people(spark, sf_dir).select("id", F.array_join(F.array_sort(found), ";").alias("found")).select("id", _as_sql("found").alias("found"))


def _as_sql(c: str) -> Column:
    """The person first, the other one after."""
    parts = F.split(c, ";")
    return F.array_join(F.concat(F.filter(parts, lambda x: ~x.startswith("Otra")), F.filter(parts, lambda x: x.startswith("Otra"))), ";")


def _people(markup):
    return [f"{n}={k or ''}" for n, k in names.people_in(markup)]


@query(with_("candidates", """
SELECT id, array_to_string(list_slice(list_distinct_ordered, 1, 2), ',') AS contacts FROM (
  SELECT id, list_concat(email, list_filter(phone, lambda p: p <> '')) AS list_distinct_ordered FROM candidates)"""))
def result_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts that a result shows: blanks squeezed, each once, at most two."""
    squeezed = F.transform(F.concat("email", "phone"), lambda x: F.trim(F.regexp_replace(F.concat(F.lit("  "), x), "\\s+", " ")))
    return candidates(spark, sf_dir).select("id", F.array_join(F.slice(F.array_distinct(squeezed), 1, 2), ",").alias("contacts"))


@query("""
SELECT c_custkey AS id, abs(list_reduce(list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT)),
       lambda h, c: (((h * 31 + c + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)) % 16 AS queue FROM customer""")
def identity_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue of an identity: a hash of 32 bits over its characters, the same for the same identity everywhere."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    codes = F.transform(F.split("c_name", ""), lambda c: F.ascii(c).cast("long"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))) % 16).alias("queue"))


@query("""SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x00-\\xff]*') AND NOT regexp_matches(text, '[ÃÂ]')""")
def mojibake_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were read in the wrong encoding, read again: they come back as they were."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull() & F.col("text").rlike("^[\\x00-\\xff]*$") & ~F.col("text").rlike("[ÃÂ]"))
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", repair_mojibake(broken).alias("text"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 < 4 THEN TRUE ELSE FALSE END AS internal FROM events""")
def internal_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offices, the own house and large providers are no candidates' addresses."""
    k = F.col("event_id")
    user = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    address = F.when(k % 5 == 0, F.lit("RRHH@firm.example")).when(k % 5 == 1, F.concat(F.lit("talento."), user, F.lit("@firm.example"))).when(k % 5 == 2, F.concat(user, F.lit("@own.example"))).when(k % 5 == 3, F.concat(user, F.lit("@mail.google.com"))).otherwise(F.concat(user, F.lit("@mail.example")))
    return table(spark, sf_dir, "events").select("event_id", per_row(_internal, "boolean")(address).alias("internal"))


def _internal(address):
    return names.internal_address(address, ["own.example"])
