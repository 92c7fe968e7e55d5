"""A directory of candidates: filters, tiers of literal relevance, sorts and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions.text import short_fold

LIMITS = (10, 100, 50)


@dataclass(frozen=True)
class DirectoryQuery:
    search: str | None = None
    country: str | None = None
    contact: str | None = None
    sort: str = "quality"
    limit: int = LIMITS[2]
    offset: int = 0


def filtered(candidates: DataFrame, q: DirectoryQuery) -> DataFrame:
    """Live rows that satisfy the query; all conditions are one predicate over the scan."""
    out = candidates.filter("duplicate_of is null")
    if q.country:
        out = out.filter(F.col("country").ilike(q.country))
    if q.contact:
        mail, tel = F.size("email") > 0, F.size("phone") > 0
        out = out.filter({"email": mail, "phone": tel, "both": mail & tel}[q.contact])
    if q.search:
        s, low = q.search, f"%{q.search}%"
        anywhere = [F.col(c).ilike(low) for c in ("full_name", "current_role", "city", "country", "summary")]
        lists = [F.exists(c, lambda x: x.ilike(low)) for c in ("tags", "email", "phone")]
        hit = F.contains(short_fold(F.col("full_name")), short_fold(F.lit(s)))
        for c in (*anywhere, *lists):
            hit = hit | F.coalesce(c, F.lit(False))
        out = out.filter(hit)
    return out


#: Senders, subjects and texts of systems that mail took for people, and words that no name holds.
SYSTEM_NAMES = ("the google cloud team", "google cloud team", "google workspace team", "google team", "microsoft account team", "linkedin notifications")
SUBJECT = "^(re|fw|fwd):|\\b(postulame|postularme|postulacion|futuras vacantes|solicitud de empleo|solicitud de trabajo)\\b"
SYSTEM_SUMMARY = "work account access|google cloud|google workspace|security alert|billing|%pdf-1\\.|google docs renderer|comparto.*contigo|shared.*with you"
SYSTEM_TEXT = "request for work account access|google cloud|%pdf-1\\.|google docs renderer|comparto.*contigo|shared.*with you"
NO_NAME = "preparacion|entrega de|ordenes|experiencia en|responsable de|tareas de|funciones|perfil profesional|objetivo laboral|curriculum|postulacion|futuras vacantes"


def without_false_positives(candidates: DataFrame, sources: DataFrame, documents: DataFrame, mail: str = "mail") -> DataFrame:
    """Candidates without those that mail brought by mistake: system senders, subjects for names, contactless system texts, system documents; and without names that are none.

    ``sources`` has candidate_id and source_type, ``documents`` also raw_text and
    file_name. Their flags are reduced to distinct ids before they join.
    """
    low = lambda c: short_fold(F.trim(F.coalesce(F.col(c), F.lit(""))))
    by_mail = sources.filter(F.col("source_type") == mail).select(F.col("candidate_id").alias("id")).distinct().withColumn("_mail", F.lit(True))
    told = F.lower(F.coalesce("raw_text", F.lit(""))).rlike("(?s)" + SYSTEM_TEXT) | F.contains(F.lower(F.coalesce("file_name", F.lit(""))), F.lit("request for work account access"))
    system = documents.filter((F.col("source_type") == mail) & told).select(F.col("candidate_id").alias("id")).distinct().withColumn("_system", F.lit(True))
    met = candidates.join(by_mail, "id", "left").join(system, "id", "left")
    mailed = F.col("_mail").isNotNull() | F.array_contains("tags", mail)
    silent = (F.size("email") == 0) & (F.size("phone") == 0) & low("summary").rlike("(?s)" + SYSTEM_SUMMARY)
    false = low("full_name").isin(*SYSTEM_NAMES) | F.contains(low("current_role"), F.lit("work account access")) | low("full_name").rlike(SUBJECT) | silent | F.col("_system").isNotNull()
    return met.filter(~(F.coalesce(mailed, F.lit(False)) & false) & ~low("full_name").rlike(NO_NAME)).drop("_mail", "_system")


def relevance(search: str) -> Column:
    """Lower is better: name, contacts, role, place, tags, parts of them, summary, anything else."""
    q = short_fold(F.trim(F.lit(search)))
    name, role, city = (short_fold(F.coalesce(F.col(c), F.lit(""))) for c in ("full_name", "current_role", "city"))
    starts = lambda c: c.startswith(F.concat(q, F.lit(" ")))
    word = lambda c: c.endswith(F.concat(F.lit(" "), q)) | F.contains(c, F.concat(F.lit(" "), q, F.lit(" ")))
    digits = F.regexp_replace(F.lit(search), "[^0-9]", "")
    tiers = [
        (0, name == q),
        (1, starts(name)),
        (2, word(name)),
        (3, F.contains(name, q)),
        (4, F.exists("email", lambda e: F.lower(e) == q) | ((digits != "") & F.exists("phone", lambda p: F.regexp_replace(p, "[^0-9]", "") == digits))),
        (5, F.exists("email", lambda e: F.contains(F.lower(e), q)) | F.exists("phone", lambda p: F.contains(F.lower(p), F.lit(search.lower())))),
        (6, role == q),
        (7, starts(role) | word(role)),
        (8, city == q),
        (9, F.exists("tags", lambda t: short_fold(t) == q)),
        (10, F.contains(role, q) | F.contains(city, q)),
        (20, F.coalesce(F.col("summary").ilike(f"%{search}%"), F.lit(False))),
    ]
    out = F.when(tiers[0][1], tiers[0][0])
    for n, c in tiers[1:]:
        out = out.when(c, n)
    return out.otherwise(30)


SORTS = {
    "quality": [F.desc, "quality_score"],
    "updated": [F.desc_nulls_last, "updated_at"],
    "recent": [F.desc_nulls_last, "latest_at"],
    "oldest": [F.asc_nulls_last, "latest_at"],
    "name": [F.asc, "full_name"],
    "name_desc": [F.desc, "full_name"],
}


def page(candidates: DataFrame, q: DirectoryQuery) -> DataFrame:
    """One page in a total order: relevance first where there is a search, then the sort, then the id.

    "recent" and "oldest" go by ``latest_at``, the newest source's date, if the rows have it.
    """
    order, column = SORTS[q.sort]
    column = "updated_at" if column not in candidates.columns else column
    rows = filtered(candidates, q).withColumn("tier", relevance(q.search) if q.search else F.lit(0))
    limit = min(LIMITS[1], max(LIMITS[0], q.limit))
    return rows.orderBy("tier", order(column), "id").offset(max(0, q.offset)).limit(limit)


def counts(candidates: DataFrame, q: DirectoryQuery) -> DataFrame:
    """(total, database_total): rows that satisfy the query, and all live ones."""
    live = filtered(candidates, DirectoryQuery())
    return filtered(candidates, q).agg(F.count("*").alias("total")).crossJoin(live.agg(F.count("*").alias("database_total")))
