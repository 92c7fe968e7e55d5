"""Search, end to end and in its parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions.text import fold
from veinwork.operators.ranking import explanation, one_per_person, rank, score
from veinwork.operators.retrieval import hydrate, indexed_matches, merged_matches, profile_matches
from veinwork.operators.textindex import TextIndex
from veinwork.plans.base import query
from veinwork.plans.interpret import Plan, interpret, retrieval_terms
from veinwork.sources.tables import AS_OF, candidates, document_facts, sources, table, texts, with_
from veinwork.streaming.sinks import checkpoint_folder, shared_folder

#: A plan over words that the test tables hold.
PLAN = Plan(text="building que the", roles=("building",), skills=("que", "the"), groups=(("building",), ("que", "los"), ("the", "and")), variants={"que": ("que", "los"), "the": ("the", "and")})
WORDS = "' ' || trim(regexp_replace(regexp_replace(lower(strip_accents(raw_text)), '[^\\pL\\pN]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"


def index_of(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of the texts in a folder: written by the first search of a session, brought up to date when files differ."""
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    index = TextIndex(spark, f"{checkpoint_folder(spark)}/text-index-{name}")
    index.follow(texts(spark, sf_dir).select("id", F.col("raw_text").alias("text")))
    return index


def _hit(x: str, group: tuple[str, ...]) -> str:
    return "CAST((" + " OR ".join(f"contains({x}, ' {t} ')" for t in group) + ") AS INTEGER)"


HITS = " + ".join(_hit("x", g) for g in PLAN.groups)


@query(with_("contents", f"SELECT id FROM (SELECT id, {WORDS} AS x FROM contents WHERE raw_text IS NOT NULL) WHERE " + " AND ".join(f"{_hit('x', g)} = 1" for g in PLAN.groups[1:])))
def boolean_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a term of every group."""
    return index_of(spark, sf_dir).hits(PLAN.groups[1:]).filter("hits = 2").select("id")


MATCHES = f"""
, d AS (SELECT id, candidate_id, is_primary, {WORDS} AS x FROM contents WHERE raw_text IS NOT NULL),
h AS (SELECT id, candidate_id, is_primary, {HITS} AS hits FROM d),
dm AS (SELECT candidate_id, id AS document_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY hits DESC, is_primary DESC, id) AS n FROM h WHERE hits > 0) WHERE n = 1 ORDER BY hits DESC, candidate_id LIMIT 300)"""


@query(with_("contents", MATCHES + " SELECT candidate_id, document_id, hits FROM dm"))
def expanded_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's best document over all forms of the terms; the top 300."""
    return indexed_matches(index_of(spark, sf_dir), document_facts(spark, sf_dir), PLAN.groups)


SCORED = """
, p AS (SELECT candidate_id, max(hits) AS hits FROM dm GROUP BY 1),
w AS (SELECT c.*, p.hits, (SELECT count(*) FROM contents k WHERE k.candidate_id = c.id) AS documents,
             (SELECT max(source_created_at) FROM sources s WHERE s.candidate_id = c.id AND s.is_active) AS latest,
             t.file_name AS document_name, t.raw_text AS document_text
      FROM candidates c JOIN dm ON dm.candidate_id = c.id JOIN p ON p.candidate_id = c.id JOIN contents t ON t.id = dm.document_id WHERE c.duplicate_of IS NULL AND c.status = 'active'),
f AS (SELECT *, lower(strip_accents(full_name || ' ' || current_role_ || ' ' || city || ' ' || summary || ' ' || array_to_string(tags, ' ') || ' ' || document_name || ' ' || document_text)) AS hay,
             lower(strip_accents(document_text)) AS doc, lower(current_role_) AS role_, lower(current_role_ || ' ' || array_to_string(tags, ' ') || ' ' || city) AS profile FROM w),
m AS (SELECT *, CAST(contains(hay, 'building') AS INTEGER) + CAST(contains(hay, 'que') OR contains(hay, 'los') AS INTEGER) + CAST(contains(hay, 'the') OR contains(hay, 'and') AS INTEGER) AS cov,
             CAST(contains(doc, 'building') AS INTEGER) + CAST(contains(doc, 'que') OR contains(doc, 'los') AS INTEGER) + CAST(contains(doc, 'the') OR contains(doc, 'and') AS INTEGER) AS dr,
             CAST(contains(profile, 'que') OR contains(profile, 'los') AS INTEGER) + CAST(contains(profile, 'the') OR contains(profile, 'and') AS INTEGER) + CAST(contains(role_, 'building') AS INTEGER) AS pr,
             contains(role_, 'building') OR contains(role_, 'que') OR contains(role_, 'los') OR contains(role_, 'the') OR contains(role_, 'and') AS aligned,
             contains(hay, 'building') AS eligible, greatest(0, epoch_us(TIMESTAMP '""" + AS_OF + """') - epoch_us(latest)) / 86400e6 AS age FROM f),
s AS (SELECT *, CAST(least(100, greatest(0, round(55 * (cov / 3.0) + 25 * (dr / 3.0) + 10 * (pr / 3.0) + CASE WHEN documents > 0 THEN 5 ELSE 0 END + CASE WHEN len(email) > 0 OR len(phone) > 0 THEN 5 ELSE 0 END
             + CASE WHEN latest IS NULL THEN 0 WHEN age <= 7 THEN 10 WHEN age <= 30 THEN 7 WHEN age <= 90 THEN 4 WHEN age <= 365 THEN 2 ELSE 0 END))) AS INTEGER) AS raw FROM m),
z AS (SELECT *, CASE WHEN aligned THEN raw ELSE least(69, raw) END AS score FROM s)"""


def _hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = candidates(spark, sf_dir).filter("duplicate_of IS NULL AND status = 'active'")
    docs = document_facts(spark, sf_dir)
    return hydrate(indexed_matches(index_of(spark, sf_dir), docs, PLAN.groups), live, texts(spark, sf_dir), docs, sources(spark, sf_dir))


@query(with_("candidates contents sources", MATCHES + SCORED + " SELECT id, score, aligned AS role_aligned, eligible FROM z"))
def talent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every retrieved candidate with what it rests on."""
    scored = score(_hydrated(spark, sf_dir), PLAN, F.lit(AS_OF).cast("timestamp_ntz"))
    return scored.select("id", "score", "role_aligned", "eligible")


@query(with_("candidates contents sources", MATCHES + SCORED + """
, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, cov DESC, aligned DESC, quality_score DESC, id) AS position FROM z WHERE eligible)
SELECT position, id, full_name, score, 'covers ' || CAST(CAST(round(100 * (cov / 3.0)) AS INTEGER) AS VARCHAR) || '% of the request' || CASE WHEN dr > 0 THEN '; shown by a document' ELSE '' END || CASE WHEN aligned THEN '; current role fits' ELSE '' END AS reason FROM r WHERE position <= 50"""))
def search_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval by text, hydration of the matched few, ranking, one row for each person, the first page."""
    # The test tables name people "Customer#000000001", and the SQL keeps them.
    ranked = rank(_hydrated(spark, sf_dir), PLAN, F.lit(AS_OF).cast("timestamp_ntz"), any_name=True)
    return ranked.filter("position <= 50").select("position", "id", "full_name", "score", explanation().alias("reason"))


@query("""
WITH r AS (SELECT doc_id AS position, lang AS n, source AS contact, sha256(text) AS h FROM documents WHERE text IS NOT NULL)
SELECT position FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.position < a.position AND b.n = a.n AND b.contact || '@x' = a.contact || '@x' AND b.h = a.h)""")
def result_person_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows without repeats of an earlier one, removed ones included."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    rows = d.select(F.col("doc_id").alias("position"), F.col("lang").alias("full_name"), F.array(F.concat("source", F.lit("@x"))).alias("email"), F.array().cast("array<string>").alias("phone"), F.sha2("text", 256).alias("document_name"), F.lit("").alias("summary"))
    return one_per_person(rows).select("position")


@query(with_("candidates contents", MATCHES + """
, pm AS (SELECT id AS candidate_id, NULL::BIGINT AS document_id, hits FROM (SELECT *, """ + HITS + """ AS hits FROM (SELECT *, ' ' || regexp_replace(lower(full_name || ' ' || current_role_ || ' ' || city || ' ' || country || ' ' || summary || ' ' || array_to_string(tags, ' ')), '[^a-z0-9]+', ' ', 'g') || ' ' AS x FROM candidates)) WHERE hits > 0 ORDER BY hits DESC, quality_score DESC, updated_at DESC, id LIMIT 300),
u AS (SELECT * FROM dm UNION ALL SELECT * FROM pm)
SELECT candidate_id, max(hits) AS hits, arg_max(document_id, hits) FILTER (WHERE document_id IS NOT NULL) AS document_id FROM u GROUP BY candidate_id ORDER BY hits DESC, candidate_id LIMIT 300"""))
def merged_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile and document passes as one list: the best rank and the matched document of each candidate."""
    return merged_matches([indexed_matches(index_of(spark, sf_dir), document_facts(spark, sf_dir), PLAN.groups), profile_matches(candidates(spark, sf_dir), PLAN.groups)])


@query(with_("candidates contents", MATCHES + """
SELECT c.id, CAST(least(100, greatest(0, round(hits / 3.0 * 60 + quality_score * 0.4))) AS INTEGER) AS score FROM dm JOIN candidates c ON c.id = dm.candidate_id"""))
def prerank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score that retrieval alone gives: the share of the request's groups that a document shows, and quality."""
    found = indexed_matches(index_of(spark, sf_dir), document_facts(spark, sf_dir), PLAN.groups).select(F.col("candidate_id").alias("id"), "hits")
    points = F.round(F.col("hits") / len(PLAN.groups) * 60 + F.col("quality_score") * 0.4)
    return candidates(spark, sf_dir).join(F.broadcast(found), "id").select("id", F.least(F.lit(100), F.greatest(F.lit(0), points.cast("int"))).alias("score"))


@query("""
SELECT doc_id, regexp_matches(x, '\\bthe\\b.{0,100}\\band\\b|\\band\\b.{0,100}\\bthe\\b') AS together FROM (SELECT doc_id, regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL)""")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vocabularies within 100 characters of each other, in either order."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", fold(F.col("text")).alias("x"))
    word = lambda w: f"(?<![a-z0-9_]){w}(?![a-z0-9_])"
    return d.select("doc_id", F.col("x").rlike(f"{word('the')}.{{0,100}}{word('and')}|{word('and')}.{{0,100}}{word('the')}").alias("together"))


#: A request in words; the test tables' texts are made of invented words like these.
REQUEST = "Busco ciones con mente, mejor si es cionado o de building"
_ASKED = retrieval_terms(interpret(REQUEST))


@query(with_("contents", f"""
, d AS (SELECT id, candidate_id, is_primary, {WORDS} AS x FROM contents WHERE raw_text IS NOT NULL),
h AS (SELECT id, candidate_id, is_primary, {" + ".join(_hit("x", (t,)) for t in _ASKED)} AS hits FROM d)
SELECT candidate_id, id AS document_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY hits DESC, is_primary DESC, id) AS n FROM h WHERE hits > 0) WHERE n = 1 ORDER BY hits DESC, candidate_id LIMIT 300"""))
def search_from_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request in words: interpreted, its terms looked up in the stored index, the best document of each candidate."""
    terms = retrieval_terms(interpret(REQUEST))
    return indexed_matches(index_of(spark, sf_dir), document_facts(spark, sf_dir), tuple((t,) for t in terms))


_CHANGED = "CASE WHEN doc_id % 3 = 0 THEN text || ' house añadido' ELSE text END"


@query(f"""
WITH t AS (SELECT doc_id, {_CHANGED} AS raw_text FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL), x AS (SELECT doc_id AS id, {WORDS} AS x FROM t)
SELECT id, {_hit("x", ("anadido",))} + {_hit("x", ("de la", "of the"))} + {_hit("x", ("house", "the"))} AS hits FROM x WHERE hits > 0""")
def search_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all texts, brought up to date (a third of the texts differ, a seventh is gone) and searched in the same run: words and phrases."""
    before = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = TextIndex(spark, shared_folder(spark, "index"))
    index.refresh(before)
    index.refresh(before.filter("id % 7 <> 0").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" house añadido"))).otherwise(F.col("text"))))
    return index.hits((("anadido",), ("de la", "of the"), ("house", "the")))


@query(f"""
WITH w AS (SELECT doc_id, unnest(string_split(trim({WORDS.replace('raw_text', 'text')}), ' ')) AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w IN ('the', 'que', 'house') GROUP BY ALL)
SELECT doc_id AS id, round(sum(n / (n + 1)), 9) AS score FROM f GROUP BY doc_id ORDER BY score DESC, id LIMIT 50""")
def ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 texts that weigh most for three words; blocks of the index whose bound is too low aren't read."""
    return index_of(spark, sf_dir).top(["the", "que", "house"], 50)
