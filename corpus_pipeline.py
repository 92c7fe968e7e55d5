"""A corpus pipeline: each stage is one operator over all that the stage before kept.

``run`` chains the stages; a runner may as well write each stage's result and
read it back as the next one's ``docs``. All stages but the last return the
columns of documents; the last one returns the mix, one row for each document.

Cases, for all stages: an empty table stays empty; further columns pass through
whatever their names. A null text has no letter, so the first stage drops it,
and each later stage, given one, keeps it (the last takes none of it). Rows
equal in doc_id and text get one verdict; in the third stage one of them stays.
A null doc_id is a row like any other, and is kept only where its group has no
other id. Ties go to the smallest doc_id, then to the smallest hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.llm.common import checkpointed, table
from veinwork.llm.decontamination import decontaminate
from veinwork.llm.jaccard import keep_one_of_each
from veinwork.llm.language import keep_identified
from veinwork.llm.lines import drop_repeated_lines
from veinwork.llm.mixing import mix_digest


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; undetermined ones go."""
    return keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three repeated lines; documents of which no word is left go."""
    out = drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    return keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test string of the benchmark."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0")
    return found.select(*[found[c] for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents such that sources have their target shares."""
    return mix_digest(docs)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("decontamination", drop_contaminated),
    ("source_mix", mix),
]

#: Language models, near-copy components and the rounding of a solved dual are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage kept is materialised before the next one reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
