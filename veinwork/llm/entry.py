"""The registered queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veinwork.llm.common import table
from veinwork.llm.decontamination import contamination_digest, decontaminate
from veinwork.llm.jaccard import similarity_components
from veinwork.llm import chat, lines, quality
from veinwork.llm.language import predict_held_out
from veinwork.llm.mixing import mix_digest
from veinwork.llm.pii import personal_data
from veinwork.llm.sequencer import change_digest
from veinwork.llm.sharding import shard_digest
from veinwork.llm.spelling import spelling_forms
from veinwork.llm.substrings import substring_digest
from veinwork.llm.tokens import token_counts


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(table(spark, sf_dir, "conversations"))


def tool_call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of ``op1`` on a table that holds tool calls which wait for later ones, and arguments that schemas refuse."""
    return chat.tool_call_chains(table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_held_out(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op13_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_digest(table(spark, sf_dir, "client_changes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_language_id, op3_quality_rules, op4_line_dedup, op5_decontamination, op6_token_counts, op7_source_mix, op8_personal_data, op9_jaccard_join, op10_suffix_dedup, op11_spelling_variants, op12_sharding, op13_sequenced_changes, tool_call_chains)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE, "tool_call_chains": chat.CHAINS_ORACLE, "op3_quality_rules": quality.oracle(), "op4_line_dedup": lines.ORACLE}
