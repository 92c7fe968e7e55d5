"""Quality rules: a table of thresholds compiled into Spark projections.

Measures are columns made of SQL functions alone; a rule names a measure and
the range it has to be in; ``compile_rules`` turns the table into one boolean.
Work is linear in the text, but for texts that repeat eight words, whose
windows are sorted within the row.

Cases: a null text has no words, so the base fails and the row is not kept;
ratios of a text without words or lines are 0; rules other than the base look
at texts of ``WORDS_LEAST`` words or more, which are all that reach them;
repeated rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import NOT_SPACE, SPACE, quoted, sheltered, without

WINDOW = 8
WORDS_LEAST = 20
REPEATS_MOST_PERCENT = 30
SYMBOLS = "[#*$%&|<>]+"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the be to of and that have with in it is for on are as was this at by from or an a "
    "der die das und ist nicht ein eine zu den mit von sich auf für dem im des auch als "
    "le la les de du un une et en que qui est pour dans par sur au il elle pas avec "
    "el los las y se por con para del no lo su al una".split()
)


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("word length", "mean_word_chars", least=2.0, most=10.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("exclamations", "exclamation_ratio", most=0.3),
    Rule("stop words", "stop_word_ratio", least=0.05),
    Rule("repeated lines", "dup_line_ratio", most=0.4),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RATIOS = ("mean_word_chars", "symbol_ratio", "exclamation_ratio", "stop_word_ratio", "dup_line_ratio")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """True where every measure is in its rule's range."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (F.col(r.measure) >= r.least)
        if r.most is not None:
            ok = ok & (F.col(r.measure) <= r.most)
    return ok


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns and the ratios that rules can name."""
    kept = without(docs, [*BASE, *RATIOS, "kept", "failed_rules"])
    own = [quoted(c) for c in kept.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    stop = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})
    step = kept.select(
        *own,
        F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("_l"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("_x"),
    )
    step = step.select(
        *own,
        "n_symbols",
        "_x",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size(F.filter("_w", lambda w: w.isin(stop))).alias("_stop"),
        F.size("_l").alias("_n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    last = F.size("_h") - WINDOW
    window = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]))
    done = [*own, "n_symbols", "_x", "n_words", "word_chars", "_stop", "_n_lines", "n_dup_lines"]
    step = step.select(*done, F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")).alias("_v"))
    # Only a text with a repeated window sorts its windows; equal ones are then neighbours.
    repeats = F.size(F.array_distinct("_v")) < F.size("_v")
    step = step.select(*done, F.when(repeats, F.sort_array(F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).alias("_s"))
    same = lambda x, j: F.coalesce(F.get(F.col("_s"), j)["v"] == x["v"], F.lit(False))
    marked = F.transform("_s", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
    step = step.select(*done, F.sort_array(F.filter(marked, lambda i: i.isNotNull())).alias("_p"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_p", zero, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])
    step = step.select(*done, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    n = F.col("n_words")
    found = F.struct(
        n.alias("n_words"),
        F.col("word_chars"),
        F.col("n_symbols"),
        F.col("n_dup_lines"),
        F.col("n_repeat_words"),
        ((n < WORDS_LEAST) | (100 * F.col("n_repeat_words") > REPEATS_MOST_PERCENT * n)).alias("base_failed"),
        _ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("_x"), n).alias("exclamation_ratio"),
        _ratio(F.col("_stop"), n).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
    )
    # A generator of one row: filters on measures stay above it. Pushed down, they would unfold every step into one expression.
    return step.select(*own, F.inline(F.array(found)))


@sheltered("doc_id", "text")
def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all measures, ``failed_rules`` (names) and ``kept``."""
    found = measures(docs)
    names = F.filter(F.array(*[F.when(~compile_rules((r,)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return found.withColumns({"failed_rules": names, "kept": ~F.col("base_failed") & compile_rules(rules)})


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``op3``."""
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))
    rule = " AND ".join(
        c
        for c in (
            "word_chars >= 2.0 * n_words AND word_chars <= 10.0 * n_words",
            "n_symbols <= 0.1 * n_words",
            "n_bang <= 0.3 * n_words",
            "n_stop >= 0.05 * n_words",
            "n_dup_lines <= 0.4 * n_lines",
        )
    )
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), v AS (
  SELECT doc_id, len(w) AS n, w, i, list_slice(w, i, i + 7) AS g FROM t, unnest(range(1, greatest(len(w) - 6, 1))) AS r(i)
), c AS (
  SELECT doc_id, i, n, count(*) OVER (PARTITION BY doc_id, g) AS k FROM v
), m AS (
  SELECT doc_id, n, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS gap FROM c WHERE k > 1
), rep AS (
  SELECT doc_id, sum(least(gap, 8)) AS n_repeat_words FROM m GROUP BY doc_id
), a AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(x) - length(replace(x, '!', '')) AS n_bang,
         len(list_filter(w, lambda s: s IN ({stop}))) AS n_stop, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {rule} AS kept
FROM a
"""


