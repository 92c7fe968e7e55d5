"""Line dedup over overlapping windows of three lines.

A text is split at line feeds; each run of three lines is a window, known by
128 bits of its lines. A window that occurs before (in the order of doc_id,
text hash, line) is a later occurrence, and all its lines go: covered positions
of overlapping windows are merged. First occurrences stay whole.

Counting is pre-aggregated: each task sends one row for a window it has seen,
however often. The join back to the windows is by key with a side of distinct
repeated windows, so a window that a third of all rows share is split by the
adaptive skew join.

Cases: a null text, or one of fewer than three lines, has no window and stays;
windows of three blank lines count like any other; a null doc_id sorts first;
rows equal in doc_id and text share one verdict and are one occurrence, not
two; a text of which no line is left is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import NOT_SPACE, checkpointed, quoted, row_key, sheltered, without

LINES = 3
#: Lists of removed lines are broadcast to the texts up to so many bytes; beyond it the two meet by a shuffle.
BROADCAST_BYTES = 32 << 20
RESULT = ("removed_lines", "n_lines", "n_removed_lines")


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(k, pos, a, b): each window of each row with its two hashes."""
    parts = docs.filter("text is not null").select(row_key().alias("k"), F.split("text", "\n").alias("l")).filter(F.size("l") >= lines)
    hashed = parts.select("k", F.transform("l", lambda x: F.xxhash64(x)).alias("x"), F.transform("l", lambda x: F.xxhash64(x, F.lit(1))).alias("y"))
    at = lambda c, i: [F.get(F.col(c), i + j) for j in range(lines)]
    made = F.transform(F.sequence(F.lit(0), F.size("x") - lines), lambda i: F.struct(i.alias("pos"), F.xxhash64(*at("x", i)).alias("a"), F.xxhash64(*at("y", i)).alias("b")))
    return hashed.select("k", F.inline(made))


def repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(k, removed_lines): the rows that lose lines, with the positions (from 0, sorted)."""
    all_windows = windows(docs.select("doc_id", "text"), lines)
    first = all_windows.groupBy("a", "b").agg(F.min(F.struct("k", "pos")).alias("f"), F.max(F.struct("k", "pos")).alias("g")).filter("f <> g").select("a", "b", "f")
    later = all_windows.join(first, ["a", "b"]).filter(F.struct("k", "pos") != F.col("f")).select("k", "pos")
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + lines - 1)))))
    return later.groupBy("k").agg(positions.alias("removed_lines"))


@sheltered("doc_id", "text")
def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with repeated lines gone from the text, and ``removed_lines``, ``n_lines``, ``n_removed_lines``."""
    docs = without(docs, RESULT)
    own = [quoted(c) for c in docs.columns if c.lower() != "text"]
    found = checkpointed(repeated_lines(docs, lines).select(F.col("k.id").alias("_i"), F.col("k.th").alias("_t"), "removed_lines"))
    size = found.agg(F.sum(32 + 4 * F.size("removed_lines"))).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    met = docs.withColumn("_k", row_key()).join(found, F.col("_k.id").eqNullSafe(F.col("_i")) & (F.col("_k.th") == F.col("_t")), "left")
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    step = met.select(*own, "text", gone.alias("removed_lines"), F.split("text", "\n").alias("_p"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_p") - 1), F.col("removed_lines"))
    text = F.when(F.size("removed_lines") > 0, F.array_join(F.transform(left, lambda i: F.get(F.col("_p"), i)), "\n")).otherwise(F.col("text"))
    out = step.select(*own, text.alias("text"), "removed_lines", F.coalesce(F.size("_p"), F.lit(0)).cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed_lines"))
    return out.select(*[quoted(c) for c in docs.columns], *RESULT)


def line_digest(docs: DataFrame) -> DataFrame:
    """The columns of ``op4``: doc_id, line counts, the hash of what is left."""
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed_lines", F.array_join("removed_lines", ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; rows that lose all their words this way go, all others stay."""
    found = dedup_lines(docs)
    return found.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(NOT_SPACE)).drop(*RESULT)


ORACLE = """
WITH t AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, i AS pos, list_slice(l, i + 1, i + 3) AS g FROM t, unnest(range(0, greatest(len(l) - 2, 0))) AS r(i)
), o AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS k FROM w
), c AS (
  SELECT DISTINCT doc_id, pos + j AS p FROM o, unnest(range(0, 3)) AS r(j) WHERE k > 1
), g AS (
  SELECT doc_id, list(p ORDER BY p) AS ps FROM c GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed_lines,
       coalesce(array_to_string(ps, ','), '') AS removed_lines,
       sha256(CASE WHEN ps IS NULL THEN coalesce(text, '')
                   ELSE array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(ps, i)), lambda i: l[i + 1]), chr(10)) END) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""
