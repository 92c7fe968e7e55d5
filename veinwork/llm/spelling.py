"""Spelling variants of a corpus's words, by a positional q-gram inverted index with a count filter.

Words are counted over all texts. Two words are near if one inserted, deleted
or replaced code point turns one into the other. With a pad at both ends a word
of L code points has L + 1 grams of two; one edit destroys at most two of the
longer word's, so near words of lengths up to M share M - 1 of them, at
positions that differ by nothing (a replaced code point, or before the edit) or
by one. Two of the shared grams are then among the four rarest of the longer and the three rarest of the
shorter word (of both four, where lengths are equal), so words are dealt by pairs of their rarest grams with their positions and M. In each group a task
builds the inverted index of the group's words; for each word it heap-merges the shorter
postings of its grams under the limits of length and position, looks up what comes up twice in the longer ones, keeps words that
come up M - 1 times in all, and verifies them code point by code point.

A group of many words is split into blocks, and each pair of blocks is a task
of its own, so a task holds two blocks at most. Gram counts, which order grams, are
at most 92 x 92 numbers: 26 and 64 letters, and two pads.

A word's form is its near word of most occurrences, if it has at least twice as many;
forms are followed to the root by pointer jumping (occurrences at least double at
each step, so chains are short).

Cases: null or empty texts have no words; an empty table gives an empty result. A
null doc_id counts as an empty one in the checksum. Repeated rows count as often as they come.
Very long runs of letters are words like others. Ties of occurrences go to the smallest word.
Further columns play no part.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import arrow_batches, checkpointed
from veinwork.llm.shingles import _LOWER

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A run loses a code point where this divides the checksum of its document and text.
DAMAGE = 97
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words in one block of a group.
BLOCK = 4_000
START, END = "\x02", "\x03"


# Counting


def damaged(word: str, start: int) -> str:
    """The word as the corpus has it: ``start`` is the checksum of what precedes it."""
    h = zlib.crc32(word.encode(), start)
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def text_words(doc_id: int | None, text: str | None) -> Counter:
    """Words of one text with their counts, damage done."""
    if not text:
        return Counter()
    runs = Counter(RUN.findall(text.encode().translate(_LOWER).decode()))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in runs.items():
        out[damaged(word, start)] += n
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, int] = defaultdict(int)

    def handed() -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if len(w) >= LEAST_LENGTH]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in text_words(doc_id, text.as_py()).items():
                total[word] += n
            if len(total) > HELD_WORDS:
                yield handed()
    yield handed()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts: at least 5 code points and 3 occurrences."""
    arrow_batches(docs.sparkSession)
    found = docs.select("doc_id", "text").mapInArrow(_counts, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# Near words


def grams(word: str) -> list[str]:
    padded = START + word + END
    return [padded[k : k + 2] for k in range(len(padded) - 1)]


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def keys(word: str, order: dict[str, int]) -> set[tuple[int, int]]:
    """(pair of grams with their positions as one number, longest length) of the groups where a word has to meet its near words.

    Pairs that share a number by chance meet in vain, no more.
    """
    size = len(word)
    rarest = heapq.nsmallest(4, ((order[g], p) for p, g in enumerate(grams(word))))
    out = set()
    for k, one in enumerate(rarest):
        for other in rarest[k + 1 :]:
            (g, p), (h, q) = sorted((one, other), key=lambda x: x[1])
            shifts = ((0, 0), (0, 1), (1, 1)) if other in rarest[:3] else ()
            out |= {(_number(g, p, h, q), size), *((_number(g, p + a, h, q + b), size + 1) for a, b in shifts)}
    return out


def _number(g: int, p: int, h: int, q: int) -> int:
    return g << 48 | h << 34 | (p & 0x1FFFF) << 17 | q & 0x1FFFF


def _dealt(order: dict[str, int]) -> Callable:
    """Rows (key, longest, word, n): a word in each of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, longest, word, n) for word, n in zip(*(c.to_pylist() for c in batch.columns)) for key, longest in keys(word, order)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=["key", "longest", "word", "n"])

    return run


def _over_bound(lists: list[list[int]], least: int, after: int) -> Iterator[int]:
    """Rows over ``after`` that ``least`` of the postings hold; each posting is sorted.

    The longest postings, one or two fewer than ``least``, are set aside: a row that ``least`` hold is in two of
    the others at least (in one, if ``least`` is one). These are heap-merged; what comes up often enough is looked up in those set aside.
    """
    lists.sort(key=len)
    kept = len(lists) - max(0, least - 2)
    short, aside = lists[: max(0, kept)], lists[max(0, kept) :]
    for at, times in groupby(heapq.merge(*[x[bisect_right(x, after) :] for x in short])):
        n = sum(1 for _ in times)
        if n + len(aside) < least:
            continue
        for x in aside:
            k = bisect_left(x, at)
            n += k < len(x) and x[k] == at
        if n >= least:
            yield at


def merged(left: list[str], right: list[str], longest: int, within: bool) -> Iterator[tuple[str, str]]:
    """Near pairs between two blocks (or within one, ``left``), at least one of each pair of length ``longest``.

    The index is of ``right``, for each of the two lengths; its postings are in the order of its rows.
    """
    index: dict[int, dict[tuple[str, int], list[int]]] = {longest: {}, longest - 1: {}}
    for k, word in enumerate(right):
        own = index[len(word)]
        for at in zip(grams(word), count()):
            own.setdefault(at, []).append(k)
    long, short = index[longest], index[longest - 1]
    for k, word in enumerate(left):
        of = list(zip(grams(word), count()))
        after = k if within else -1
        if len(word) == longest:
            found = [_over_bound([x for at in of if (x := long.get(at)) and x[-1] > after], longest - 1, after)]
            if short:
                found.append(_over_bound([x for g, p in of for at in ((g, p), (g, p - 1)) if (x := short.get(at)) and x[-1] > after], longest - 1, after))
        else:
            found = [_over_bound([x for g, p in of for at in ((g, p), (g, p + 1)) if (x := long.get(at)) and x[-1] > after], longest - 1, after)]
        for rows in found:
            for at in rows:
                if near(word, right[at]):
                    yield word, right[at]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows that come sorted by group; a group is one pair of blocks."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out: list[tuple] = []

    def handed() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["a", "na", "b", "nb"])

    for (_, longest, i, j), group in groupby(rows(), key=lambda r: r[:4]):
        left, right = {}, {}
        for *_, block, word, n in group:
            (left if block == i else right)[word] = n
        if i == j:
            right = left
        if len(left) < 2 and i == j or not any(len(w) == longest for w in (*left, *right)):
            continue
        for a, b in merged(list(left), list(right), longest, i == j):
            out.append((a, left[a], b, right[b]))
        if len(out) > 50_000:
            yield handed()
    yield handed()


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each near pair of ``words`` (word, n) once, in either order."""
    spark = words.sparkSession
    arrow_batches(spark)
    padded = F.concat(F.lit(START), "word", F.lit(END))
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda k: F.substring(padded, k, F.lit(2)))).alias("gram"))
    counts = sorted((r[1], r[0]) for r in each.groupBy("gram").count().collect())  # at most 92 x 92 rows
    order = {g: k for k, (_, g) in enumerate(counts)}
    dealt = words.select("word", "n").mapInArrow(_dealt(order), "key long, longest int, word string, n long")
    group = ["key", "longest"]
    sizes = dealt.groupBy(*group).agg(F.count("*").alias("rows"), F.max(F.length("word")).alias("most"))
    many = sizes.filter("rows > 1 AND most = longest").select(*group, F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    split = dealt.join(many, group).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")
    parts = split.repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j")
    pairs = parts.mapInArrow(_pairs, "a string, na long, b string, nb long")
    ordered = F.col("a") < F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.when(ordered, F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(ordered, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


# Forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): each form followed to the last, by pointer jumping."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        stepped = now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = checkpointed(stepped)
        now = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return now


def spelling_forms(docs: DataFrame) -> DataFrame:
    """Every word with its form, root and counts."""
    words = checkpointed(word_counts(docs))
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    best = checkpointed(best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    last = roots(best.filter("form is not null"))
    found = words.join(best, "word", "left").join(last, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
