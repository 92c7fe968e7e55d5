"""A stored inverted index over texts: written once, kept by changed rows, read by the lexemes of a search.

The index is a folder of segments and a manifest that names the complete ones;
it is published by a rename, so a reader sees one state or the next. A segment holds, for the rows that it added:

* ``postings``: (bucket, lexeme, block, most, ids, ends, positions), partitioned by bucket (a hash of the lexeme), in the order of
  lexeme and block. A row has many ids of a lexeme's block (``lexemes.py``) and the most occurrences that any of them has. A block is a
  class of text lengths and a share of it, so that blocks of short texts have small maxima. A search prunes to the buckets of its lexemes, then to their row groups;
* ``rows``: (id, hash), also for rows that the segment removes (hash null).

A row belongs to the latest segment that names it. ``refresh`` compares hashes,
so only changed texts are read and indexed; ``compact`` merges segments into one.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.functions import spanish  # noqa: F401
from veinwork.functions import text as text_functions  # noqa: F401
from veinwork.operators.lexemes import ROWS, WORD, by_id, lexeme_rows
from veinwork.operators.relational import few, spread
from veinwork.sources.manifest import read_json, replace_json

BUCKETS = 64
#: Blocks that a ranked search reads first.
FIRST_BLOCKS = 4
POSTINGS = "lexeme string, block int, id long, positions array<int>"
#: Ids from so many values share a row of a merged segment, as bits.
MERGED_BITS = 10


def bucket_of(lexeme: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(BUCKETS)).cast("int")


def weight(occurrences: Column) -> Column:
    """What a lexeme adds to a text's rank: more for more occurrences, less than one in all."""
    return occurrences / (occurrences + 1)


class TextIndex:
    """The index in a folder of a store that driver and executors share; ``stemmed`` keeps stems of words with a meaning, else all folded words."""

    def __init__(self, spark: SparkSession, folder: str, stemmed: bool = False):
        self.spark, self.folder, self.stemmed = spark, folder, stemmed

    # Writing

    def segments(self) -> list[str]:
        return (read_json(self.folder, "index.json") or {"segments": []})["segments"]

    def refresh(self, texts: DataFrame) -> dict[str, int]:
        """Bring the index to ``texts`` (id, text; ids once, null texts hold nothing): counts of rows that were new, changed and gone."""
        if not self.segments():
            self._write(texts.filter("text is not null"), texts.filter("text is not null").select("id", F.xxhash64("text").alias("hash")))
            return {"new": self.rows().count(), "changed": 0, "gone": 0}
        now = texts.select("id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h")).filter("h is not null")
        was = self.rows().select(F.col("id").alias("old"), F.col("hash").alias("old_h"))
        both = now.join(was, F.col("id") == F.col("old"), "full").filter(~F.col("h").eqNullSafe(F.col("old_h")))
        changes = both.select(F.coalesce("id", "old").alias("id"), F.when(F.col("old").isNull(), "new").when(F.col("id").isNull(), "gone").otherwise("changed").alias("what"), F.col("h").alias("hash")).checkpoint(eager=True)
        counts = {"new": 0, "changed": 0, "gone": 0} | {r["what"]: r["count"] for r in changes.groupBy("what").count().collect()}
        if sum(counts.values()):
            added = few(changes.filter("what <> 'gone'").select("id"), counts["new"] + counts["changed"])
            self._write(texts.join(added, "id", "left_semi"), changes.select("id", "hash"))
        return counts

    def follow(self, texts: DataFrame) -> None:
        """``refresh`` unless the files that ``texts`` reads are those of the last time, by name, size and time."""
        files = self._files_of(texts)
        if (read_json(self.folder, "source.json") or {}).get("files") != files:
            self.refresh(texts)
            replace_json(self.folder, "source.json", {"files": files})

    def _files_of(self, texts: DataFrame) -> str:
        conf, path = self.spark._jsc.hadoopConfiguration(), self.spark._jvm.org.apache.hadoop.fs.Path
        seen = []
        for name in sorted(texts.inputFiles()):
            at = path(name).getFileSystem(conf).getFileStatus(path(name))
            seen.append(f"{name} {at.getLen()} {at.getModificationTime()}")
        return hashlib.sha256("\n".join(seen).encode()).hexdigest()

    def _write(self, added: DataFrame, rows: DataFrame) -> None:
        name = f"segment-{uuid.uuid4().hex}"
        self._store(lexeme_rows(spread(added.select("id", "text")), "stemmed" if self.stemmed else "folded"), name)
        rows.write.parquet(f"{self.folder}/{name}/rows")
        replace_json(self.folder, "index.json", {"segments": [*self.segments(), name]})

    def _store(self, postings: DataFrame, name: str) -> None:
        """Buckets of common lexemes are dealt to several tasks (and files)."""
        dealt = postings.withColumn("bucket", bucket_of(F.col("lexeme"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", "block")
        dealt.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{self.folder}/{name}/postings")

    def compact(self) -> None:
        """One segment in place of all: what is valid of their postings."""
        before = self.segments()
        if len(before) < 2:
            return
        name = f"segment-{uuid.uuid4().hex}"
        one = F.collect_list(F.struct("id", "size", "positions"))
        merged = self._valid(True).groupBy("lexeme", "block", F.shiftright("id", MERGED_BITS)).agg(F.max("size").alias("most"), one.alias("x"))
        sums = F.transform("x.size", lambda _, i: F.aggregate(F.slice("x.size", 1, i + 1), F.lit(0), lambda a, b: a + b))
        self._store(merged.select("lexeme", "block", "most", F.col("x.id").alias("ids"), sums.alias("ends"), F.flatten("x.positions").alias("positions")), name)
        self.rows().write.parquet(f"{self.folder}/{name}/rows")
        replace_json(self.folder, "index.json", {"segments": [name]})

    # Reading

    def _read(self, segment: str, what: str) -> DataFrame:
        schema = {"postings": f"{ROWS}, bucket int", "rows": "id long, hash long"}[what]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{segment}/{what}")

    def rows(self) -> DataFrame:
        """(id, hash) of the rows that the index holds."""
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], "id long, hash long")
        each = reduce(DataFrame.unionByName, [self._read(s, "rows").withColumn("k", F.lit(k)) for k, s in enumerate(segments)])
        if len(segments) > 1:
            each = each.groupBy("id").agg(F.max_by("hash", "k").alias("hash"))  # null hashes count: the latest naming decides
        return each.filter("hash is not null").select("id", "hash")

    def _valid(self, positions: bool, keep: Column | None = None) -> DataFrame:
        """(lexeme, block, id, size, and positions if wanted) of all segments, without rows that a later segment names."""
        segments, out = self.segments(), None
        for k, s in enumerate(segments):
            part = self._read(s, "postings")
            part = by_id(part if keep is None else part.filter(keep), positions)
            for later in segments[k + 1 :]:
                part = part.join(self._read(later, "rows").select("id"), "id", "left_anti")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], f"{POSTINGS}, size int") if out is None else out

    def _of(self, lexemes: list[str]) -> Column:
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[bucket_of(F.lit(x)) for x in lexemes]))).collect()]
        return F.col("bucket").isin(sorted(set(buckets))) & F.col("lexeme").isin(lexemes)

    def postings(self, lexemes: list[str]) -> DataFrame:
        """(lexeme, block, id, positions) of some lexemes: reads their buckets alone."""
        if not lexemes:
            return self.spark.createDataFrame([], POSTINGS)
        return self._valid(True, self._of(sorted(set(lexemes)))).select("lexeme", "block", "id", "positions")

    def hits(self, groups: tuple[tuple[str, ...], ...]) -> DataFrame:
        """(id, hits): how many groups have a term in the text; a term is a folded word, or several in a row."""
        terms = {t: tuple(WORD.findall(t)) for g in groups for t in g}
        single = {w[0]: t for t, w in terms.items() if len(w) == 1}
        found = []
        if single:
            # One word: ids alone are read.
            found.append(self._valid(False, self._of(sorted(single))).select("id", F.col("lexeme").alias("term")))
        several = {t: w for t, w in terms.items() if len(w) > 1}
        if several:
            words = sorted({x for w in several.values() for x in w})
            rows = self.postings(words).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("at"))
            at = lambda w: F.coalesce(F.try_element_at("at", F.lit(w)), F.array().cast("array<int>"))
            # A phrase: places of each word moved back by its place in the phrase have one in common.
            back = lambda x, k: F.transform(at(x), lambda p: p - k)
            occurs = lambda w: F.size(reduce(F.array_intersect, [back(x, k) for k, x in enumerate(w)])) > 0
            named = F.array_compact(F.array(*[F.when(occurs(w), F.lit(t)) for t, w in several.items()]))
            found.append(rows.select("id", F.explode(named).alias("term")))
        if not found:
            return self.spark.createDataFrame([], "id long, hits int")
        terms_of = reduce(DataFrame.unionByName, found)
        one = [F.max(F.col("term").isin([" ".join(WORD.findall(t)) for t in g] + list(g)).cast("int")) for g in groups]
        return terms_of.groupBy("id").agg(reduce(lambda a, b: a + b, one).alias("hits")).filter("hits > 0")

    def top(self, lexemes: list[str], most: int) -> DataFrame:
        """(id, score) of the ``most`` rows with the largest sum of weights, ties by id: blocks whose bound can't reach them aren't read.

        A block's bound is the sum of its lexemes' largest weights. The blocks with the largest bounds are read first; their
        last score among ``most`` is the least that another block has to offer. Bounds are one number for each block, of
        at most some hundreds; removed rows may make them too large, never too small.
        """
        lexemes = sorted(set(lexemes))
        if not lexemes or not self.segments():
            return self.spark.createDataFrame([], "id long, score double")
        of = self._of(lexemes)
        blocks = reduce(DataFrame.unionByName, [self._read(s, "postings").filter(of).select("block", "lexeme", "most") for s in self.segments()])
        largest = blocks.groupBy("block", "lexeme").agg(F.max("most").alias("most"))
        bounds = sorted(((r.bound, r.block) for r in largest.groupBy("block").agg(F.sum(weight(F.col("most"))).alias("bound")).collect()), reverse=True)
        first = [b for _, b in bounds[:FIRST_BLOCKS]]
        head = self._scored(of & F.col("block").isin(first), most).checkpoint(eager=True)
        worst = head.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        least = worst.least if worst.n == most else 0.0
        rest = [b for bound, b in bounds[FIRST_BLOCKS:] if bound >= least - 1e-9]
        if not rest:
            return head
        return head.unionByName(self._scored(of & F.col("block").isin(rest), most)).orderBy(F.desc("score"), "id").limit(most)

    def _scored(self, keep: Column, most: int) -> DataFrame:
        found = self._valid(False, keep).groupBy("id").agg(F.round(F.sum(weight(F.col("size"))), 9).alias("score"))
        return found.orderBy(F.desc("score"), "id").limit(most)
