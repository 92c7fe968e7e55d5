"""Language identification by mixture inference.

Each language has a smoothed distribution over hashed letter trigrams, counted
over all labelled rows. A document is a mixture of languages:
expectation-maximisation estimates the proportions from the trigram
likelihoods. Languages are then ordered by proportion, and the set kept is the
one with the best penalised likelihood (a penalty for each further language
that grows with the logarithm of the number of trigrams). The language with
the largest proportion in that set is the prediction, the proportion its score.

Cases: a null text, or one without a letter, is ``und`` with score 0; without
any labelled row every text is ``und``; a label that is null is not learned;
equal proportions go to the language that sorts first; repeated rows count as
often as they stand. The model has ``BUCKETS`` numbers for each language and
does not grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinwork.llm.common import append_columns, arrow_batches

BUCKETS = 1 << 16
#: Weight of the penalty for a further language: so many times half the logarithm of the number of trigrams.
#: Languages with a smaller share in the mixture of all are in no set.
LEAST_SHARE = 0.01
PENALTY = 6.0
ROUNDS = 20
SMOOTHING = 0.5
UNDETERMINED = "und"
_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the lower-cased letter trigrams; all that stands between letters is one space."""
    if not text:
        return np.empty(0, np.uint16)
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    cp = cp[keep]
    if len(cp) < 3:
        return np.empty(0, np.uint16)
    h = (cp[:-2] * _A) ^ (cp[1:-1] * _B + (cp[:-2] << np.uint32(7))) ^ (cp[2:] * _C)
    h ^= h >> np.uint32(15)
    h *= _B
    return (h >> np.uint32(16)).astype(np.uint16)


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``labelled`` (lang, text): summed in each task before the shuffle."""
    arrow_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = trigrams(text)
                if len(g):
                    if lang not in counts:
                        counts[lang] = np.zeros(BUCKETS, np.int64)
                    counts[lang] += np.bincount(g, minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    each = labelled.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(run, "lang string, bucket int, n long")
    return each.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-likelihoods, languages in code-point order."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.log_p = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
        self.p = np.exp(self.log_p)

    @classmethod
    def fit(cls, labelled: DataFrame) -> Model:
        rows = count_trigrams(labelled).toPandas()
        langs = sorted(rows["lang"].unique())
        counts = np.zeros((len(langs), BUCKETS))
        at = {lang: k for k, lang in enumerate(langs)}
        counts[rows["lang"].map(at).to_numpy(dtype=np.int64, na_value=0), rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
        return cls(langs, counts)

    def mixture(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """The chosen languages with their proportions, largest first; the mean log-likelihood of a trigram."""
        grams, n = np.unique(trigrams(text), return_counts=True)
        if not len(grams) or not self.langs:
            return [], 0.0
        n = n.astype(np.float32)
        total = float(n.sum())
        p = self.p[:, grams]
        pi, _ = _em(p, n, total, np.full(len(self.langs), 1 / len(self.langs), np.float32))
        order = np.argsort(-pi, kind="stable")
        best = None
        # Sets of the k languages with the largest shares in the mixture of all; those with hardly any can't pay for their penalty.
        for k in range(1, max(1, int((pi >= LEAST_SHARE).sum())) + 1):
            own = order[:k]
            if k == 1:
                share, like = np.ones(1, np.float32), float(self.log_p[own[0], grams] @ n)
            else:
                share, like = _em(p[own], n, total, (pi[own] + 1e-6) / (pi[own] + 1e-6).sum())
            score = like - PENALTY * 0.5 * (k - 1) * math.log(total + 1)
            if best is None or score > best[0]:
                best = (score, own, share, like)
        _, own, share, like = best
        ranked = sorted(zip((self.langs[i] for i in own), map(float, share)), key=lambda x: (-x[1], x[0]))
        return ranked, like / total


def _em(p: np.ndarray, n: np.ndarray, total: float, pi: np.ndarray) -> tuple[np.ndarray, float]:
    for _ in range(ROUNDS):
        joint = pi @ p
        new = pi * (p @ (n / joint)) / total
        new /= new.sum()
        moved = float(np.abs(new - pi).max())
        pi = new
        if moved < 1e-3:
            break
    return pi, float(np.log(pi @ p) @ n)


_MIX = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", _MIX), T.StructField("fit", T.DoubleType())]


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``languages`` (the mixture) and ``fit``.

    ``fit`` is the mean log-likelihood of a trigram against one drawn evenly
    from all buckets; below zero the text looks like none of the languages.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    even = math.log(BUCKETS)

    def make() -> Callable:
        mixture = sent.value.mixture

        def work(texts: list) -> dict[str, pa.Array]:
            found = [mixture(t) for t in texts]
            return {
                "lang_pred": pa.array([m[0][0] if m else UNDETERMINED for m, _ in found], pa.string()),
                "score": pa.array([min(1.0, max(0.0, m[0][1])) if m else 0.0 for m, _ in found], pa.float64()),
                "languages": pa.array([[{"lang": lang, "share": s} for lang, s in m] for m, _ in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                "fit": pa.array([like + even if m else None for m, like in found], pa.float64()),
            }

        return work

    return append_columns(docs, FIELDS, make)


def held_out(doc_id="doc_id"):
    """The fold that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """The contract of ``op2``: learn from three folds, predict every text."""
    slim = docs.select("doc_id", "text", "lang")
    model = Model.fit(slim.filter(~held_out()))
    found = identify_languages(slim.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows with a language: undetermined texts, and those no language explains better than chance, go.

    Learns from the rows' own labels. Without any label nothing can be judged and all rows stay.
    """
    model = Model.fit(docs)
    if not model.langs:
        return docs
    found = identify_languages(docs, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("fit") > 0))
    return found.select(*[found[c] for c in docs.columns])
