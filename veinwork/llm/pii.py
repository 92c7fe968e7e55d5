"""Personal data: base patterns, and a skip-chain conditional random field.

The base patterns give e-mail addresses, IP addresses, cards and telephone
numbers. The random field then labels every candidate segment of a document:
runs of digits, words with an at sign, and long runs of letters and digits.
Its unary potentials are a log-linear model of the segment's shape and context,
its chain potentials join neighbouring segments, and its skip potentials join
segments that are equal or similar wherever they stand. Loopy sum-product
messages settle the labels, so a number that the patterns found once is also
found where it is written another way. Segments with a confident label that no
base span touches become further spans; base spans always stay.

Base spans are positive labels; that no pattern matches says less, since a
number may lack its plus sign or use other separators. So the unary model is
learned from positive and unlabelled segments: the probability that a segment
is labelled, over the mean of that among the labelled ones of its kind, is the
probability that it is of the kind. A further kind, ``secret``, has no base
pattern: its labels are long mixed values that a text assigns to a name like
``token``, and access keys of a known form; the field finds the same values
elsewhere. Chain and skip weights are fitted piecewise, each on its pairs of
neighbours or twins.

The model is learned here, on at most ``SAMPLE_ROWS`` distinct texts: those with
the smallest hashes of each label and of segments without one, taken in turn,
so that whichever label the table holds is learned from however rare it is, and
copies count once. All rows are then searched, whole.

Cases: a null or empty text has no spans; without anything to learn from only
base spans are returned; a repeated row gets what its twin gets; time is linear
in the length of a text, also for one run of a million digits.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinwork.llm.common import append_columns, arrow_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
_LABELS = len(KINDS) + 1
SAMPLE_ROWS = 1000
#: Least probability of a label for a span beyond the base ones.
CONFIDENT = 0.9
ROUNDS = 12
DAMPING = 0.3
#: Labels of a kind from which on its share of unlabelled segments is estimated.
LEAST_LABELS = 10
#: Agreements of equal and of similar pairs that are taken as seen beforehand, to one disagreement.
TWINS = (1000, 4)
#: Weight of the chain beside the unary model, which has seen the context of a segment as well.
CHAIN = 0.25

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; each character before an at sign is looked at once."""
    out, cursor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        cursor = m.end() if m else at + 1
        at = text.find("@", cursor)
    return out


def _ip_ok(match: str) -> bool:
    return all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in match.split("."))


def _card_ok(match: str) -> bool:
    digits = match.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(match: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in match) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kinds, then start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for kind, pattern, ok in ((1, _IP, _ip_ok), (2, _CARD, _card_ok), (3, _PHONE, _phone_ok)):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m[0])]
    return out


_RUN = re.compile(r"\+?\(?[0-9][0-9\x20().-]*")
_EDGE = ".,;:!?\"'()[]{}<>"


_MIXED = re.compile(r"[A-Za-z0-9_+/-]{20,}")
#: Public forms of access keys.
_KEY = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key)[\x20\t]{0,8}[:=][\x20\t]{0,8}[\"']?$")


def mixed_runs(text: str) -> list[tuple[int, int]]:
    """Runs of at least 20 letters and digits, some of each."""
    return [m.span() for m in _MIXED.finditer(text) if _DIGITS.search(m[0]) and sum(c.isalpha() for c in m[0]) >= 3 and len(set(m[0])) >= 8]


def named_secrets(text: str) -> list[tuple[int, int, int]]:
    """Mixed runs that the text assigns to a name of a secret, or that have the form of an access key, as spans of kind 4."""
    return [(len(BASE_KINDS), a, b) for a, b in mixed_runs(text) if _KEY.fullmatch(text, a, b) or _NAMED.search(text, max(0, a - 40), a)]


def labelled_spans(text: str | None) -> list[tuple[int, int, int]]:
    """What the field learns from and is held to: base spans and named secrets."""
    return base_spans(text) + (named_secrets(text) if text and _DIGITS.search(text) else [])


def segments(text: str) -> list[tuple[int, int]]:
    """Candidate segments in order: long runs of digits, dotted numbers, mixed runs, words with an at sign."""
    out = []
    if _DIGITS.search(text):
        out = mixed_runs(text)
        taken = iter([*out, (len(text) + 1, len(text) + 2)])
        low, high = next(taken)
        for m in _RUN.finditer(text):
            s = m[0].rstrip(" ().-")
            while high <= m.start():
                low, high = next(taken)
            digits = sum("0" <= c <= "9" for c in s)
            if (digits >= 7 or digits >= 4 and s.count(".") >= 3) and m.start() + len(s) <= low:
                out.append((m.start(), m.start() + len(s)))
    at, cursor = text.find("@"), 0
    while at >= 0:
        a = b = at
        while a > cursor and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        cursor = b
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b - a > 2:
            out.append((a, b))
        at = text.find("@", cursor)
    return sorted(out)


def _bucket(x: int, edges: tuple[int, ...]) -> int:
    return sum(x >= e for e in edges)


#: Features: a one-hot block for each of these, then context.
_BLOCKS = (("digits", 10), ("dots", 5), ("length", 6), ("context", 8))
N_FEATURES = sum(n for _, n in _BLOCKS) + 10


def features(text: str, a: int, b: int) -> list[int]:
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    local, _, domain = s.partition("@")
    before = text[max(0, a - 24) : a].rstrip(" :=\"'").rpartition(" ")[2].lower()
    values = (
        _bucket(len(digits), (1, 4, 7, 9, 11, 13, 15, 17, 20)),
        _bucket(s.count("."), (1, 2, 3, 4)),
        _bucket(b - a, (8, 12, 16, 20, 40)),
        sum(map(ord, before)) % 8,
    )
    out, base = [], 0
    for v, (_, n) in zip(values, _BLOCKS):
        out.append(base + v)
        base += n
    flags = ("@" in s, s.startswith("+"), "(" in s, "-" in s, " " in s, any(c.isalpha() for c in s), bool(local) and bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain)), 13 <= len(digits) <= 19 and luhn(digits), s.count(".") == 3 and all(p.isdigit() and len(p) <= 3 for p in s.split(".")), len(set(digits)) <= 2)
    return out + [base + k for k, f in enumerate(flags) if f]


def links(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Skip edges (equal, similar): each segment with the last one before it that has the same normal form, or the same core.

    Equal segments are joined to the first of their form as well: any two are
    two edges apart, so that ``ROUNDS`` carry evidence to all of them.
    """
    equal, similar = [], []
    first_equal: dict[str, int] = {}
    last_equal: dict[str, int] = {}
    last_similar: dict[str, int] = {}
    for k, (a, b) in enumerate(spans):
        s = text[a:b].lower()
        digits = "".join(c for c in s if "0" <= c <= "9")
        normal = s if "@" in s else "#" + digits
        core = s.partition("@")[0].strip(_EDGE) if "@" in s else "#" + digits[-9:]
        if normal in last_equal:
            equal.append((last_equal[normal], k))
            if first_equal[normal] != last_equal[normal]:
                equal.append((first_equal[normal], k))
        elif core in last_similar and len(core) > 4:
            similar.append((last_similar[core], k))
        first_equal.setdefault(normal, k)
        last_equal[normal] = last_similar[core] = k
    return equal, similar


def _soft(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class SkipChain:
    """Labels 0 (none) and 1 + the kind."""

    def __init__(self, weights: np.ndarray, share: np.ndarray, chain: np.ndarray, equal: float, similar: float):
        self.weights, self.share, self.chain, self.equal, self.similar = weights, share, chain, equal, similar

    @classmethod
    def fit(cls, texts: list[str]) -> SkipChain | None:
        rows, labels, pairs, agree = [], [], np.ones((_LABELS, _LABELS)), [[0, 0], [0, 0]]
        for text in texts:
            spans = segments(text)
            own = held(spans, labelled_spans(text))
            for (s, e), y in zip(spans, own):
                rows.append(features(text, s, e))
                labels.append(y)
            for y, z in zip(own, own[1:]):
                pairs[y, z] += 1
            for kind, edges in enumerate(links(text, spans)):
                for i, j in edges:
                    if own[i] and own[j]:  # of a pair with an unlabelled end nothing is known
                        agree[kind][0] += own[i] == own[j]
                        agree[kind][1] += 1
        if not rows or not any(labels):
            return None
        x = np.zeros((len(rows), N_FEATURES + 1), np.float64)
        x[:, -1] = 1
        for k, r in enumerate(rows):
            x[k, r] = 1
        labels = np.array(labels)
        y = np.eye(_LABELS)[labels]
        w = np.zeros((N_FEATURES + 1, _LABELS))
        for _ in range(400):
            w -= 2.0 * (x.T @ (_soft(x @ w) - y) / len(x) + 1e-4 * w)
        p = _soft(x @ w)
        # How likely a segment of a kind is labelled; few labels don't tell, and then labels count as all there are.
        share = np.ones(_LABELS)
        for k in range(1, _LABELS):
            if (n := (labels == k).sum()) >= LEAST_LABELS:
                share[k] = p[labels == k, k].mean()
        joint = pairs / pairs.sum()
        chain = CHAIN * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
        chain[0] = chain[:, 0] = 0  # unlabelled isn't none
        # The weight that makes a lone pair agree as often as was seen (smoothed).
        odds = [float(np.log((a + before) * (_LABELS - 1) / (n - a + 1))) for (a, n), before in zip(agree, TWINS)]
        return cls(w, share, chain, odds[0], min(odds))

    def unary(self, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
        """Log potentials: of positive and unlabelled learning, see the module's text."""
        z = np.array([self.weights[features(text, s, e)].sum(0) + self.weights[-1] for s, e in spans])
        p = _soft(z) / self.share
        p[:, 1:] /= np.maximum(1, p[:, 1:].sum(1, keepdims=True) / 0.99)
        p[:, 0] = 1 - p[:, 1:].sum(1)
        return np.log(np.maximum(p, 1e-9))

    def label(self, text: str, spans: list[tuple[int, int]], own: list[int]) -> np.ndarray:
        """Marginals by loopy sum-product; segments that base spans touch are held to their label (``own``)."""
        n = len(spans)
        theta = self.unary(text, spans)
        for k, y in enumerate(own):
            if y:
                theta[k] = -40
                theta[k, y] = 0
        equal, similar = links(text, spans)
        same = np.eye(_LABELS)
        edges = [(k, k + 1, self.chain) for k in range(n - 1)] + [(i, j, self.equal * same) for i, j in equal] + [(i, j, self.similar * same) for i, j in similar]
        theta -= theta.max(1, keepdims=True)
        if not edges:
            p = np.exp(theta)
            return p / p.sum(1, keepdims=True)
        src = np.array([i for i, j, _ in edges] + [j for i, j, _ in edges])
        dst = np.array([j for i, j, _ in edges] + [i for i, j, _ in edges])
        psi = np.exp(np.array([m for *_, m in edges] + [m.T for *_, m in edges]))
        back = np.r_[len(edges) : 2 * len(edges), : len(edges)]
        log_m = np.zeros((len(src), _LABELS))
        for _ in range(ROUNDS):
            belief = theta.copy()
            np.add.at(belief, dst, log_m)
            cavity = belief[src] - log_m[back]
            cavity = np.exp(cavity - cavity.max(1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", cavity, psi) + 1e-300)
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - log_m).max()
            log_m = DAMPING * log_m + (1 - DAMPING) * new
            if moved < 1e-4:
                break
        belief = theta.copy()
        np.add.at(belief, dst, log_m)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def find(text: str | None, field: SkipChain | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the random field adds."""
    base = base_spans(text)
    if not text or field is None:
        return base, []
    spans = segments(text)
    if not spans:
        return base, []
    based = held(spans, base)
    if all(based):
        return base, []
    own = held(spans, labelled_spans(text))
    p = field.label(text, spans, own)
    best = p.argmax(1)
    added = [(int(best[k]) - 1, s, e) for k, (s, e) in enumerate(spans) if not based[k] and best[k] and p[k, best[k]] >= CONFIDENT]
    return base, added


def held(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """For each segment 1 + the kind of a base span that touches it, else 0; one sweep for each kind."""
    out = [0] * len(spans)
    for kind in range(len(KINDS)):
        own = sorted((a, b) for k, a, b in base if k == kind)
        k, reach = 0, -1
        for j, (s, e) in enumerate(spans):
            while k < len(own) and own[k][0] < e:
                reach = max(reach, own[k][1])
                k += 1
            if reach > s and not out[j]:
                out[j] = kind + 1
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
FIELDS = [T.StructField("base_spans", _SPAN), T.StructField("added_spans", _SPAN)]


def strata(text: str) -> set[int]:
    """Labels of the segments (1 + kind); 0 for segments without any label; nothing for texts without segments."""
    spans = segments(text)
    return {y for y in held(spans, labelled_spans(text)) if y} or ({0} if spans else set())


def sample(docs: DataFrame, most: int) -> list[str]:
    """Distinct texts to learn from: the labels take turns, each with its smallest hashes.

    Tasks pass on hashes alone, at most ``most`` for each label; the texts of
    those that are chosen are fetched by a second pass.
    """
    marked = docs.select(F.xxhash64("text").alias("h"), "text").filter(F.col("text").rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[set[int]] = [set() for _ in range(len(KINDS) + 1)]
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                for y in strata(text):
                    best[y].add(h)
            best = [set(heapq.nsmallest(most, b)) if len(b) > most else b for b in best]
        rows = [(y, h) for y, b in enumerate(best) for h in b]
        yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.int64())], names=["label", "h"])

    turn = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    ranked = marked.mapInArrow(run, "label int, h long").distinct().select("h", turn.alias("turn")).filter(F.col("turn") <= most)
    chosen = [r["h"] for r in ranked.groupBy("h").agg(F.min("turn").alias("turn")).orderBy("turn", "h").limit(most).collect()]
    few = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long"))
    return [r["text"] for r in marked.join(few, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").toLocalIterator()]


def find_personal_data(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``base_spans`` and ``added_spans`` (kind, start, end in code points, end exclusive)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(SkipChain.fit(sample(docs, sample_rows)))

    def make() -> Callable:
        field = sent.value
        as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

        def work(texts: list) -> dict[str, pa.Array]:
            found = [find(t, field) for t in texts]
            return {"base_spans": pa.array([as_rows(b) for b, _ in found], _SPAN_ARROW), "added_spans": pa.array([as_rows(a) for _, a in found], _SPAN_ARROW)}

        return work

    return append_columns(docs, FIELDS, make)


def _joined(spans):
    rank = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``op8``; the counts are of base spans."""
    found = find_personal_data(docs.select("doc_id", "text"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size("base_spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    n_added = F.size("added_spans").cast("long")
    n_spans = F.size("base_spans").cast("long") + n_added
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.concat("base_spans", "added_spans")).alias("spans"), n_added.alias("n_added"), n_spans.alias("n_spans"))
