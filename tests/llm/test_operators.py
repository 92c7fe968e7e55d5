"""Every operator over awkward rows, an empty table and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import SMALL, database, same
from tests.llm.fixtures import documents, empty
from veinwork.llm import chat, common, components, decontamination, entry, jaccard, language, lines, mixing, pii, quality, substrings, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [tuple(r) for r in docs.collect()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Contracts over SQL and brute force


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, name):
    same(entry.queries()[name](spark, SMALL), database(), entry.oracle_sql()[name])


def test_language(spark, docs):
    out = {(r.doc_id, r.held_out): r for r in language.predict_held_out(docs).collect()}
    assert len(out) and all(0 <= r.score <= 1 for r in out.values())
    for r in out.values():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    und = {r.doc_id for r in out.values() if r.lang_pred == "und"}
    assert {100, 101, 102, 103} <= und and 3 not in und
    assert language.predict_held_out(empty(spark)).count() == 0
    unlabelled = language.predict_held_out(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_accuracy_on_held_out_rows(spark):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    p = language.predict_held_out(d).filter("held_out").join(d.select("doc_id", "lang"), "doc_id")
    right, n = p.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95


def test_quality(docs, plain):
    want = []
    for i, t, *_ in plain:
        w = WORD.findall(t or "")
        own = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    found = quality.quality_digest(docs)
    assert got(found.drop("kept")) == sorted(want, key=repr)
    assert found.filter("kept and base_failed").count() == 0 and found.filter("kept").count() > 5


def brute_lines(rows):
    seen, out = {}, []
    order = sorted({(i is not None, i or 0, common_hash(t), t) for i, t in rows if t is not None})
    first = {}
    for has, i, h, t in order:
        ls = t.split("\n")
        for k in range(len(ls) - 2):
            first.setdefault(tuple(ls[k : k + 3]), (has, i, h, k))
    for i, t in rows:
        gone = set()
        ls = t.split("\n") if t is not None else []
        for k in range(len(ls) - 2):
            if first[tuple(ls[k : k + 3])] != (i is not None, i or 0, common_hash(t), k):
                gone |= {k, k + 1, k + 2}
        left = "\n".join(x for k, x in enumerate(ls) if k not in gone)
        out.append((i, len(ls), len(gone), ",".join(map(str, sorted(gone))), hashlib.sha256((left if gone else t or "").encode()).hexdigest()))
    return sorted(out, key=repr), seen


_HASHES: dict = {}


def common_hash(t):
    return _HASHES[t]


def test_lines(docs, plain):
    for r in docs.select("text", common.row_key().alias("k")).collect():
        _HASHES[r.text] = r.k.th
    assert got(lines.line_digest(docs)) == brute_lines([(i, t) for i, t, *_ in plain])[0]


def test_decontamination_blocks_agree(spark, docs, plain):
    items = [(1, " ".join((plain[3][1] or "").split()[:12])), (2, "Bird"), (3, None), (None, "river"), (2, "stone cloud"), (40, "nothing of this kind occurs")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = got(decontamination.contamination_digest(decontamination.decontaminate(docs, bench)))
    many = got(decontamination.contamination_digest(decontamination.decontaminate(docs, bench, block_bytes=1)))
    assert one == many
    search = decontamination.WuManber(items).search
    want = []
    for i, t, *_ in plain:
        n, spans, hits = search(t)
        k = sum(b - a for a, b in spans)
        want.append((i, n, k, len(hits), hashlib.sha256(",".join(hits).encode()).hexdigest(), k > 0))
    assert one == sorted(want, key=repr) and any(w[2] for w in want)
    assert not decontamination.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count()


def test_tokens(docs, plain):
    c = tokens._counter(None, tokens.CHUNK_CHARS, tokens.OVERLAP_CHARS)
    want = [(i, len((t or "").encode()), n := len(c.library.encode(t or "", add_special_tokens=False)), n > 1024) for i, t, *_ in plain]
    assert got(tokens.token_counts(docs)) == sorted(want, key=repr)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, total, full = set(names), 1.5 * sum(sizes.values()), {}
    while True:
        share = {s: weight[s] * total / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 2.0 * sizes[s]
            total -= full[s]
            left.remove(s)


def test_mixing(docs, plain):
    out = mixing.mix_digest(docs)
    rows = out.collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in plain:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in plain)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    source = {r.source_size: r.target for r in rows}
    assert sorted(round(x, 6) for x in source.values()) == sorted(round(want[s], 6) for s in {sizes[k]: k for k in sizes}.values())
    for size, target in source.items():
        own = [r for r in rows if r.source_size == size]
        if sum(sizes[k] == size for k in sizes) == 1 and target:
            assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2
    assert got(out) == got(mixing.mix_digest(docs.repartition(3)))
    wide = mixing.mix_sources(docs)
    assert got(wide.select("doc_id", "size", "taken")) == got(out.select("doc_id", "size", "taken"))


def test_mixing_keeps_near_targets_on_real_tables(spark):
    rows = mixing.mix_digest(common.table(spark, SMALL, "documents")).groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m")).collect()
    assert all(abs(r.k - r.t) <= 0.5 * r.m for r in rows)


def brute_groups(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def test_jaccard(docs, plain):
    assert got(jaccard.similarity_components(docs)) == brute_groups([(i, t) for i, t, *_ in plain])


def near_copies(spark, n=70):
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(60)]
    rows = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "x" + str(rng.randint(0, 99))
        rows.append((k, " ".join(own[rng.randint(0, 4) :])))
    rows += [(1000 + k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 12)))) for k in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_chains_of_near_copies(spark, monkeypatch):
    rows, df = near_copies(spark)
    want = brute_groups(rows)
    assert got(jaccard.similarity_components(df)) == want
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert got(jaccard.similarity_components(df)) == want


def test_components(spark):
    links = [(a, a + 1) for a in range(40)] + [(100, 7), (200, 201), (201, 202), (5, 5)]
    out = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()))
    assert out == {**{k: 0 for k in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_substrings(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    c = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = {j for k in range(len(b) - length + 1) if c[b[k : k + length]] > 1 for j in range(k, k + length)}
        out.append((i, len(b), len(gone), sum(j not in gone or j - 1 not in gone for j in gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def substring_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("ab cé") for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(60):
        rows.append((i, "".join(rng.choice(base)[rng.randint(0, 20) : rng.randint(20, 60)] if rng.random() < 0.5 else "".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 8)))))
    return rows + [(100, None), (101, ""), (102, "a" * 200), (103, "ab" * 100), (104, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]


@pytest.mark.parametrize("broadcast", [substrings.BROADCAST_RANGES, 0])
def test_substrings(spark, monkeypatch, broadcast):
    monkeypatch.setattr(substrings, "BROADCAST_RANGES", broadcast)
    rows = substring_rows()
    out = substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), 40, 10, True)
    assert got(out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), "kept")) == brute_substrings(rows, 40)


def test_substrings_with_production_length(docs, plain):
    assert got(substrings.substring_digest(docs)) == brute_substrings([(i, t) for i, t, *_ in plain], 400)


def test_personal_data(spark, docs):
    out = pii.personal_data(docs)
    assert out.count() == docs.count() and out.filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    d = spark.createDataFrame([(1, "é a.b@x.org 10.0.0.1 4111 1111 1111 1111 +1 (499) 555-6503")], "doc_id long, text string")
    r = pii.personal_data(d).first()
    # The leftmost card match starts at the address's last digit and has 17 digits: dropped, without a retry.
    spans = "email:2:11,ip:12:20,phone:41:58"
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans, r.base_sha256) == (1, 1, 0, 1, spans, hashlib.sha256(spans.encode()).hexdigest())


def test_personal_data_learns_rare_labels_from_distinct_texts(spark):
    rare = [f"Call +1 (499) 555-{k:04d} now or write p{k}@mail.example today. Order 20{k:05d} is late." for k in range(200)]
    plain = [f"Order 20{k:05d} is late, {k} times." for k in range(600)]
    asked = "Call +1 (499) 555-6503 now. Or later 1 499 555 6503 instead."
    first = spark.createDataFrame([(t,) for t in plain], "text string").orderBy(F.xxhash64("text")).first().text
    # Copies of the text with the smallest hash outnumber the whole sample.
    d = spark.createDataFrame(list(enumerate([asked, *rare, *plain, *[first] * 1200])), "doc_id long, text string")
    few, all_ = pii.sample(d, 60), pii.sample(d, pii.SAMPLE_ROWS)
    assert len(set(few)) == len(few) == 60 and sum(t.startswith("Call") for t in few) >= 20
    assert sorted(all_) == sorted({asked, *rare, *plain}) and few == pii.sample(d.repartition(7), 60)
    out = pii.find_personal_data(d).select("doc_id", F.size("added_spans").alias("n")).collect()
    assert [r.doc_id for r in out if r.n] == [0] and len(out) == 2001


# Chat


MESSAGES = "conv_id long, turn long, role string, text string"


def call(i, name="find", args=None, deps=None):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args or {"q": "x"}, "depends_on": deps or []}) + "</tool_call>"


def answer(i):
    return json.dumps({"tool_call_id": i, "content": "done"})


FIND = chat.Tool("find", (("q", "string", True), ("n", "integer", False)))


def test_chat_links_validates_and_orders(spark):
    rows = [
        (1, 0, "assistant", "first " + call("b", deps=["a"]) + call("z", "other")),
        (1, 1, "tool", answer("b")),
        (1, 2, "assistant", call("a", args={"q": 1, "k": None})),
        (1, 3, "tool", answer("a")),
        (1, 4, "tool", answer("nobody")),
        (2, 0, "assistant", call("p", deps=["q"]) + call("q", deps=["p"])),
        (3, 0, "user", "hi"),
        (3, 1, "assistant", "yes"),
        (3, None, None, None),
        (None, 0, "system", None),
    ]
    out = chat.link_tool_calls(spark.createDataFrame(rows, MESSAGES), (chat.REPLY, FIND)).collect()
    at = {(r.conv_id, r.kind, r.call_id): r for r in out}
    seq = {k: r.seq for k, r in at.items()}
    assert seq[1, "call", "a"] < seq[1, "result", "a"] < seq[1, "call", "b"] < seq[1, "result", "b"]
    assert at[1, "call", "a"].errors == "not string: q,unexpected k" and not at[1, "call", "a"].valid
    assert at[1, "call", "z"].errors == "unknown tool" and at[1, "call", "b"].valid
    assert at[1, "call", "b"].linked and not at[1, "call", "z"].linked and not at[1, "result", "nobody"].linked
    assert at[2, "call", "p"].cyclic and at[2, "call", "q"].cyclic and not at[1, "call", "b"].cyclic
    assert at[3, "call", "turn-0"].linked and at[3, "result", "turn-0"].linked
    for r in out:
        parsed = json.loads(r.json)
        assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert chat.link_tool_calls(spark.createDataFrame([], MESSAGES)).count() == 0


def test_chat_ranks_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    rows = [(1, t, ("user", "assistant")[t % 2], f"m{t}") for t in range(11)]
    out = chat.link_tool_calls(spark.createDataFrame(rows, MESSAGES)).orderBy("seq").collect()
    assert [r.turn for r in out] == list(range(11))
    assert [r.call_id for r in out] == [f"turn-{t - t % 2}" for t in range(11)]


# Empty tables and clashing columns


OPERATORS = {
    "language": lambda d: language.identify_languages(d, language.Model.fit(d)),
    "quality": quality.judge,
    "lines": lines.dedup_lines,
    "decontamination": lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "a b")], "item_id long, text string")),
    "tokens": tokens.count_tokens,
    "mixing": mixing.mix_sources,
    "pii": pii.find_personal_data,
    "jaccard": jaccard.keep_one_of_each,
    "substrings": substrings.remove_repeated,
}
CLASHES = ("n_words", "score", "kept", "spans", "size", "copies", "removed_lines", "n_tokens", "languages", "c", "s", "n", "id", "u", "base_spans", "_k", "_p", "_i", "_t", "_s", "_h", "_w", "_l", "_u", "_source", "_spans", "rest_", "th")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_pass_or_are_replaced(docs, name):
    wide = docs.withColumns({c: F.lit("mine") for c in CLASHES})
    out = OPERATORS[name](wide)
    assert {"doc_id", "text", "lang", "source", "n_chars", "id", "c", "u", "_k", "_t", "_source", "rest_"} <= set(out.columns)
    assert len(out.columns) == len(set(out.columns))
    assert out.filter("id = 'mine' and c = 'mine' and u = 'mine' and _k = 'mine' and _t = 'mine' and _source = 'mine' and rest_ = 'mine'").count() == out.count() > 0


def test_keep_one_of_each(docs, plain):
    kept = [r.doc_id for r in jaccard.keep_one_of_each(docs).collect()]
    groups = brute_groups([(i, t) for i, t, *_ in plain])
    worded = {g for i, n, g in groups if n}
    assert sorted(k for k in kept if k in worded) == sorted(worded)
    assert sum(k is None or k in (100, 101, 102) for k in kept) == 4


def test_sources_are_split_by_rows_not_tasks(docs):
    assert got(tokens.token_counts(docs.repartition(5))) == got(tokens.token_counts(docs.coalesce(1)))
