"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

Events come from messages (conv_id, turn, role, text). An assistant text may
hold ``<tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>``
blocks; a ``tool`` message is a result, ``{"tool_call_id", "content"}``. In
plain dialogue every user message is a call of the ``reply`` tool and the
assistant message after it is its result.

Calls and results are hash-joined by (conversation, identifier), after each
side is reduced to one row for an identifier. An event may not come before the
call or result it depends on: its place is the greatest place among its own and
its predecessors'. Events with one place are ordered by level, the longest way
to them among these; cycles, and what depends on one, are flagged and have
level 0, so they stay in message order. All of this concerns only
conversations where some edge points forward. Those of at most ``LOCAL`` nodes
and edges are each settled in one row by array functions; larger ones by rounds
of joins, as many as their longest chain has steps. Positions within a
conversation are ranks within ranges of ``CHUNK`` turns plus the ranges' sizes,
so one conversation with a third of all rows is spread over its ranges.

Arguments are checked against each tool's schema on parsed values: unknown
tool, arguments that aren't an object, missing, unexpected and wrongly typed
ones. Canonical JSON has sorted keys, no spaces, and no null members.

Cases: a null text is no content; a null role is an ordinary message; malformed
blocks stay ordinary text; a repeated identifier links with all its results;
results without a call and calls without a result are kept, not linked; a null
conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.common import checkpointed

CHUNK = 1024
#: Nodes, and edges, of a conversation that is settled in one row.
LOCAL = 256


@dataclass(frozen=True)
class Tool:
    """A tool's arguments: (name, JSON type, required)."""

    name: str
    arguments: tuple[tuple[str, str, bool], ...]


REPLY = Tool("reply", (("prompt", "string", True),))
_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*",
    "object": "^OBJECT<.*",
}
_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"


def _before(conv: DataFrame, value: Column, name: str) -> DataFrame:
    """``conv`` (conv_id, turn, ...) with the largest ``value`` of an earlier turn, in ranges of turns."""
    chunk = F.floor(F.col("turn") / CHUNK)
    rows = conv.withColumns({"_c": chunk, "_v": value})
    parts = rows.groupBy("conv_id", "_c").agg(F.max("_v").alias("_m"))
    earlier = Window.partitionBy("conv_id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("_conv"), F.col("_c").alias("_chunk"), F.max("_m").over(earlier).alias("_carry"))
    met = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_c").eqNullSafe(F.col("_chunk")), "left")
    inside = Window.partitionBy("conv_id", "_c").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return met.withColumn(name, F.coalesce(F.max("_v").over(inside), F.col("_carry"))).drop("_c", "_v", "_conv", "_chunk", "_carry")


def events(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, ord, role, kind, call_id, tool, arguments, depends_on, content): all calls, results and messages."""
    own = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = _before(own, F.when(F.col("role") == "user", F.col("turn")), "_user")
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    blocks = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_BLOCK), 1), lambda b: F.get_json_object(b, "$.id").isNotNull() & F.get_json_object(b, "$.name").isNotNull())
    own = own.withColumn("_b", F.when(F.col("role") == "assistant", blocks).otherwise(F.array().cast("array<string>")))
    result_id = F.when(F.col("role") == "tool", F.get_json_object("text", "$.tool_call_id"))
    user, answer = F.col("role") == "user", (F.col("role") == "assistant") & F.col("_user").isNotNull() & (F.size("_b") == 0)
    content = F.when(result_id.isNotNull(), F.get_json_object("text", "$.content")).when(~user, F.when(F.size("_b") > 0, F.trim(F.regexp_replace("text", _BLOCK, ""))).otherwise(F.col("text")))
    base = own.select(
        "conv_id",
        "turn",
        F.lit(0).alias("ord"),
        "role",
        F.when(user, "call").when(answer | result_id.isNotNull(), "result").otherwise("message").alias("kind"),
        F.when(user, name(F.col("turn"))).when(answer, name(F.col("_user"))).otherwise(result_id).alias("call_id"),
        F.when(user, F.lit(REPLY.name)).alias("tool"),
        F.when(user, F.to_json(F.struct(F.col("text").alias("prompt")))).alias("arguments"),
        F.when(user & F.col("_user").isNotNull(), F.array(name(F.col("_user")))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        content.alias("content"),
    )
    calls = own.select("conv_id", "turn", "role", F.posexplode("_b").alias("_i", "_x"))
    calls = calls.select(
        "conv_id",
        "turn",
        (F.col("_i") + 1).alias("ord"),
        "role",
        F.lit("call").alias("kind"),
        F.get_json_object("_x", "$.id").alias("call_id"),
        F.get_json_object("_x", "$.name").alias("tool"),
        F.coalesce(F.get_json_object("_x", "$.arguments"), F.lit("{}")).alias("arguments"),
        F.coalesce(F.from_json(F.get_json_object("_x", "$.depends_on"), "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
        F.lit(None).cast("string").alias("content"),
    )
    return base.unionByName(calls)


def validate(tool: Column, arguments: Column, tools: tuple[Tool, ...]) -> Column:
    """Sorted problems of a call's arguments; empty for a valid call."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    problems = F.when(~tool.isin([t.name for t in tools]) | tool.isNull(), F.array(F.lit("unknown tool"))).when(value.isNull() | ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.array(F.lit("not an object")))
    for t in tools:
        found = []
        for arg, type_, required in t.arguments:
            part = F.schema_of_variant(F.try_variant_get(value, f"$.{arg}", "variant"))
            absent = part.isNull() | (part == "VOID")
            if required:
                found.append(F.when(absent, F.lit(f"missing {arg}")))
            found.append(F.when(~absent & ~part.rlike(_TYPES[type_]), F.lit(f"not {type_}: {arg}")))
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(a) for a, _, _ in t.arguments])), lambda k: F.concat(F.lit("unexpected "), k))
        problems = problems.when(tool == t.name, F.array_sort(F.concat(F.array_compact(F.array(*found)), extra)))
    return problems


def _places(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """(conv_id, node, place, level, cyclic) of nodes that don't stay at their own position; None if all do.

    ``nodes`` (conv_id, node, pos) and ``edges`` (conv_id, src, dst) are checkpointed.
    """
    at = lambda name, cols: nodes.select(F.col("conv_id").alias("_c"), F.col("node").alias(name), *cols)
    same = lambda name: F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col(name) == F.col(f"_{name}"))
    placed = edges.join(at("_src", [F.col("pos").alias("ps")]), same("src")).drop("_c", "_src").join(at("_dst", [F.col("pos").alias("pd")]), same("dst")).drop("_c", "_dst")
    forward = checkpointed(placed.filter("ps > pd").select("conv_id").distinct())
    if not forward.limit(1).count():
        return None
    within = lambda t, c: t.join(c.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    nodes, edges = checkpointed(within(nodes, forward)), checkpointed(within(edges, forward))
    sizes = nodes.select("conv_id", F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select("conv_id", F.lit(0).alias("n"), F.lit(1).alias("e")))
    large = checkpointed(sizes.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).filter((F.col("n") > LOCAL) | (F.col("e") > LOCAL)).select("conv_id"))
    if not large.limit(1).count():
        return _places_in_rows(nodes, edges)
    out_of = lambda t: t.join(large.select(F.col("conv_id").alias("_c")), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    return _places_in_rows(out_of(nodes), out_of(edges)).unionByName(_places_by_rounds(checkpointed(within(nodes, large)), checkpointed(within(edges, large))))


def _places_in_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``_places`` with one row for each conversation."""
    own = nodes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("v"))
    steps = edges.groupBy("conv_id").agg(F.collect_set(F.struct("src", "dst")).alias("e")).select(F.col("conv_id").alias("_c"), "e")
    met = own.join(steps, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", "v", F.coalesce("e", F.array().cast("array<struct<src:string,dst:string>>")).alias("e"))
    names = met.select("conv_id", "v", "e", F.col("v.node").alias("names"), F.size("v").alias("n"))
    at = lambda name: F.array_position("names", name).cast("int") - 1
    # Node numbers follow positions, so a place is the greatest number among a node's predecessors and its own.
    before = F.transform("names", lambda name: F.transform(F.filter("e", lambda x: (x["dst"] == name) & F.array_contains("names", x["src"])), lambda x: at(x["src"])))
    known = names.select("conv_id", "v", "n", before.alias("before"))
    rounds = F.sequence(F.lit(1), F.col("n"))
    numbers = F.sequence(F.lit(0), F.col("n") - 1)
    place = F.aggregate(rounds, numbers, lambda p, _: F.transform("before", lambda b, i: F.greatest(F.get(p, i), F.array_max(F.transform(b, lambda u: F.get(p, u))))))
    known = known.select("conv_id", "v", "n", "before", place.alias("place"))
    tied = F.transform("before", lambda b, i: F.filter(b, lambda u: F.get(F.col("place"), u) == F.get(F.col("place"), i)))
    known = known.select("conv_id", "v", "n", "place", tied.alias("before"))
    level = F.aggregate(rounds, F.transform("place", lambda _: F.lit(0)), lambda p, _: F.transform("before", lambda b: F.coalesce(F.array_max(F.transform(b, lambda u: F.get(p, u) + 1)), F.lit(0))))
    known = known.select("conv_id", "v", "n", "place", level.alias("level"))
    each = known.select("conv_id", "v", "n", F.posexplode(F.arrays_zip("place", "level")).alias("i", "x"))
    cyclic = F.col("x.level") >= F.col("n")
    at_i = F.get(F.col("v"), F.col("i"))
    return each.select("conv_id", at_i["node"].alias("node"), F.get(F.col("v"), F.col("x.place"))["pos"].alias("place"), F.when(cyclic, 0).otherwise(F.col("x.level")).alias("level"), cyclic.alias("cyclic"))


def _places_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``_places`` of conversations of any size."""
    same = lambda name: F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col(name) == F.col(f"_{name}"))
    state = nodes.select("conv_id", "node", F.col("pos").alias("place"))
    while True:
        src = state.select(F.col("conv_id").alias("_c"), F.col("node").alias("_src"), "place")
        best = edges.join(src, same("src")).groupBy("conv_id", "dst").agg(F.max("place").alias("best")).select(F.col("conv_id").alias("_c"), F.col("dst").alias("_node"), "best")
        new = checkpointed(state.join(best, same("node"), "left").select("conv_id", "node", F.greatest("place", "best").alias("place"), (F.coalesce(F.col("best") > F.col("place"), F.lit(False))).alias("moved")))
        state = new.select("conv_id", "node", "place")
        if not new.filter("moved").limit(1).count():
            break
    p = lambda name, col: state.select(F.col("conv_id").alias("_c"), F.col("node").alias(name), F.col("place").alias(col))
    tied = checkpointed(edges.join(p("_src", "ps"), same("src")).drop("_c", "_src").join(p("_dst", "pd"), same("dst")).filter("ps = pd").select("conv_id", "src", "dst"))
    levels, left, level = None, tied, 1
    while True:
        heads = left.select("conv_id", F.col("dst").alias("node")).distinct()
        free = checkpointed(left.select("conv_id", F.col("src").alias("node")).distinct().join(heads.select(F.col("conv_id").alias("_c"), F.col("node").alias("_node")), same("node"), "left_anti"))
        if not free.limit(1).count():
            break
        left = checkpointed(left.join(free.select(F.col("conv_id").alias("_c"), F.col("node").alias("_src")), same("src"), "left_anti"))
        below = tied.join(free.select(F.col("conv_id").alias("_c"), F.col("node").alias("_src")), same("src"), "left_semi").select("conv_id", F.col("dst").alias("node"), F.lit(level).alias("level"))
        levels = below if levels is None else levels.unionByName(below)
        level += 1
    cyclic = left.select("conv_id", F.col("src").alias("node")).unionByName(left.select("conv_id", F.col("dst").alias("node"))).distinct().withColumn("cyclic", F.lit(True))
    out = state
    if levels is not None:
        deepest = levels.groupBy("conv_id", "node").agg(F.max("level").alias("level")).select(F.col("conv_id").alias("_c"), F.col("node").alias("_node"), "level")
        out = out.join(deepest, same("node"), "left").select("conv_id", "node", "place", "level")
    else:
        out = out.withColumn("level", F.lit(None).cast("int"))
    cyclic = cyclic.select(F.col("conv_id").alias("_c"), F.col("node").alias("_node"), "cyclic")
    return out.join(cyclic, same("node"), "left").select("conv_id", "node", "place", F.when(F.col("cyclic"), 0).otherwise(F.coalesce("level", F.lit(0))).alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def link_tool_calls(messages: DataFrame, tools: tuple[Tool, ...] = (REPLY,)) -> DataFrame:
    """One row for each event: (conv_id, seq, turn, role, kind, call_id, depends_on, linked, cyclic, valid, errors, json)."""
    found = checkpointed(events(messages).withColumn("node", F.when(F.col("kind") == "call", F.concat(F.lit("c:"), "call_id")).when(F.col("kind") == "result", F.concat(F.lit("r:"), "call_id"))))
    pos = F.struct("turn", "ord")
    named = found.filter("node is not null")
    nodes = checkpointed(named.groupBy("conv_id", "node", "kind", "call_id").agg(F.min(pos).alias("pos")))
    calls = nodes.filter("kind = 'call'").select("conv_id", "call_id")
    results = nodes.filter("kind = 'result'").select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_id"))
    match = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_id"))
    linked = checkpointed(calls.join(results.hint("shuffle_hash"), match).select("conv_id", "call_id"))
    link = linked.select("conv_id", F.concat(F.lit("c:"), "call_id").alias("src"), F.concat(F.lit("r:"), "call_id").alias("dst"))
    wants = named.filter(F.size("depends_on") > 0).select("conv_id", F.col("node").alias("dst"), F.explode("depends_on").alias("call_id")).distinct()
    known = nodes.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_id")).agg(F.max("node").alias("src"))  # "r:" after "c:"
    needs = wants.join(known.hint("shuffle_hash"), match).select("conv_id", "src", "dst")
    places = _places(nodes.select("conv_id", "node", "pos"), checkpointed(link.unionByName(needs).filter("src <> dst")))
    out = found.withColumn("pos", pos)
    if places is None:
        out = out.withColumns({"place": F.col("pos"), "level": F.lit(0), "cyclic": F.lit(False)})
    else:
        places = places.select(F.col("conv_id").alias("_c"), F.col("node").alias("_node"), F.col("place").alias("_p"), "level", "cyclic")
        out = out.join(places, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_node")), "left").drop("_c", "_node")
        out = out.withColumns({"place": F.greatest("pos", "_p"), "level": F.coalesce("level", F.lit(0)), "cyclic": F.coalesce("cyclic", F.lit(False))}).drop("_p")
    mark = linked.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_id"), F.lit(True).alias("linked"))
    out = out.join(mark, match, "left").drop("_c", "_id").withColumn("linked", F.coalesce("linked", F.lit(False)))
    errors = F.when(F.col("kind") == "call", validate(F.col("tool"), F.col("arguments"), tools)).otherwise(F.array().cast("array<string>"))
    out = _ranked(out.withColumn("errors", errors))
    parsed = F.try_parse_json("arguments")
    json = F.to_json(
        F.struct(
            F.when(F.col("kind") == "call", parsed).alias("arguments"),
            F.col("call_id"),
            F.col("content"),
            F.when(F.size("depends_on") > 0, F.array_sort("depends_on")).alias("depends_on"),
            F.col("role"),
            F.col("tool"),
        )
    )
    return out.select("conv_id", "seq", "turn", "role", "kind", "call_id", F.array_join(F.array_sort("depends_on"), ",").alias("depends_on"), "linked", "cyclic", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"), json.alias("json"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``seq`` from 0 within each conversation, by place, level and position."""
    rows = checkpointed(rows.withColumn("_k", F.floor(F.col("place.turn") / CHUNK)))
    order = [F.col("place").asc_nulls_first(), "level", F.col("pos").asc_nulls_first(), F.xxhash64("role", "kind", "call_id", "content", "arguments")]
    sizes = rows.groupBy("conv_id", "_k").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("_k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("_k").alias("_j"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_k").eqNullSafe(F.col("_j")))
    return met.withColumn("seq", (F.col("_before") + F.row_number().over(Window.partitionBy("conv_id", "_k").orderBy(*order)) - 1).cast("long"))


ORACLE = """
WITH m AS (
  SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u
  FROM conversations
), e AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
         CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' AND u IS NOT NULL THEN 'result' ELSE 'message' END AS kind,
         CASE WHEN role = 'user' THEN 'turn-' || turn WHEN role = 'assistant' THEN 'turn-' || u END AS call_id,
         CASE WHEN role = 'user' AND u IS NOT NULL THEN 'turn-' || u END AS dep
  FROM m
), n AS (
  SELECT conv_id, call_id, count(DISTINCT kind) AS kinds FROM e WHERE call_id IS NOT NULL GROUP BY conv_id, call_id
)
SELECT e.conv_id, seq, turn, role, kind, call_id, coalesce(dep, '') AS depends_on, coalesce(kinds = 2, FALSE) AS linked, FALSE AS cyclic, TRUE AS valid, '' AS errors,
       '{' || CASE WHEN kind = 'call' THEN '"arguments":{"prompt":' || to_json(text) || '},' ELSE '' END
           || CASE WHEN call_id IS NOT NULL THEN '"call_id":' || to_json(call_id) || ',' ELSE '' END
           || CASE WHEN kind <> 'call' THEN '"content":' || to_json(text) || ',' ELSE '' END
           || CASE WHEN dep IS NOT NULL THEN '"depends_on":["' || dep || '"],' ELSE '' END
           || '"role":' || to_json(role) || CASE WHEN kind = 'call' THEN ',"tool":"reply"' ELSE '' END || '}' AS json
FROM e LEFT JOIN n USING (conv_id, call_id)
"""


LOOKUP = Tool("lookup", (("prompt", "string", True), ("turn", "integer", True)))


def as_tool_calls(messages: DataFrame) -> DataFrame:
    """Dialogue as tool use: a user message is a call that needs the next user message's, the answers to it are its results.

    So each conversation is a chain that points forward. Every fourth turn is written as a string, which the schema refuses.
    """
    turn = F.col("turn").cast("long")
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    user = F.when(F.col("role") == "user", turn)
    own = _before(messages.select("conv_id", turn.alias("turn"), "role", "text"), user, "_user").withColumn("_next", F.min(user).over(after))
    key = lambda t: F.concat(F.lit("k"), t.cast("string"))
    typed = F.when(F.col("turn") % 4 == 2, F.concat(F.lit('"'), F.col("turn"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    arguments = F.concat(F.lit('{"prompt":'), F.get(F.split(F.to_json(F.array(F.coalesce("text", F.lit("")))), "(?s)^\\[|\\]$"), F.lit(1)), F.lit(',"turn":'), typed, F.lit("}"))
    needs = F.coalesce(F.concat(F.lit(',"depends_on":["'), key(F.col("_next")), F.lit('"]')), F.lit(""))
    call = F.concat(F.lit('<tool_call>{"id":"'), key(F.col("turn")), F.lit('","name":"lookup","arguments":'), arguments, needs, F.lit("}</tool_call>"))
    answer = F.to_json(F.struct(key(F.col("_user")).alias("tool_call_id"), F.col("text").alias("content")))
    return own.select("conv_id", "turn", F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", answer).otherwise(F.col("text")).alias("text"))


def tool_call_chains(messages: DataFrame) -> DataFrame:
    found = link_tool_calls(as_tool_calls(messages), (LOOKUP,))
    return found.select("conv_id", "seq", "turn", "kind", "call_id", "depends_on", "linked", "cyclic", "valid", "errors")


CHAINS_ORACLE = """
WITH m AS (
  SELECT conv_id, turn, role,
         max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u,
         min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM conversations
), k AS (
  SELECT conv_id, turn AS k, nxt, (SELECT min(r.turn) FROM m r WHERE r.conv_id = m.conv_id AND r.role = 'assistant' AND r.u = m.turn) AS r
  FROM m WHERE role = 'user'
), c AS (
  SELECT *, last_value(k) OVER w AS lk, last_value(r) OVER w AS lr,
         sum(CASE WHEN r IS NULL THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), n AS (
  -- Where the last chain link stands, and the level of this one's call; the last link's own nodes are not counted, but for the one that all wait for.
  SELECT conv_id, k, nxt, r, coalesce(lr, lk) AS pt, CASE WHEN lr IS NULL THEN 1 ELSE 0 END AS po,
         CASE WHEN k = lk THEN 0 ELSE after - CASE WHEN lr IS NULL THEN 0 ELSE 1 END END AS level
  FROM c
), e AS (
  SELECT m.conv_id, turn, 0 AS ord, CASE WHEN role = 'assistant' AND u IS NOT NULL THEN 'result' ELSE 'message' END AS kind,
         CASE WHEN role = 'assistant' THEN u END AS id
  FROM m
  UNION ALL
  SELECT conv_id, turn, 1, 'call', turn FROM m WHERE role = 'user'
), p AS (
  SELECT e.*, n.nxt, n.r,
         CASE WHEN n.nxt IS NOT NULL THEN greatest(turn, pt) ELSE turn END AS p1,
         CASE WHEN n.nxt IS NOT NULL AND pt > turn THEN po ELSE ord END AS p2,
         CASE WHEN n.nxt IS NULL THEN 0 WHEN kind = 'call' THEN n.level WHEN kind = 'result' THEN n.level + 1 ELSE 0 END AS level
  FROM e LEFT JOIN n ON e.conv_id = n.conv_id AND e.id = n.k
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p1, p2, level, turn, ord) - 1 AS seq, turn, kind, 'k' || id AS call_id,
       CASE WHEN kind = 'call' AND nxt IS NOT NULL THEN 'k' || nxt ELSE '' END AS depends_on,
       (kind <> 'message' AND r IS NOT NULL) AS linked, FALSE AS cyclic,
       NOT (kind = 'call' AND turn % 4 = 2) AS valid, CASE WHEN kind = 'call' AND turn % 4 = 2 THEN 'not integer: turn' ELSE '' END AS errors
FROM p
"""
