"""Mixing sources to target weights by entropy balancing.

Each source has a token constraint: the words its documents contribute have to
reach its target. Among all document rates between 0 and ``MOST`` copies that
meet the constraints, the ones closest in entropy to an even rate are
exponentially tilted: rate = MOST * e / (1 + e) with e = exp(dual * tilt), where
tilt is the document's size against its source's mean. The convex dual is solved
by Newton steps, each one aggregation over (source, size) counts that gives
every source its gradient and curvature; steps outside the bracket of known
signs are halved into it, so each source converges however skewed its sizes.

Rates become copies: the whole part, and one more where the fraction beats a
hash of the row by more than its source's threshold. The threshold is found by
refining (source, bin) sums three times, ten bits at a time, so a source with a
third of all rows is never in one task; what then is missing from the target is
closed by the single copies whose sizes fit best.

Cases: a null or wordless text has size 0 and is never taken; a null source is
a source of its own, sorted last; a source of size 0 has target 0; rows equal
in doc_id, text and source share hash and copies; an empty table gives an empty
mix. Reruns agree: all that is random is a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.common import NOT_SPACE, checkpointed, quoted, sheltered, without

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Newton steps after which the solution is given up with an error; a step outside the bracket halves it, so a few dozen do.
NEWTON = 200
#: Tables with a row for each source are broadcast up to so many rows; more sources meet by shuffles.
BROADCAST_SOURCES = 100_000
#: Newton steps end when every source is so near its target; rounding closes the rest.
TOLERANCE = 1e-3
CLOSING = 2
#: Parts of a source that bins are summed in first, so that no task has a hot source alone.
BITS = 10
RESULT = ("size", "source_size", "target", "copies", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): a row for each source.

    Sources fill up in proportion to their weights until they reach ``most``
    times their size; those that reach it first are the ones with the least
    room for their weight, so one running sum in that order settles all rounds
    of resharing at once.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # A source is full if even the level that is left when it comes up would overfill it.
    leveled = named.withColumn("_level", level).withColumn("_full", F.col("cap") <= F.col("_level") * F.col("w"))
    final = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    first_open = F.min(F.when(~F.col("_full"), F.struct(F.col("cap") / F.col("w"), F.col("_level").alias("level")))).over(everything)["level"]
    return leveled.withColumn("_open", F.coalesce(first_open, final)).select("source", "source_size", F.when(F.col("_full") | F.col("_open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("_open") * F.col("w"))).alias("target"))


def rate(dual: Column, tilt: Column) -> Column:
    """Copies for each document, between 0 and ``MOST``."""
    return MOST / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), dual * tilt))))


def by_source(df: DataFrame, sources: int) -> DataFrame:
    """A side with a row for each source."""
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def solve(groups: DataFrame, goals: DataFrame, sources: int) -> DataFrame:
    """``goals`` with ``dual``: Newton steps on the dual of each source, all sources at once.

    ``groups`` (source, size, n) counts the documents; ``goals`` has source,
    source_size, mean_size and target.
    """
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    # Start where a source of equal sizes would end; a full source has no finite dual.
    share = F.col("target") / (MOST * F.greatest(F.col("source_size"), F.lit(1)))
    start = F.when(share >= 1 - 1e-9, F.lit(1e6)).when(share <= 0, F.lit(-1e6)).otherwise(F.log(share / (1 - share)))
    state = checkpointed(goals.select("source", "source_size", "mean_size", "target", start.alias("dual"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")))
    for _ in range(NEWTON):
        tilt = F.col("size") / F.col("mean_size")
        r = rate(F.col("dual"), tilt)
        met = groups.alias("g").join(by_source(state.alias("s"), sources), same)
        slope = F.sum(F.col("n") * F.col("size") * tilt * r * (1 - r / MOST))
        step = met.groupBy(F.col("s.source").alias("source")).agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), slope.alias("slope"))
        new = state.alias("s").join(by_source(step.alias("g"), sources), same, "left").select("s.*", (F.coalesce("g.got", F.lit(0.0)) - F.col("s.target")).alias("off"), F.coalesce("g.slope", F.lit(0.0)).alias("slope"))
        low = F.when(F.col("off") < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(F.col("off") > 0, F.col("dual")).otherwise(F.col("high"))
        new = new.withColumns({"low": low, "high": high, "newton": F.col("dual") - F.try_divide("off", "slope")})
        inside = (F.col("slope") > 0) & (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        # Outside the bracket: double away from 0 while a side is open, else halve.
        spread = F.when(F.col("high") >= 1e6, F.greatest(F.lit(1.0), 2 * F.col("low"))).when(F.col("low") <= -1e6, F.least(F.lit(-1.0), 2 * F.col("high"))).otherwise((F.col("low") + F.col("high")) / 2)
        done = (F.abs("off") <= TOLERANCE * F.col("target")) | (F.abs("dual") > 1e5)
        state = checkpointed(new.select("source", "source_size", "mean_size", "target", F.when(done, F.col("dual")).when(inside, F.col("newton")).otherwise(spread).alias("dual"), "low", "high", done.alias("done")))
        if not state.filter("not done").limit(1).count():
            return state.select("source", "source_size", "mean_size", "target", "dual")
    raise RuntimeError(f"the dual did not converge in {NEWTON} steps")



@sheltered("doc_id", "text", "source")
def mix_sources(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies * size)."""
    docs = without(docs, RESULT)
    own = docs.columns
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(7)), 1)
    if set(own) <= {"doc_id", "text", "source"}:  # no wide columns: the slim rows are the result
        slim = checkpointed(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw.alias("u")))
        return copies(slim).select("doc_id", "source", *RESULT)
    named = docs.withColumns({"size": n_words(F.col("text")), "_u": draw})
    slim = checkpointed(named.select("doc_id", "source", "size", F.col("_u").alias("u")))
    found = copies(slim).select("source", "u", "size", "source_size", "target", "copies", "taken").distinct()
    found = found.select(*[F.col(c).alias(f"_{c}") for c in found.columns])
    same = (F.col("_u_") == F.col("_u")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    joined = named.withColumnRenamed("_u", "_u_").join(found, same, "left")
    return joined.select(*[quoted(c) for c in own], "size", *[F.col(f"_{c}").alias(c) for c in RESULT[1:]])


def copies(slim: DataFrame) -> DataFrame:
    """(doc_id, source, size, u) with the columns of the mix; ``slim`` is checkpointed, u a hash of the row."""
    groups = checkpointed(slim.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    everything = checkpointed(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = everything.count()
    sized = groups.groupBy("source").agg(F.sum("n").alias("worded"))
    goals = targets(everything.select("source", "source_size"))
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    goals = goals.alias("g").join(sized.alias("s"), same, "left").select("g.*", (F.col("source_size") / F.coalesce("worded", F.lit(1))).alias("mean_size"))
    duals = solve(groups, goals.withColumn("mean_size", F.greatest("mean_size", F.lit(1.0))), sources)
    # Order within a source: by how much the rate's fraction beats the row's hash; 30 bits, highest first.
    s = by_source(duals.alias("s"), sources)
    r = rate(F.col("dual"), F.col("size") / F.col("mean_size"))
    rated = slim.alias("g").join(s, same).select("g.*", "source_size", "target", r.alias("rate"))
    rated = rated.withColumn("whole", F.least(F.floor("rate"), F.lit(MOST - 1)))
    ahead = (F.col("rate") - F.col("whole") - F.col("u") / F.lit(float(1 << 63)) + 1) / 2
    top = 1 << (3 * BITS)
    placed = checkpointed(rated.withColumn("rank", (F.lit(top - 1) - F.least(F.lit(top - 1), F.floor(ahead * top))).cast("long")))
    limit = placed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("base"))
    limit = checkpointed(limit.select("source", (F.col("target") - F.col("base")).alias("room"), F.lit(0).cast("long").alias("prefix")))
    for level in range(3):
        shift = BITS * (2 - level)
        bins = placed.alias("g").join(by_source(limit.alias("s"), sources), same & (F.shiftright("rank", shift + BITS) == F.col("s.prefix")))
        sums = bins.groupBy(F.col("g.source").alias("source"), F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bin")
        summed = sums.withColumn("after", F.sum("words").over(running)).alias("g").join(by_source(limit.alias("s"), sources), same)
        fits = F.col("after") <= F.col("room")
        new = summed.groupBy(F.col("g.source").alias("source")).agg(F.max(F.when(fits, F.col("after"))).alias("used"), F.min(F.when(~fits, F.col("bin"))).alias("next"), F.max("bin").alias("last"))
        limit = checkpointed(limit.alias("g").join(by_source(new.alias("s"), sources), same, "left").select(F.col("g.source").alias("source"), (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), F.coalesce("next", F.col("last") + 1, F.shiftleft("prefix", BITS)).cast("long").alias("prefix")))
    # Ranks below the limit get one copy more.
    met = placed.alias("g").join(by_source(limit.alias("s"), sources), same)
    out = checkpointed(met.select("doc_id", F.col("g.source").alias("source"), "size", "u", "source_size", "target", (F.col("whole") + (F.col("rank") < F.col("prefix")).cast("long")).alias("copies")))
    for _ in range(CLOSING):
        out = _closer(out, sources)
    return out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))


def _closer(out: DataFrame, sources: int) -> DataFrame:
    """One copy of one document more or less in each source, if that brings it nearer to its target."""
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    gap = out.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    met = out.filter("size > 0").alias("g").join(by_source(gap.alias("s"), sources), same).select("g.*", "gap")
    met = met.filter(F.when(F.col("gap") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0))
    left = F.abs(F.abs("gap") - F.col("size"))
    best = met.filter(left < F.abs("gap")).groupBy("source").agg(F.min(F.struct(left.alias("left"), "u", F.when(F.col("gap") > 0, 1).otherwise(-1).alias("more"), "size")).alias("b"))
    chosen = by_source(best.select("source", F.col("b.u").alias("bu"), F.col("b.size").alias("bs"), F.col("b.more").alias("more")).alias("s"), sources)
    hit = same & (F.col("g.u") == F.col("s.bu")) & (F.col("g.size") == F.col("s.bs"))
    return checkpointed(out.alias("g").join(chosen, hit, "left").select("doc_id", F.col("g.source").alias("source"), "g.size", "u", "source_size", "target", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies")))


def mix_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``op7``."""
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
