"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Among all document rates within [0, cap] that give every source its target of words, the most even ones (of
least relative entropy to a rate of 1) are exponentially tilted: rate = min(cap, exp(lambda * size / scale)), one
lambda a source, the solution of a convex dual. Newton steps find the lambdas; each step is one aggregation of
the table (source, size) -> documents, which is far smaller than the corpus, so that no source is too hot.
Rates then become whole copies: documents are dealt by a hash of their id into groups of bounded size within
their source, ordered by size, and a running sum of rates is rounded, so that every group meets its own share;
what is still missing or too much goes to the group's smallest documents and to single ones or pairs whose sizes come nearest to the rest.

Targets: sources in code-point order, null last, have the weights in turn; a source's target stops at ``cap``
times its size and the rest is shared anew by weight until none is above.

Sums of rates are kept in whole micro-units and ties have an order, so reruns agree.

Defined cases: null text has size 0; a document of size 0 is taken 0 words; repeated rows count each (their
order is by id, then text's hash; equal rows are interchangeable); an empty table gives an empty result; a corpus of
empty texts has targets 0. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Config:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    #: Words of the mix as a share of all words.
    share: float = 1.5
    #: Rates and targets stop at this many times a document's and a source's size.
    cap: int = 2
    steps: int = 60
    tolerance: float = 1e-7
    #: Documents that one rounding group of a source holds, about; a source has as many groups as that takes.
    group: int = 1024
    #: Single documents, or pairs, that a group moves at most, after the smallest ones, to come nearer to its share.
    corrections: int = 2


MICRO = 1_000_000
#: Tables of a row a source are broadcast up to so many sources; beyond, they are joined by shuffle.
MOST_BROADCAST = 200_000


def few(df: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(df) if sources <= MOST_BROADCAST else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, config: Config = Config()) -> DataFrame:
    """(source, source_size, docs, target) from (source, source_size, docs): a row a source.

    The windows hold a row a source (a name and a few numbers) in one task: a million sources take some 100 MB.
    Filling up to the caps has a closed form: with sources in the order of cap room per weight, the full ones are a
    prefix; the level is what is left over the weights that are left, at the first source that is not full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source, pre-aggregated
    weights = F.array(*map(F.lit, config.weights))
    ranked = sources.withColumn("weight", F.element_at(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(config.weights))).cast("int") + 1))
    ranked = ranked.withColumn("room", F.lit(float(config.cap)) * F.col("source_size"))
    up = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("goal", F.lit(config.share) * F.sum("source_size").over(whole))
        .withColumn("before", F.sum("room").over(up) - F.col("room"))
        .withColumn("left", F.sum("weight").over(whole) - F.sum("weight").over(up) + F.col("weight"))
        .withColumn("level", (F.col("goal") - F.col("before")) / F.col("left"))
        .withColumn("open", F.col("room") > F.col("level") * F.col("weight"))
        .withColumn("water", F.min(F.when(F.col("open"), F.struct(F.row_number().over(up).alias("rank"), F.col("level").alias("level")))).over(whole)["level"])
    )
    return filled.select("source", "source_size", "docs", F.least(F.col("room"), F.coalesce(F.col("water") * F.col("weight"), F.col("room"))).alias("target"))


def tilts(histogram: DataFrame, goals: DataFrame, sources: int, config: Config = Config()) -> DataFrame:
    """(source, tilt, scale): the dual's solution. ``histogram``: (source, size, docs), ``goals``: as from ``targets``.

    A source whose target is all its room has a tilt of null: every rate is the cap.
    """
    # a row a source
    state = goals.select(
        "source", "target", (F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))).alias("scale"),
        (F.col("target") >= F.lit(config.cap * (1 - 1e-12)) * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"),
    )
    for _ in range(config.steps):
        rate = F.least(F.lit(float(config.cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))))
        x = F.col("size") / F.col("scale")
        at = histogram.where("size > 0").join(few(state.select(F.col("source").alias("s"), "tilt", "scale"), sources), F.col("source").eqNullSafe(F.col("s")))
        # whole micro-units: sums don't depend on their order
        micro = lambda c: F.sum(F.round(c * MICRO).cast("decimal(38,0)"))
        sums = at.groupBy("s").agg(micro(F.col("docs") * rate * F.col("size")).alias("got"), micro(F.when(rate < config.cap, F.col("docs") * rate * x * F.col("size"))).alias("slope"))
        now = state.join(few(sums, sources), F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.coalesce(F.col("got").cast("double") / MICRO, F.lit(0.0)) - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        slope = F.coalesce(F.col("slope").cast("double") / MICRO, F.lit(0.0))
        newton = F.col("tilt") - F.when(slope > 0, gap / slope).otherwise(F.signum(gap))
        # steps of at most 1, or the tilt's own size, that stay between the bounds found so far
        reach = F.greatest(F.lit(1.0), F.abs(F.col("tilt")))
        newton = F.greatest(F.least(newton, F.col("tilt") + reach), F.col("tilt") - reach)
        safe = F.when((newton <= low) | (newton >= high), (low + high) / 2).otherwise(newton)
        still = F.col("full") | F.col("done") | (F.abs(gap) <= F.lit(config.tolerance) * F.greatest(F.col("target"), F.lit(1.0)))
        rows = now.select("source", "target", "scale", "full", F.when(still, F.col("tilt")).otherwise(safe).alias("tilt"), low.alias("low"), high.alias("high"), still.alias("done"))
        state = rows.coalesce(1).checkpoint()
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
    return state.select("source", F.when(~F.col("full"), F.col("tilt")).alias("tilt"), "scale")


def mix(docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """(key, size, source_size, target, rate, copies, taken) of every document; with ``carry`` also its own columns, as a struct ``row``."""
    spark = docs.sparkSession
    shared_dir(spark)
    own = [F.struct(*docs.columns).alias("row")] if carry else []
    # texts are read once: from here on a row is a few numbers, unless rows are carried
    sized = materialize(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("content"), *own), "sizes")
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs"))
    goals = targets(per_source, config).coalesce(1).checkpoint()
    sources = goals.count()
    found = tilts(histogram, goals, sources, config)

    # a source's own number of documents decides how many groups it has: one rounds well only with many documents in it
    groups = F.greatest(F.lit(1), F.floor(F.col("docs") / config.group)).cast("long")
    params = goals.select(F.col("source").alias("s"), "source_size", "target", groups.alias("groups")).join(few(found.withColumnRenamed("source", "s2"), sources), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    rated = sized.join(few(params, sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cap = F.lit(config.cap * MICRO).cast("long")
    # the cap comes before whole numbers: a steep tilt's exp of a long document is far beyond a long
    rate = F.least(F.lit(float(config.cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(700.0))))
    exact = F.when(F.col("tilt").isNull(), cap).otherwise(F.round(rate * MICRO).cast("long"))
    dealt = rated.withColumn("units", F.when(F.col("size") > 0, exact).otherwise(F.lit(0).cast("long"))).withColumn("deal", F.pmod(F.xxhash64(F.col("id"), F.col("content"), F.lit(10)), F.col("groups")))

    group = Window.partitionBy("source", "deal")
    up = group.orderBy("size", F.xxhash64("id"), "id", "content")
    # a source's group of documents: at most a few times config.group, however hot the source
    running = F.sum("units").over(up.rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64("source", "deal"), F.lit(MICRO))
    rounded = dealt.withColumn("sum", running + start).withColumn("copies", F.floor(F.col("sum") / MICRO) - F.floor((F.col("sum") - F.col("units")) / MICRO))
    rounded = rounded.withColumn("owed", F.expr("units * size div 1000")).withColumn("owed", F.round(F.sum("owed").over(group) / 1000).cast("long") - F.sum(F.col("copies") * F.col("size")).over(group))
    # the smallest documents make up for what rounding has left over, then those whose size comes nearest to what is still left
    movable = F.when((F.col("size") > 0) & F.when(F.col("owed") > 0, F.col("copies") < config.cap).otherwise(F.col("copies") > 0), F.col("size")).otherwise(F.lit(0))
    moved = rounded.withColumn("room", movable).withColumn("reach", F.sum("room").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.when((F.col("room") > 0) & (F.col("reach") <= F.abs(F.col("owed"))), F.signum(F.col("owed")).cast("long")).otherwise(F.lit(0))
    out = moved.withColumn("step", step).withColumn("copies", F.col("copies") + F.col("step")).withColumn("owed", F.col("owed") - F.sum(F.col("step") * F.col("size")).over(group))
    out = out.withColumn("place", F.row_number().over(up))
    for _ in range(config.corrections):
        out = out.withColumn("best", F.min(F.least(*corrections(up, config.cap))).over(group))
        better = F.col("best.left") < F.abs(F.col("owed"))
        step = F.when(better & (F.col("best.place") == F.col("place")), F.col("best.step")).when(better & (F.col("best.other") == F.col("place")), -F.col("best.step"))
        out = out.withColumn("step", F.coalesce(step, F.lit(0)))
        out = out.withColumn("copies", F.col("copies") + F.col("step")).withColumn("owed", F.col("owed") - F.sum(F.col("step") * F.col("size")).over(group))
    out = out.withColumn("copies", F.col("copies").cast("long"))
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("units") / MICRO).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def corrections(up, cap: int) -> list[Column]:
    """What a document can do for its group: a copy more, a copy less, or one against one of a document up to three places before.

    (left, place, other, step): what would be left over, the document's place, the other's (-1: none), and what its copies change by.
    """
    place, size = F.col("place"), F.col("size")
    more, less = (size > 0) & (F.col("copies") < cap), (size > 0) & (F.col("copies") > 0)
    out = []
    for step, can, other_can in ((1, more, less), (-1, less, more)):
        left = F.col("owed") - step * size
        out.append(F.when(can, F.struct(F.abs(left).alias("left"), place, F.lit(-1).alias("other"), F.lit(step).alias("step"))))
        for k in (1, 2, 3):
            both = can & F.lag(other_can, k).over(up)
            out.append(F.when(both, F.struct(F.abs(left + step * F.lag(size, k).over(up)).alias("left"), place, (place - k).alias("other"), F.lit(step).alias("step"))))
    return out


def mixed(docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document's own columns, as often as the mix takes it."""
    rows = mix(docs, config, key, text, source, carry=True).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
