"""Links within buckets and connected components of links, by DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) from (a, b): the least node of each one's component; nodes without links are absent.

    In a round each node goes to the first of itself and its neighbours, in an order that hashes deal anew each time, and links become those between
    the nodes gone to. The nodes left are three quarters at most on average, whatever the links' form: long chains shrink as stars do, and what many nodes have
    with the same few centres is a link or two in the next round. It ends when no links are left; tables go through the shared folder.
    """
    pairs = materialize(links.where("a <> b").select(*ordered("a", "b")).distinct(), "pairs")
    held, steps = [pairs], []
    while pairs.limit(1).count():
        if len(steps) == rounds:
            raise RuntimeError(f"components are not done after {rounds} rounds")
        place = lambda c, k=len(steps): F.struct(F.xxhash64(F.lit(k), c), F.col(c).alias("node"))
        both = pairs.select(F.col("a").alias("from"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("from"), F.col("a").alias("to")))
        gone = materialize(both.groupBy(F.col("from").alias("node")).agg(F.least(F.min(place("to")), place("from"))["node"].alias("to")), "gone")
        half = pairs.join(gone.select(F.col("node").alias("a"), F.col("to").alias("p")), "a").select("b", "p").distinct()
        whole = half.join(gone.select(F.col("node").alias("b"), F.col("to").alias("q")), "b")
        pairs = materialize(whole.where("p <> q").select(*ordered("p", "q")).distinct(), "pairs")
        steps.append(gone)
        held += [gone, pairs]
    last = steps.pop() if steps else pairs.select(F.col("a").alias("node"), F.col("b").alias("to"))
    for gone in reversed(steps):
        further = last.select(F.col("node").alias("to"), F.col("to").alias("end"))
        last = gone.join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ends = materialize(last, "ends")
    labels = materialize(ends.join(ends.groupBy("to").agg(F.min("node").alias("label")), "to").select("node", "label"), "labels")
    for df in (*held, ends):
        remove(df)
    return labels


def star_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sieve: Callable[[str, str], Column], slots: int = 4) -> DataFrame | None:
    """(a, b), a before b, of verified links among ``members``: distinct rows (bucket, node, rank, ...).

    A bucket's members are compared with its pivots first: the greatest in rank of each of ``slots`` parts at first, of eight times
    as many in each further round, among the members that no pivot has linked. What then shares a bucket without being of one
    component is compared pair by pair (``bridges``), so the links connect all that the links of all pairs would.
    ``sieve`` is a condition on the other columns of a member ("m.") and a pivot ("p.")
    that a link can't fail; ``verify`` turns (a, b) into (a, b, near).
    """
    others = [c for c in members.columns if c not in ("bucket", "node", "rank")]
    active, tested, found, held = members, None, None, []
    while active.limit(1).count():
        best = F.max(F.struct("rank", "node", *others)).alias("p")
        pivots = active.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(slots)).alias("slot")).agg(best).select("bucket", "p").alias("q")
        joined = active.alias("m").join(pivots, (F.col("m.bucket") == F.col("q.bucket")) & (F.col("m.node") != F.col("q.p.node")) & sieve("m.", "q.p."))
        met = materialize(joined.select("m.bucket", "m.node", *ordered("m.node", "q.p.node")), "met")
        pairs = met.select("a", "b").distinct()
        new = pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        result = materialize(verify(new), "verified")
        tested = result if tested is None else tested.unionByName(result)
        good = result.where("near").select("a", "b")
        found = good if found is None else found.unionByName(good)
        linked = met.join(found, ["a", "b"]).select("bucket", "node")
        # on go those that are no pivot and that no pivot of their bucket has linked
        settled = pivots.select("bucket", F.col("p.node").alias("node")).unionByName(linked)
        rest = materialize(active.select("bucket", "node").join(settled, ["bucket", "node"], "left_anti"), "rest")
        later = materialize(active.join(in_shared_buckets(rest), ["bucket", "node"]), "active")
        # of a round only what was verified is needed further on
        for df in (met, rest, *([] if active is members else [active])):
            remove(df)
        active = later
        held.append(result)
        slots *= 8
    if found is None:
        return None
    more = bridges(members, found, tested, verify, sieve)
    links = materialize(found.unionByName(more), "links")
    for df in (*held, active, more):
        remove(df)
    return links


def ordered(m: str, q: str) -> list[Column]:
    return [F.least(m, q).alias("a"), F.greatest(m, q).alias("b")]


def bridges(members: DataFrame, links: DataFrame, tested: DataFrame, verify: Callable[[DataFrame], DataFrame], sieve: Callable[[str, str], Column]) -> DataFrame:
    """(a, b) of verified links between components: of all pairs that share a bucket, pass the sieve and are not tested yet.

    In each bucket, members outside its largest component meet all of other components; those of the largest don't meet each other.
    A bucket in which no two are of one component is done: members leave the rounds only as pivots, compared with all that were left, or as linked to one.
    """
    labels = components(links)
    # without what the sieve asks for, which is added to the members that are left
    known = materialize(members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "known")
    kinds = known.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket")
    largest = kinds.agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1 and top.n > 1")
    chosen = known.join(largest.select("bucket", F.col("top.label").alias("top")), "bucket")
    apart = materialize(members.drop("rank").join(chosen, ["bucket", "node"]), "apart")
    remove(known)
    outside = apart.where(F.col("label") != F.col("top")).alias("m")
    joined = outside.join(apart.alias("q"), (F.col("m.bucket") == F.col("q.bucket")) & (F.col("m.label") != F.col("q.label")) & sieve("m.", "q."))
    pairs = joined.select(*ordered("m.node", "q.node")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    found = materialize(verify(pairs), "bridges")
    remove(labels)
    remove(apart)
    return found.where("near").select("a", "b")


def in_shared_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that have two at least. Members are distinct."""
    several = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return members.join(several, "bucket")
