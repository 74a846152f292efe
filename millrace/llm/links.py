"""Connected groups of linked items: candidates from shared signatures, and components by alternating stars.

Nothing here emits all pairs of a group or collects links: a bucket of items with one signature first compares every
member with one of them (a star); only buckets that the stars leave in more than one component compare members of
different components.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

#: Rounds of stars at most: they grow with the logarithm of the longest chain, so that more mean that something is wrong.
MAX_ROUNDS = 100
#: Rounds in which buckets are compared with one of their members, and members of a slice where the rest is compared in pairs.
STAR_ROUNDS, SLICE = 3, 1000
#: Signatures that several nodes have are sent to all tasks up to this many; more are joined.
MAX_SENT = 1_000_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    moved = down.join(low, F.col("a") == F.col("k"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> Table:
    """``node, label``: the smallest node of each component, for all nodes that have an edge ``a, b``.

    Alternating large and small stars; every round is written to the shared folder, and the rounds grow with the
    logarithm of the components' size.
    """
    now = Table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(now.df)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        larger = Table(_large_star(now.df), "edges")
        now.drop()
        now = Table(_small_star(larger.df), "edges")
        larger.drop()
        after = _digest(now.df)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {MAX_ROUNDS} rounds")
    out = Table(now.df.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.df.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct(), "components")
    now.drop()
    return out


def in_blocks(groups: DataFrame, weight: str, most: int, heaviest: int) -> DataFrame:
    """Rows of ``groups`` (``head, node, label`` and ``weight``) with ``i, j``: every two nodes of a head whose labels
    differ meet under some (head, i, j), and there are about ``2 * most`` rows, or a weight of ``2 * heaviest``, under
    each. Large labels have blocks of their own, which do not meet each other."""
    parts = lambda n, w: F.ceil(F.greatest(n / F.lit(most), w / F.lit(heaviest))).cast("int")
    sizes = groups.groupBy("head", "label").agg(F.count("*").alias("n"), F.sum(weight).alias("w")).withColumn("s", parts(F.col("n"), F.col("w")))
    large = (F.col("n") * 2 >= most) | (F.col("w") * 2 >= heaviest)
    small = lambda c: F.sum(F.when(~large, F.col(c)).otherwise(0))
    plans = sizes.groupBy(F.col("head").alias("h")).agg(parts(small("n"), small("w")).alias("pooled"), F.collect_list(F.when(large, F.struct("label", "s"))).alias("own"))
    # One entry a block: its label, or null for blocks of several labels.
    plans = Table(plans.select("h", "pooled", F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("pooled")), F.flatten(F.transform(
        "own", lambda x: F.array_repeat(x["label"], x["s"])))).alias("blocks")), "block-plans")
    rows = groups.join(plans.df, F.col("head") == F.col("h")).withColumn("at", F.array_position("blocks", F.col("label")).cast("int"))
    same = F.size(F.filter("blocks", lambda x: F.coalesce(x == F.col("label"), F.lit(False))))
    slot = F.pmod(F.xxhash64("node", F.lit(21)), F.when(F.col("at") > 0, same).otherwise(F.greatest("pooled", F.lit(1)))).cast("int")
    rows = rows.withColumn("_b", F.when(F.col("at") > 0, F.col("at") - 1 + slot).otherwise(slot))
    meets = F.filter(F.sequence(F.lit(0), F.size("blocks") - 1), lambda j: ~((F.col("at") > 0) & F.coalesce(F.get("blocks", j) == F.col("label"), F.lit(False))))
    rows = rows.withColumn("_m", F.explode(meets))
    return rows.select(*groups.columns, F.least("_b", "_m").alias("i"), F.greatest("_b", "_m").alias("j"))


def connect(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame]) -> Table:
    """``node, label`` of the graph of verified links among nodes that share a signature.

    ``rows``: ``sig, node`` (longs), evaluated once; ``verify``: given distinct pairs ``a, b`` of nodes, those that link.
    A bucket's members are verified against its head; the groups that these stars leave in several components are not
    spelled out as pairs: ``compare`` gets ``head, node, label`` (a bucket's head with all members of the buckets it heads)
    and returns links ``a, b`` that connect what is linked between components. Nodes without links are left out.
    """
    # One exchange and one sort of the rows: a bucket's head is the first of its rows.
    bucket = Window.partitionBy("sig").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stars = rows.withColumn("head", F.first("node").over(bucket)).filter("node <> head")
    stars = Table(stars.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "star-pairs")
    linked = Table(verify(stars.df).select("a", "b"), "star-links")
    labels = components(linked.df)
    both = stars.df.select(F.col("a").alias("head"), F.col("b").alias("node")).union(stars.df.select("a", "a").distinct())
    own = Table(both.join(labels.df.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select(
        "head", "node", F.coalesce("label", "node").alias("label")), "labelled-members")
    mixed = Table(own.df.groupBy(F.col("head").alias("h")).agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("h"), "mixed-heads")
    if mixed.df.limit(1).count():
        extra = Table(compare(own.df.join(mixed.df, F.col("head") == F.col("h"), "left_semi")).select("a", "b"), "mixed-links")
        labels.drop()
        labels = components(linked.df.union(extra.df))
        extra.drop()
    for t in (stars, linked, own, mixed):
        t.drop()
    return labels


def more_components(labels: Table, edges: DataFrame) -> Table:
    """The components ``labels`` (``node, label``) after further edges ``a, b``: only the graph of the labels is gone through."""
    label = lambda k: labels.df.select(F.col("node").alias(f"n{k}"), F.col("label").alias(f"l{k}"))
    between = edges.join(label("a"), F.col("a") == F.col("na"), "left").join(label("b"), F.col("b") == F.col("nb"), "left").select(
        "a", "b", F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    between = Table(between, "label-edges")
    joined = components(between.df.select(F.col("x").alias("a"), F.col("y").alias("b")))
    every = labels.df.union(between.df.select("a", "x")).union(between.df.select("b", "y")).distinct()
    out = Table(every.join(joined.df.select(F.col("node").alias("k"), F.col("label").alias("to")), F.col("label") == F.col("k"), "left").select(
        "node", F.coalesce("to", "label").alias("label")), "components")
    for t in (labels, between, joined):
        t.drop()
    return out


def meetings(placed: DataFrame, possible: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs ``a, b`` with sizes ``na, nb``, once each, of nodes of different labels that share a bucket and may link.
    ``placed``: ``sig, node, label, c`` (size of the bucket), ``at`` and ``sigs``, all buckets of the node. Two nodes meet only
    in the first bucket that they share: if their places there rule a link out, it is ruled out."""
    slices = F.ceil(F.col("c") / F.lit(SLICE)).cast("int")
    left = placed.select("sig", F.col("node").alias("a"), F.col("label").alias("la"), F.pmod(F.xxhash64("node", F.lit(8)), slices).cast("int").alias("i"), F.col("at").alias("xa"), F.col("sigs").alias("sa"))
    right = placed.select(F.col("sig").alias("sr"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("at").alias("xb"), F.col("sigs").alias("sb"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("j"))
    pairs = left.join(right, (F.col("sig") == F.col("sr")) & (F.col("i") == F.col("j")) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
        & possible(F.col("xa"), F.col("xb")) & (F.array_min(F.array_intersect("sa", "sb")) == F.col("sig")))
    return pairs.select("a", "b", F.col("xa.size").alias("na"), F.col("xb.size").alias("nb"))


def connect_stars(rows: DataFrame, verifier: Callable[[DataFrame], tuple[Callable, Callable, Callable]]) -> Table:
    """``node, label`` of the graph of verified links among nodes that share a signature, JVM-side only.

    ``rows``: ``sig, node`` (longs), as often as the node occurs; ``verifier``: given the buckets' members (``sig, node``),
    returns what tells, of distinct pairs ``a, b`` of their nodes (with sizes ``na, nb`` where they are known) and of whether
    but few of them are expected to link, those that link;
    what adds ``at``, the ``size`` and place of a node as seen from its bucket's ``head``; and whether nodes at two such places can link at all. Buckets compare all members with
    their most frequent one, which most near copies are close to; that one leaves the bucket, and the next round does the
    same wherever members are still in different components. A round costs as many pairs as the buckets have members.
    What STAR_ROUNDS leave over is compared pair by pair between components, in slices of a bucket, so all pairs are
    verified but those already connected and those whose places rule a link out.
    """
    shared = Table(rows.groupBy(F.col("sig").alias("s")).agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("s"), "shared-signatures")
    few = shared.df.limit(MAX_SENT + 1).count() <= MAX_SENT
    own = rows.join(F.broadcast(shared.df) if few else shared.df, F.col("sig") == F.col("s"), "left_semi").groupBy("sig", "node").agg(F.count("*").alias("n"))
    own = Table(own.withColumn("label", F.col("node")), "bucket-members")
    shared.drop()
    first = own
    verify, place, possible = verifier(first.df.select("sig", "node"))
    tried: list[Table] = []
    labels: Table | None = None
    for turn in range(STAR_ROUNDS + 1):
        last = turn == STAR_ROUNDS
        # The most frequent, ties by id: one number that orders the members of a bucket.
        order = F.shiftleft(F.least(F.col("n"), F.lit((1 << 20) - 1)), 43) + F.col("node").bitwiseAND((1 << 43) - 1)
        heads = own.df.groupBy(F.col("sig").alias("s")).agg(
            F.max_by("node", order).alias("head"), F.max_by("label", order).alias("home"), F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c"))
        heads = Table(heads.filter("x <> y").select("s", "head", "home", "c"), "bucket-heads")
        if not heads.df.limit(1).count():
            heads.drop()
            break
        mixed = own.df.join(heads.df, F.col("sig") == F.col("s"))
        if last:
            buckets = mixed.groupBy(F.col("node").alias("_node")).agg(F.collect_set("sig").alias("sigs"))
            placed = place(mixed.select("sig", "node", "label", "head", "c")).join(buckets, F.col("node") == F.col("_node")).drop("_node")
            placed = Table(placed, "placed-members")
            pairs = meetings(placed.df, possible)
        else:
            pairs = mixed.filter("label <> home").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.union, [t.df.select("a", "b") for t in tried]), ["a", "b"], "left_anti")
        tried.append(Table(pairs, "star-pairs"))
        linked = Table(verify(tried[-1].df, turn > 0), "star-links")
        labels = components(linked.df) if labels is None else more_components(labels, linked.df)
        linked.drop()
        if not last:
            rest = mixed.filter("node <> head").select("sig", "node", "n").join(labels.df.select(F.col("node").alias("k"), "label"), F.col("node") == F.col("k"), "left").select(
                "sig", "node", "n", F.coalesce("label", "node").alias("label"))
            new = Table(rest, "bucket-members")
            if own is not first:
                own.drop()
            own = new
        heads.drop()
        if last:
            placed.drop()
    for t in (first, own, *tried):
        t.drop()
    return labels if labels is not None else components(rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
