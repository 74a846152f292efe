"""Mixing sources to target weights by entropy balancing.

Every document gets a rate exp(sum of multipliers of its features), the rates nearest to 1 in relative entropy
(weighted by document size) under which the words of each feature meet its target. The multipliers solve a convex
dual by Newton's method: each iteration is one distributed aggregation over the distinct feature vectors, and the
driver solves a system with one unknown a constraint. Rates are then rounded into whole copies, systematically
along the sizes, so that each source's words stay near their target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, word_count

#: Constraints (sources) at most; their sums reach the driver, a row or two each. More raise ValueError.
MAX_CONSTRAINTS = 1_000_000
#: Constraints that documents share (with several features each) at most: their system is solved as a matrix.
MAX_DENSE = 4096
#: Values of sources that go into an expression; more are joined.
MAX_LITERALS = 4096
#: Slices of the documents of one source and size, so that many equal documents are ranked by many tasks.
SLICES = 1024
MAX_ITERATIONS = 60
REFINEMENTS = 12
#: A source further from its target than this share of it is refined beyond the first steps.
FAR = 0.005


def capped_targets(sizes: dict[str | None, int], cap: float = 3.0) -> dict[str | None, float]:
    """Targets of the sources: weights 1, 2, 3, repeating, in order of code points with null last, share the sum of
    all sizes; a target stops at ``cap`` times its source's size and the excess goes to the others by weight, until
    no target is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    targets: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        each = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * each > cap * sizes[s]]
        if not over:
            return targets | {s: weight[s] * each for s in free}
        for s in over:
            targets[s] = float(cap * sizes[s])
            left -= targets[s]
        free = [s for s in free if s not in targets]
        left = max(left, 0.0)
    return targets


def entropy_balance(units: DataFrame, targets: dict[int, float], tolerance: float = 1e-10) -> np.ndarray:
    """Multipliers that meet the targets.

    ``units``: rows ``(mass double, features array<struct<k:int, v:double>>)``, one for each distinct feature vector or
    any finer grain; ``targets``: the sum of mass * rate * v wanted for each k from 0. Minimises the dual
    sum(mass * exp(m . f)) - m . t with damped Newton steps. Constraints without mass keep a multiplier of 0.
    """
    n = max(targets, default=-1) + 1
    if n > MAX_CONSTRAINTS:
        raise ValueError(f"{n} constraints; at most {MAX_CONSTRAINTS} are supported")
    t, m = np.array([targets.get(k, 0.0) for k in range(n)]), np.zeros(n)
    for _ in range(MAX_ITERATIONS):
        # Gradient (j = -1) and Hessian in one pass; a unit adds one entry for each pair of its own features.
        one = F.struct(F.lit(-1).alias("k"), F.lit(1.0).alias("v"))
        sums = (_tilted(units, m).select("w", "features", F.explode("features").alias("a"))
                .select("w", "a", F.explode(F.concat(F.array(one), "features")).alias("b"))
                .groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j"))
                .agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("s")).toArrow())
        i, j, x = (sums[c].to_numpy() for c in ("i", "j", "s"))
        g, h = -t.copy(), np.zeros(n)
        g[i[j < 0]] += x[j < 0]
        h[i[i == j]] = x[i == j]
        live = h > 0
        if not live.any() or np.abs(g[live]).max() <= tolerance * max(1.0, np.abs(t).max()):
            break
        step = np.zeros(n)
        if (j >= 0).sum() == live.sum():  # no unit has two features: the dual falls apart
            step[live] = -g[live] / h[live]
            step /= np.maximum(np.abs(step) / 2.0, 1.0)
            m += step
            continue
        if n > MAX_DENSE:
            raise ValueError(f"{n} constraints that units share; at most {MAX_DENSE} are supported")
        full = np.zeros((n, n))
        full[i[j >= 0], j[j >= 0]] = x[j >= 0]
        step[live] = np.linalg.lstsq(full[np.ix_(live, live)], -g[live], rcond=None)[0]
        m += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
    return m


def _tilted(units: DataFrame, m: np.ndarray) -> DataFrame:
    """``w, features``: the mass of each unit times exp(multipliers . features)."""
    if len(m) <= MAX_LITERALS:
        values = F.array(*[F.lit(float(x)) for x in m]) if len(m) else F.array().cast("array<double>")
        tilt = F.exp(F.aggregate("features", F.lit(0.0), lambda a, f: a + f["v"] * F.element_at(values, f["k"] + 1)))
        return units.select((F.col("mass") * tilt).alias("w"), "features")
    known = units.sparkSession.createDataFrame(pa.table({"k": pa.array(np.arange(len(m)), pa.int32()), "m": m}))
    rows = units.withColumn("_u", F.monotonically_increasing_id()).select("_u", "mass", "features", F.explode("features").alias("f"))
    rows = rows.join(known, F.col("f.k") == F.col("k")).groupBy("_u", "mass", "features").agg(F.sum(F.col("f.v") * F.col("m")).alias("x"))
    return rows.select((F.col("mass") * F.exp("x")).alias("w"), "features")


def _by_source(df: DataFrame, values: dict[int, float], name: str, kind: str) -> DataFrame:
    """``df`` with a column of the values of its sources ``_k``, null where there is none."""
    if len(values) <= MAX_LITERALS:
        every = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast(f"map<int,{kind}>")
        return df.withColumn(name, F.try_element_at(every, F.col("_k")).cast(kind))
    known = df.sparkSession.createDataFrame(pa.table({"_kk": pa.array(list(values), pa.int32()), name: list(values.values())}))
    return df.join(known.withColumn(name, F.col(name).cast(kind)), F.col("_k") == F.col("_kk"), "left").drop("_kk")


def _null_safe(c: str) -> tuple[Column, Column]:
    """Two columns without nulls that stand for ``c`` as a key."""
    return F.col(c).isNull().alias("_null"), F.coalesce(F.col(c), F.lit("")).alias("_s")


def mix_to_targets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   cap: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies, rate`` and the columns ``carry``.

    size: words (runs without ASCII white space; 0 for null). ``copies`` whole copies of a document are taken, floor or
    ceiling of its rate, so never more than ``cap``; taken = copies * size. In each source the documents rounded up
    are spread evenly over the sizes, then single documents are flipped while that brings the sum nearer to the
    target. A null source is a source; a source without words has target 0 and keeps rate 1; equal documents are
    told apart by a hash of doc_id, and rows equal in all used columns get copies as if numbered. Same input, same
    result. An empty input gives no rows.
    """
    spark = docs.sparkSession
    thin = Table(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("_source"),
                             word_count(F.col(f"`{text_col}`")).alias("size"),
                             *[F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry")] * bool(carry)), "mix-docs")
    rows = thin.df.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int"))
    cells = Table(rows.groupBy("_source", "size", "_slice").agg(F.count("*").alias("n")), "mix-cells")
    per_source = cells.df.groupBy("_source").agg(F.sum(F.col("n") * F.col("size")).alias("s")).limit(MAX_CONSTRAINTS + 1).collect()
    if len(per_source) > MAX_CONSTRAINTS:
        raise ValueError(f"more than {MAX_CONSTRAINTS} sources")
    sizes = {r["_source"]: r["s"] for r in per_source}
    targets = capped_targets(sizes, cap)
    number = {s: i for i, s in enumerate(sizes)}
    known = spark.createDataFrame([(s, i, sizes[s], targets[s]) for s, i in number.items()], "_source string, _k int, source_size long, target double")
    known = F.broadcast(known) if len(number) <= MAX_LITERALS else known

    def with_source(df: DataFrame) -> DataFrame:
        return df.join(known.withColumnRenamed("_source", "_s"), df["_source"].eqNullSafe(F.col("_s"))).drop("_s")

    units = with_source(cells.df.groupBy("_source").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("mass")))
    units = units.filter("mass > 0").select("mass", F.array(F.struct(F.col("_k").alias("k"), F.lit(1.0).alias("v"))).alias("features"))
    m = entropy_balance(units, {i: targets[s] for s, i in number.items()})
    rate = {i: min(float(cap), round(float(np.exp(m[i])), 9)) if sizes[s] else 1.0 for s, i in number.items()}

    # Sizes of a source in order, with the number of documents up to each: systematic rounding along that axis.
    by_size = with_source(cells.df.groupBy("_source", "size").agg(F.sum("n").alias("n")))
    w = Window.partitionBy("_k").orderBy("size")  # a row for each distinct size of a source, not for each document
    by_size = _by_source(by_size, rate, "rate", "double").withColumn("_upto", F.sum("n").over(w)).withColumn(
        "_f", F.col("rate") - F.floor("rate"))
    quota = Table(by_size.select("_source", "_k", "source_size", "target", "rate", "size", "n", F.floor("rate").alias("base"), (
        F.floor(F.col("_f") * F.col("_upto") + 0.5) - F.floor(F.col("_f") * (F.col("_upto") - F.col("n")) + 0.5)).alias("up")), "mix-quota")

    # Refinement: the sum of each source misses its target by less than its largest document. Move single copies; where
    # none brings it nearer and it is still off, overshoot by the smallest step and go on from there, keeping the best.
    moves: dict[int, dict[int, int]] = {i: {} for i in number.values()}
    best_moves: dict[int, dict[int, int]] = {i: {} for i in number.values()}
    error = {r["_k"]: r["target"] - r["t"] for r in quota.df.groupBy("_k", "target").agg(
        F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("up"))).alias("t")).collect()}
    least, goal = dict(error), {number[s]: t for s, t in targets.items()}
    for turn in range(REFINEMENTS):
        close = 1.0 if turn < REFINEMENTS // 2 else None  # later rounds are for sources that are still far off
        open_ = {k: e for k, e in error.items() if abs(least[k]) >= (close or max(1.0, FAR * goal[k])) and goal[k] > 0}
        if not open_:
            break
        e = F.col("_e")
        touched = spark.createDataFrame([(k, z, d) for k, own in moves.items() for z, d in own.items()], "_k int, size long, _d long")
        touched = F.broadcast(touched) if len(moves) <= MAX_LITERALS else touched
        now = _by_source(quota.df, {k: float(v) for k, v in open_.items()}, "_e", "double").filter("_e is not null")
        now = now.join(touched, ["_k", "size"], "left").withColumn("_up", F.col("up") + F.coalesce("_d", F.lit(0)))
        copies = F.col("n") * F.col("base") + F.col("_up")
        same_way = F.coalesce(F.col("_d") * F.signum(e) >= 0, F.lit(True))
        able = F.when(e > 0, copies < F.col("n") * cap).otherwise(copies > 0) & same_way
        gap = F.abs(F.abs(e) - F.col("size"))
        found = now.filter(able & (F.col("size") > 0)).groupBy("_k").agg(F.min_by("size", F.struct(gap, "size")).alias("size")).collect()
        if not found:
            break
        for k, z in found:
            up = 1 if error[k] > 0 else -1
            if abs(error[k] - up * z) >= abs(error[k]) and abs(least[k]) < max(1.0, FAR * goal[k]):
                error[k] = 0.0  # near enough, and nothing better in one step
                continue
            moves[k][z] = moves[k].get(z, 0) + up
            error[k] -= up * z
            if abs(error[k]) < abs(least[k]):
                least[k], best_moves[k] = error[k], dict(moves[k])
    flips = {(k, z): d for k, own in best_moves.items() for z, d in own.items()}

    # From the quota of a size to slices, and from slices to documents: one exchange, on the slice, serves both.
    done = spark.createDataFrame([(k, s, d) for (k, s), d in flips.items()], "_k int, size long, _d long")
    done = F.broadcast(done) if len(flips) <= MAX_LITERALS else done
    final = quota.df.join(done, ["_k", "size"], "left").select(
        *_null_safe("_source"), "size", "source_size", "target", "rate", F.col("n").alias("_n"),
        (F.col("n") * F.col("base") + F.col("up") + F.coalesce("_d", F.lit(0))).alias("_up"))
    sliced = cells.df.select(*_null_safe("_source"), "size", "_slice", "n").withColumn(
        "_upto", F.sum("n").over(Window.partitionBy("_null", "_s", "size").orderBy("_slice")))
    part = lambda upto: F.expr(f"(_up * ({upto})) div greatest(_n, 1)")
    slices = Table(sliced.join(final, ["_null", "_s", "size"]).select(
        "_null", "_s", "size", "_slice", "n", "source_size", "target", "rate",
        (part("_upto") - part("_upto - n")).alias("_take")), "mix-slices")
    key = ["_null", "_s", "size", "_slice"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))
    out = rows.select("*", *_null_safe("_source")).withColumn("_rn", nth).join(slices.df, key)
    # The slice's copies, dealt evenly over its documents.
    copies = F.expr("_take div n + if(_rn <= _take % n, 1, 0)").cast("int")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
                      copies.alias("copies"), "rate", *[F.col(f"_carry.`{c}`") for c in carry])

