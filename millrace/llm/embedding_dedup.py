"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors are one node. Centres are fitted on a bounded sample; every node joins the shards of its nearest
centres, so shards overlap. In each shard a graph is built by robust pruning; a node's lists from its shards are
united. Every node is searched from the medoids of its shards: a greedy beam search finds the neighbourhood, then the
range expands over the graph while neighbours stay near the threshold. Each pair found is verified in double
precision and counted in one shard only; an audit against brute force on one node in fifty sets whether the search is
repeated with more overlap, and fails where the last one is still under the target. Large shards are cut into pieces of bounded size, each searched for all nodes of its
shard, in blocks.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare
from .links import components

log = logging.getLogger(__name__)

#: Nodes that centres are fitted on, at most (fewer for long vectors: SAMPLE_BYTES), and centres.
SAMPLE, SAMPLE_BYTES, MAX_CENTRES = 16_384, 64 << 20, 1024
#: Nodes a centre is meant for, and nodes of a piece at most, about.
PER_CENTRE, PER_PIECE = 1500, 4000
#: Graph: candidates considered, neighbours kept, pruning slack, random links; search: beam width, queries at once.
CANDIDATES, DEGREE, ALPHA, RANDOM, BEAM, BATCH = 48, 20, 1.2, 4, 16, 256
#: How far under the threshold the range still expands.
SLACK = 0.05
#: Distinct vector lengths in one input, at most; vectors of different length never link.
MAX_LENGTHS = 64
#: The audit asks for one node in so many, and for so many at least, about; so many are sent at once (fewer if long).
AUDIT_EVERY, AUDIT_LEAST, AUDIT_BLOCK = 50, 64, 4096
#: Searches at most, each with more overlap and a wider beam than the one before.
MAX_TURNS = 4


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def fit_centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from a fixed start."""
    c = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def build_graph(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """Adjacency (rows of places, padded with the row's own) by robust pruning, with reverse and a few random links."""
    n = len(x)
    if n == 1:
        return np.zeros((1, 1), np.int64)
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -np.inf)
    c = min(CANDIDATES, n - 1)
    cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
    rows = np.arange(n)[:, None]
    near = s[rows, cand]
    order = np.argsort(-near, axis=1)
    cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
    alive = np.ones(cand.shape, bool)
    picks = np.full((n, DEGREE), -1)
    for j in range(DEGREE):
        at = alive.argmax(1)
        has = alive[np.arange(n), at]
        pick = cand[np.arange(n), at]
        picks[has, j] = pick[has]
        # A candidate goes if the picked neighbour is nearer to it, by the slack, than the node is.
        alive &= ~(has[:, None] & (ALPHA * (1 - s[pick[:, None], cand]) <= 1 - near))
        alive[np.arange(n), at] = False
        if not alive.any():
            break
    a, j = np.nonzero(picks >= 0)
    b = picks[a, j]
    rng = np.random.default_rng(seed)
    extra = rng.integers(0, n, (n, RANDOM))
    src = np.concatenate([a, b, np.repeat(np.arange(n), RANDOM)])
    dst = np.concatenate([b, a, extra.ravel()])
    key = np.unique(src * n + dst)
    src, dst = key // n, key % n
    degree = np.bincount(src, minlength=n)
    place = np.arange(len(src)) - np.repeat(np.cumsum(degree) - degree, degree)
    out = np.repeat(np.arange(n)[:, None], min(int(degree.max()), 3 * DEGREE), axis=1)
    ok = place < out.shape[1]
    out[src[ok], place[ok]] = dst[ok]
    return out


def range_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) pairs with cosine at or above the threshold. ``own``: a query's own place, or -1."""
    n, parts = len(x), np.array_split(np.arange(len(x)), min(4, len(x)))
    medoids = np.unique([p[(x[p] @ x[p].mean(0)).argmax()] for p in parts])
    x32, found_q, found_v = x.astype(np.float32), [], []
    for a in range(0, len(q), BATCH):
        z, mine = q[a : a + BATCH], own[a : a + BATCH]
        m, z32 = len(z), z.astype(np.float32)
        seen = np.zeros((m, n), bool)
        stamp = np.zeros((m, n), np.int32)
        start = np.concatenate([np.repeat(medoids[None, :], m, 0), np.where(mine >= 0, mine, medoids[0])[:, None]], axis=1)
        cand, sim = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        hits_q, hits_v = [], []
        new, rows = start, np.arange(m)
        while len(rows):  # greedy search: all open queries take one step at a time
            flat = (rows[:, None] * n + new).ravel()
            fresh = ~seen.ravel()[flat]
            seen.ravel()[flat] = True
            stamp.ravel()[flat] = np.arange(len(flat))
            fresh &= stamp.ravel()[flat] == np.arange(len(flat))
            value = np.einsum("brd,bd->br", x32[new], z32[rows])
            value[~fresh.reshape(new.shape)] = -np.inf
            i, j = np.nonzero(value >= threshold - SLACK)
            hits_q.append(rows[i])
            hits_v.append(new[i, j])
            all_sim, all_cand = np.hstack([sim[rows], value]), np.hstack([cand[rows], new])
            all_open = np.hstack([open_[rows], np.isfinite(value)])
            top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            sim[rows], cand[rows], open_[rows] = (np.take_along_axis(t, top, 1) for t in (all_sim, all_cand, all_open))
            rows = np.flatnonzero(open_.any(1))
            best = np.where(open_[rows], sim[rows], -np.inf).argmax(1)
            open_[rows, best] = False
            new = adj[cand[rows, best]]
        front_q, front_v = np.concatenate(hits_q), np.concatenate(hits_v)
        while len(front_q):  # the range expands from all that is near enough
            exact = np.concatenate([np.einsum("ij,ij->i", z[front_q[i : i + 65536]], x[front_v[i : i + 65536]]) for i in range(0, len(front_q), 65536)])
            hit = exact >= threshold
            found_q.append(front_q[hit] + a)
            found_v.append(front_v[hit])
            wide = exact >= threshold - SLACK
            nq, nv = [], []
            for i in range(0, int(wide.sum()), 65536):
                fq, fv = front_q[wide][i : i + 65536], front_v[wide][i : i + 65536]
                flat = (fq[:, None] * n + adj[fv]).ravel()
                flat = flat[~seen.ravel()[flat]]
                seen.ravel()[flat] = True
                stamp.ravel()[flat] = np.arange(len(flat))
                flat = flat[stamp.ravel()[flat] == np.arange(len(flat))]
                nq.append(flat // n)
                nv.append(flat % n)
            front_q, front_v = np.concatenate(nq or [front_q[:0]]), np.concatenate(nv or [front_v[:0]])
    return np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_v or [np.zeros(0, np.int64)])


def _spanning(nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to its component's smallest, for links given as pairs."""
    ids, flat = np.unique(np.concatenate([nodes, others]), return_inverse=True)
    u, v = flat[: len(nodes)], flat[len(nodes) :]
    label = np.arange(len(ids))
    while True:
        old = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == old).all():
            break
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _links(nodes: DataFrame, threshold: float, overlap: int, beam: int) -> Table:
    """``node, links, label``: verified links of each node (copies counted), in parts, and edges within components."""
    spark = nodes.sparkSession
    n, length = nodes.count(), nodes.select(F.size("embedding")).first()[0]
    want = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * length)))
    sample = nodes.filter(F.shiftrightunsigned(F.xxhash64("node", F.lit(9)), 11) / F.lit(float(1 << 53)) < min(1.0, want / max(n, 1)))
    x = sample.select("embedding").limit(2 * want).toArrow()  # a bounded sample
    x = unit(matrix(x["embedding"])) if len(x) else unit(matrix(nodes.select("embedding").limit(1).toArrow()["embedding"]))
    centres = spark.sparkContext.broadcast(fit_centres(x, max(1, min(MAX_CENTRES, n // PER_CENTRE + 1, len(x)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        k = min(overlap, len(c))
        for batch in batches:
            s = unit(matrix(batch.column(2))) @ c.T
            near = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["node", "mult", "embedding", "near"])

    placed = Table(nodes.select("node", "mult", "embedding").mapInArrow(assign, "node long, mult long, embedding array<double>, near array<int>"), "shard-members")
    members = placed.df.withColumn("shard", F.explode("near"))
    pieces = {r[0]: -(-r[1] // PER_PIECE) for r in members.groupBy("shard").count().collect()}  # at most MAX_CENTRES rows
    parts = F.element_at(F.create_map(*[F.lit(v) for kv in pieces.items() for v in kv]), F.col("shard"))
    members = members.withColumn("parts", parts).withColumn("piece", F.pmod(F.xxhash64("node", F.lit(4)), F.col("parts")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids = table["node"].to_numpy()
        adj = build_graph(unit(matrix(table["embedding"])))
        return pa.table({"node": ids, "out": pa.array(ids[adj].tolist(), pa.list_(pa.int64()))})

    lists = members.select("shard", "piece", "node", "embedding").groupBy("shard", "piece").applyInArrow(build, "node long, out array<long>")
    graph = Table(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out")), "graph")
    flat = members.join(graph.df, "node")
    # A piece meets the queries of every piece of its shard: rows that are stored, queries, or both.
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    meets = F.array_union(F.transform(every, lambda i: F.struct(F.col("piece").alias("s"), i.cast("int").alias("q"))),
                          F.transform(every, lambda i: F.struct(i.cast("int").alias("s"), F.col("piece").alias("q"))))
    rows = flat.withColumn("meet", F.explode(meets)).select(
        "shard", "meet.s", "meet.q", "node", "mult", "near", "embedding", "out", (F.col("meet.s") == F.col("piece")).alias("stored"), (F.col("meet.q") == F.col("piece")).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        empty = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})
        stored, asks = table.filter(table["stored"]), table.filter(table["asks"])
        if not len(stored) or not len(asks):
            return empty
        ids, qids = stored["node"].to_numpy(), asks["node"].to_numpy()
        order = np.argsort(ids)
        ids, stored = ids[order], stored.take(pa.array(order))
        out = stored["out"].combine_chunks()
        owner = np.repeat(np.arange(len(ids)), np.diff(np.asarray(out.offsets)))
        target = np.asarray(out.flatten())
        at = np.minimum(np.searchsorted(ids, target), len(ids) - 1)
        ok = ids[at] == target  # neighbours of other shards are not here
        owner, at = owner[ok], at[ok]
        degree = np.bincount(owner, minlength=len(ids))
        adj = np.repeat(np.arange(len(ids))[:, None], max(1, int(degree.max(initial=0))), axis=1)
        adj[owner, np.arange(len(owner)) - np.repeat(np.cumsum(degree) - degree, degree)] = at
        own = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
        own = np.where(ids[own] == qids, own, -1)
        u, v = range_search(unit(matrix(stored["embedding"])), adj, unit(matrix(asks["embedding"])), own, threshold, beam)
        keep = qids[u] != ids[v]
        u, v = u[keep], v[keep]
        if not len(u):
            return empty
        # A pair counts in the first shard that both are in.
        shard = table["shard"][0].as_py()
        near_q, near_v = np.array(asks["near"].to_pylist()), np.array(stored["near"].to_pylist())
        first = np.full(len(u), 1 << 30)
        for i in range(near_q.shape[1]):
            c = near_q[u, i]
            common = (near_v[v] == c[:, None]).any(1)
            first = np.where(common, np.minimum(first, c), first)
        mult = stored["mult"].to_numpy()
        links = np.bincount(u, weights=np.where(first == shard, mult[v], 0), minlength=len(qids)).astype(np.int64)
        some = np.flatnonzero(links)
        a, b = _spanning(qids[u], ids[v])
        return pa.table({"node": np.concatenate([qids[some], a]), "links": pa.array([*links[some].tolist(), *[None] * len(a)], pa.int64()),
                         "label": pa.array([*[None] * len(some), *b.tolist()], pa.int64())})

    found = Table(rows.groupBy("shard", "s", "q").applyInArrow(search, "node long, links long, label long"), "links")
    placed.drop()
    graph.drop()
    return found


def audit_recall(nodes: DataFrame, found: DataFrame, threshold: float, every: int = AUDIT_EVERY) -> float | None:
    """Share of links that ``found`` (node, links) has, by brute force over all nodes, of one node in ``every`` (by hash;
    more where that is under AUDIT_LEAST): the mean over nodes with links or the share of all their links, whichever is
    smaller; None where none of them has links.
    The nodes asked for are sent in blocks of bounded size, a pass over all nodes each."""
    spark = nodes.sparkSession
    n, length = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return None
    every = max(1, min(every, n // AUDIT_LEAST))
    blocks = -(-n // (every * max(1, min(AUDIT_BLOCK, SAMPLE_BYTES // (8 * length)))))
    asked = nodes.filter(F.pmod(F.xxhash64("node", F.lit(77)), F.lit(every)) == 0).withColumn("block", F.pmod(F.xxhash64("node", F.lit(78)), F.lit(blocks)))
    shares, with_links, kept, links = 0.0, 0, 0, 0
    for k in range(blocks):
        block = asked.filter(F.col("block") == k).select("node", "embedding").toArrow()
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast((block["node"].to_numpy(), unit(matrix(block["embedding"]))))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                hit = (q @ unit(matrix(batch.column(2))).T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                some = np.flatnonzero(hit.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array((hit[some] * batch.column(1).to_numpy()[None, :]).sum(1).astype(np.int64))], names=["node", "n"])

        true = nodes.select("node", "mult", "embedding").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
        have = found.filter("links is not null").join(F.broadcast(asked.filter(F.col("block") == k).select("node")), "node", "left_semi").groupBy("node").agg(F.sum("links").alias("have"))
        both = true.join(have, "node", "left").select("n", F.least(F.coalesce("have", F.lit(0)), "n").alias("k"))
        got = both.agg(F.sum(F.col("k") / F.col("n")), F.count("*"), F.sum("k"), F.sum("n")).first()
        shares, with_links, kept, links = (x + (y or 0) for x, y in zip((shares, with_links, kept, links), got))
        sent.unpersist()
    return min(shares / with_links, kept / links) if with_links else None


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", overlap: int = 2,
                    beam: int = BEAM, least_recall: float = 0.98) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept, audited_recall``.

    n_links: other vectors with a cosine at or above the threshold, copies included, as far as the search finds them
    (none below); component_id: the smallest vec_id reachable; kept: whether that is the vector's own. Null or zero
    vectors and those with null or non-finite components link with nothing, nor do vectors of different length.
    audited_recall, the same in all rows, is the least that the audits found (null where they met no links).
    Repeated rows are vectors of their own. A null id is never the smallest. Empty input, no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.transform(F.col(f"`{vec_col}`"), lambda e: e.cast("double") + F.lit(0.0))
    fit = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.when(fit, v).alias("embedding")).withColumn(
        "node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    once = Table(rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.any_value("embedding").alias("embedding")), "vectors-once")
    lengths = [r[0] for r in once.df.groupBy(F.size("embedding")).count().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    found, recalls = None, []
    for k in lengths:
        own = once.df.filter(F.size("embedding") == k)
        for turn in range(MAX_TURNS):
            part = _links(own, threshold, overlap + turn, beam * (turn + 1))
            recall = audit_recall(own, part.df, threshold)
            log.info("vectors of length %d, overlap %d: recall %s", k, overlap + turn, recall)
            if recall is not None and recall >= least_recall:
                break
            if turn < MAX_TURNS - 1:
                part.drop()
        else:
            # No links in the audit even with the widest search: there is nothing to hold it against.
            if recall is not None:
                raise RuntimeError(f"recall {recall:.4f} for vectors of length {k} is under {least_recall} with overlap {overlap + turn}")
        recalls += [recall] if recall is not None else []
        found = part.df if found is None else found.union(part.df)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, label long")
    labels = components(found.filter("label is not null").select(F.col("node").alias("a"), F.col("label").alias("b")))
    links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    known = once.df.select("node", "first", "mult").join(links, "node", "left").join(labels.df, "node", "left").select(
        "node", "first", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("label", "node").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("least"))
    of_node = Table(known.join(least, "label").select(F.col("node").alias("k"), "links", "least"), "vector-components")
    return rows.select("vec_id", "node").join(of_node.df, F.col("node") == F.col("k"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("least", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(min(recalls, default=None)).cast("double").alias("audited_recall"))
