"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Shingles are hashed into m segments, with m set by the band of the set's size. Sets within the threshold differ in at
most H shingles, so with m + a > H (a of the segments also indexed with one shingle left out) some segment of theirs
agrees, exactly or but for one shingle. Every set therefore gets a signature for the contents of each segment, plus
those of the one-deletion neighbourhoods where the cost model allots them; sets that share one are compared exactly:
by 64-bit names of shingles only after all equal names were found to stand for equal words, by the words otherwise.
Documents of equal words, by a cryptographic digest, are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare
from .links import connect, in_blocks
from .textkit import BLOCK_BYTES, Words, blocks, byte_table, mix

_U = np.uint64
#: Documents whose texts are wanted for comparing are sent as a list up to this many; more are joined.
MAX_SENT = 1_000_000
#: Texts that a task remembers as signed, so that it signs no copies of them; then it begins anew.
MAX_SIGNED = 200_000
#: Rows, and shingles in all, of half a block in which sets are compared all against all.
GROUP_ROWS, GROUP_SHINGLES = 512, 300_000
#: Pairs, and bytes of their texts, that are compared at a time.
PART_PAIRS, PART_BYTES = 256, 2 << 20
#: Sets whose digests agree in their first halves, at most: by chance there is hardly one in ten thousand million sets.
MAX_CLASHES = 10_000
#: In the cost model, what a segment of one shingle or none costs, in signatures: it can agree by chance.
THIN_COST = 6.0


def band(n: int, num: int) -> int:
    """Sets within a Jaccard similarity of num/100 lie in the same or in adjacent bands. Where only equal sets link, each
    size is a band."""
    if num == 100:
        return n
    return int(math.floor(math.log(n) / math.log(100 / num) + 1e-9))


@lru_cache(None)
def scheme(b: int, num: int) -> tuple[int, int, int]:
    """(m, a, g) of band b: segments, segments with one-deletion neighbourhoods, and agreeing segments to spare.

    g agreeing segments may be thin (too few shingles to say anything) and still leave another one; sets with more thin
    segments have signatures for those as well. Of the allotments that the pigeonhole allows, the one of least cost is
    taken: signatures, plus a penalty for thin segments.
    """
    if num == 100:
        return 1, 0, 0
    lo = max(1, math.ceil((100 / num) ** b - 1e-6))
    hi = max(lo, math.ceil((100 / num) ** (b + 1) - 1e-6) - 1)
    h = (100 - num) * (hi + hi * 100 // num) // (100 + num)
    found = []
    for weight in (1, 2):  # each segment stands for one difference, or with its one-deletion neighbourhood for two
        for g in range(h // 3 + 2):
            m = -(-(h + 1 + weight * g) // weight)
            s = lo / m
            thin = m * math.exp(-s) * (1 if weight == 1 else 1 + s)
            if m == 1 or g >= thin + 2 * math.sqrt(thin):
                break
        cost = m + (weight - 1) * lo + THIN_COST * m * math.exp(-s) * (1 + s)
        found.append((cost, m, (weight - 1) * m, min(g, m - 1)))
    return min(found)[1:]


def shingle_sets(texts: pa.Array, n: int, lower: bool, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words, bool]]:
    """(from, to, shingles, bounds, words, sure): the distinct shingles of each text of a block, sorted, as 64-bit names;
    sure: no text has different shingles of one name."""
    for a, b, w in blocks(texts, byte_table("spaces"), lower, size):
        grams, at = _shingles(w, n)
        g, d = grams[at], w.doc[at]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        again = np.flatnonzero(~first)
        sure = same_shingles(w, n, at[order[again]], at[order[again - 1]])
        g, d = g[first], d[first]
        yield a, b, g, np.searchsorted(d, np.arange(b - a + 1)), w, sure


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the shingles from each word on, and the words from which there is one. A text of fewer words has one."""
    grams, room, sizes = w.grams(n), w.room(), np.diff(w.first)
    ok = room >= n
    for d in np.flatnonzero((sizes > 0) & (sizes < n)):  # shorter texts: the whole sequence
        i = w.first[d]
        ok[i] = True
        h = _U(sizes[d])
        with np.errstate(over="ignore"):
            for x in w.name[i : w.first[d + 1]]:
                h = h * _U(0x9FB21C651E98DF25) + x
        grams[i] = mix(np.array([h]))[0]
    return grams, np.flatnonzero(ok)


def same_shingles(w: Words, n: int, i: np.ndarray, j: np.ndarray) -> bool:
    """Whether the shingles from the words i[x] and j[x] on are equal, all of them, by their words."""
    own = np.minimum(np.diff(w.first)[w.doc], n)  # words of a text's shingles
    return bool((own[i] == own[j]).all()) and all(w.same(i[own[i] > k] + k, j[own[i] > k] + k).all() for k in range(n))


def distinct_names(w: Words, n: int) -> bool:
    """Whether shingles of a block with equal names have equal words, in all its texts."""
    grams, at = _shingles(w, n)
    at = at[np.argsort(grams[at], kind="stable")]
    equal = np.flatnonzero(grams[at[1:]] == grams[at[:-1]])
    return same_shingles(w, n, at[equal], at[equal + 1])


def exact_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sets of a block's texts with a number for each shingle, told apart by its words."""
    number: dict[tuple[bytes, ...], int] = {}
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        words = w.text(a, b)
        found = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
        out.append(np.array(sorted(number.setdefault(x, len(number)) for x in found), np.uint64))
    return out


def signatures(g: np.ndarray, bounds: np.ndarray, num: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) rows for the ``wanted`` sets of a block, all if not given, under the schemes of their own band and
    the one below."""
    sizes = np.diff(bounds)
    if wanted is not None and not wanted.all():
        g, sizes = g[np.repeat(wanted, sizes)], np.where(wanted, sizes, 0)
    live = np.flatnonzero(sizes > 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    values = mix(g ^ _U(0xA0761D6478BD642F))
    place = mix(g ^ _U(0xE7037ED1A0B428DB)) >> _U(16)
    sigs, sets = [], []
    for down in (0, 1):
        m, a, spare, tag = (np.zeros(len(sizes), np.int64) for _ in range(4))
        for n in np.unique(sizes[live]):
            b = band(int(n), num) - down
            if b >= 0:
                here = sizes == n
                m[here], a[here], spare[here] = scheme(b, num)
                tag[here] = b + 1
        base = np.concatenate([[0], np.cumsum(m)])
        use = m[doc] > 0
        d, v = doc[use], values[use]
        seg = base[d] + (place[use] % np.maximum(m[d], 1).astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, seg, v)
        count = np.bincount(seg, minlength=base[-1])
        owner = np.repeat(np.arange(len(sizes)), m)
        number = np.arange(base[-1]) - base[owner]
        label = mix((tag[owner].astype(np.uint64) << _U(32)) + number.astype(np.uint64) + _U(0x1D8E4E27C47D124F))
        thin = count <= (a[owner] > 0)
        crowded = np.bincount(owner[thin], minlength=len(sizes)) > spare  # too many thin segments: these count as well
        keep = ~thin | crowded[owner]
        sigs.append(mix(label[keep] ^ mix(total[keep])))
        sets.append(owner[keep])
        gone = (a[d] > 0) & keep[seg]
        sigs.append(mix(label[seg[gone]] ^ mix(total[seg[gone]] - v[gone])))
        sets.append(d[gone])
    return np.concatenate(sigs), np.concatenate(sets)


def named_sets(nodes: list[int], texts: pa.Array, n: int, lower: bool) -> dict[int, np.ndarray]:
    """The sets of the nodes, from their texts, comparable with each other: by names, which are checked to stand for the
    same words all through, or else by the words. Another text under a repeated id is not the one meant."""
    out: dict[int, np.ndarray] = {}
    for _, _, g, bounds, w, _ in shingle_sets(texts, n, lower, 1 << 62):
        own = w.digests()
        sets = [g[x:y] for x, y in zip(bounds[:-1], bounds[1:])] if distinct_names(w, n) else exact_sets(w, n)
        for i, node in enumerate(nodes):
            if node in (own[0][i], own[1][i]):
                out[node] = sets[i]
    return out


def within(p: np.ndarray, q: np.ndarray, num: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= num * (len(p) + len(q) - both)


def linked_pairs(sets: list[np.ndarray], labels: np.ndarray, num: int) -> tuple[list[int], list[int]]:
    """Links between sets of different labels: enough of them to connect whatever is linked.

    All intersections at once, as products of 0/1 matrices over the shingles that occur in several of the sets.
    """
    k = len(sets)
    if k < 2:
        return [], []
    sizes = np.array([len(x) for x in sets])
    word, owner = np.concatenate(sets), np.repeat(np.arange(k), sizes)
    _, word, count = np.unique(word, return_inverse=True, return_counts=True)
    common = count[word] > 1
    rank = np.cumsum(count > 1) - 1
    word, owner = rank[word[common]], owner[common]
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    both = np.zeros((k, k), np.float32)
    for low in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
        x, y = np.searchsorted(word, (low, low + 4096))
        m = np.zeros((k, 4096), np.float32)
        m[owner[x:y], word[x:y] - low] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    a, b = np.nonzero(np.triu(100 * both >= num * (sizes[:, None] + sizes[None, :] - both), 1) & (labels[:, None] != labels[None, :]))
    root = {x: x for x in set(labels.tolist())}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(int(labels[x])), find(int(labels[y]))
        if p != q:
            root[p] = q
            out[0].append(x)
            out[1].append(y)
    return out


def jaccard_groups(docs: DataFrame, n: int = 4, num: int = 85, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, set_id``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
    shingles of ``n`` words, or its whole word sequence if that is shorter. Documents link if 100 * |both| >= num *
    |either|; component_id is the smallest doc_id reachable. ``set_id`` is equal for equal word sequences (null without words).
    Documents without words, null texts included, link with nothing and are their own component; so does a null
    doc_id's, which is null where no other member has an id. Repeated rows are equal sets. Empty input, no rows.
    """
    if n < 1 or not 0 < num <= 100:
        raise ValueError("shingles of at least one word, and a similarity over 0 and up to 100")
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, bounds, w, sure in shingle_sets(batch.column(1), n, lower):
                size = np.diff(bounds) if sure else np.array([len(x) for x in exact_sets(w, n)])
                node, check = w.digests()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(node, pa.int64(), mask=size == 0), pa.array(check, pa.int64(), mask=size == 0)],
                    names=["doc_id", "n_shingles", "set_id", "check"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for batch in batches:
            for _, _, g, bounds, w, _ in shingle_sets(batch.column(0), n, lower):
                node, check = w.digests()
                if len(clashing):
                    node = np.where(np.isin(node, clashing), check, node)
                if len(signed) > MAX_SIGNED:
                    signed.clear()
                again = np.zeros(len(node), bool)  # copies of a text that this task has signed
                for i, k in enumerate(node.tolist()):
                    again[i] = k in signed
                    signed.add(k)
                sig, which = signatures(g, bounds, num, ~again)
                node = node[which]
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node)], names=["sig", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    sets = Table(src.mapInArrow(names, f"doc_id {kind}, n_shingles long, set_id long, check long"), "shingle-sets").df
    one = sets.filter("set_id is not null").groupBy(F.col("set_id").alias("node")).agg(
        F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.min("check").alias("x"), F.max("check").alias("y"))
    one = Table(one, "sets-once")
    # Digests of two halves: where first halves meet by chance, which is next to never, the second ones are the nodes.
    clashing = one.df.filter("x <> y").select("node").limit(MAX_CLASHES + 1).toArrow()["node"].to_numpy()
    if len(clashing) > MAX_CLASHES:
        raise RuntimeError("the digests of texts are not random")
    if len(clashing):
        sets = sets.withColumn("set_id", F.when(F.col("set_id").isin(*clashing.tolist()), F.col("check")).otherwise(F.col("set_id")))
        one = Table(sets.filter("set_id is not null").groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n")), "sets-once")
    rows = src.select("text").mapInArrow(sign, "sig long, node long")

    def texts_of(nodes: DataFrame) -> Table:
        """``node, text``: one text of each set wanted (``node, id``)."""
        wanted = Table(nodes.distinct(), "wanted-texts")
        few = wanted.df.limit(MAX_SENT + 1).count() <= MAX_SENT
        out = Table(src.join(F.broadcast(wanted.df) if few else wanted.df, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text"), "texts")
        wanted.drop()
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs whose sets, made anew from the texts, are within the threshold."""
        size = lambda k: one.df.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("first").alias(f"f{k}"))
        fit = Table(pairs.join(size("a"), "a").join(size("b"), "b").filter(f"100 * least(na, nb) >= {num} * greatest(na, nb)"), "sized-pairs")
        texts = texts_of(fit.df.select(F.col("a").alias("node"), F.col("fa").alias("id")).union(fit.df.select("b", "fb")))
        wide = fit.df.select("a", "b").join(texts.df.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
            texts.df.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size = sum(np.asarray(pc.binary_length(batch.column(k)).fill_null(0), np.int64) for k in (2, 3))
                i = 0
                while i < batch.num_rows:  # few pairs at a time where their texts are long
                    fit = int(np.searchsorted(np.cumsum(size[i : i + PART_PAIRS]), PART_BYTES, "right"))
                    part = batch.slice(i, max(1, min(fit, PART_PAIRS)))
                    i += part.num_rows
                    a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                    rows = dict.fromkeys([*zip(a, part.column(2).to_pylist()), *zip(b, part.column(3).to_pylist())])
                    known = named_sets([k for k, _ in rows], pa.array([t for _, t in rows], pa.string()), n, lower)
                    keep = [x in known and y in known and within(known[x], known[y], num) for x, y in zip(a, b)]
                    yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        linked = Table(wide.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct(), "linked")
        fit.drop()
        texts.drop()
        return linked.df

    def compare(groups: DataFrame) -> DataFrame:
        """Links between components within the groups, all against all in blocks of bounded size."""
        sized = Table(groups.join(one.df.select(F.col("node").alias("k"), "n", "first"), F.col("node") == F.col("k")).select("head", "node", "label", "n", "first"), "group-members")
        texts = texts_of(sized.df.select("node", F.col("first").alias("id")))
        rows = in_blocks(sized.df.select("head", "node", "label", "n"), "n", GROUP_ROWS, GROUP_SHINGLES)
        wide = rows.join(texts.df.select(F.col("node").alias("k"), "text"), F.col("node") == F.col("k")).select("head", "i", "j", "node", "label", "text")

        def block(table: pa.Table) -> pa.Table:
            nodes = table["node"].to_pylist()
            sets = named_sets(nodes, table["text"].combine_chunks(), n, lower)
            labels = dict(zip(nodes, table["label"].to_pylist()))
            nodes = sorted(sets)
            a, b = linked_pairs([sets[k] for k in nodes], np.array([labels[k] for k in nodes]), num)
            return pa.table({"a": pa.array([nodes[x] for x in a], pa.int64()), "b": pa.array([nodes[x] for x in b], pa.int64())})

        found = Table(wide.groupBy("head", "i", "j").applyInArrow(block, "a long, b long").distinct(), "group-links")
        sized.drop()
        texts.drop()
        return found.df

    labels = connect(rows, verify, compare)
    label = F.coalesce("label", "node")
    grouped = one.df.join(labels.df.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", "first", label.alias("label"))
    least = grouped.groupBy("label").agg(F.min("first").alias("least"))
    of_set = Table(grouped.join(least, "label").select("node", "least"), "set-components")
    return sets.join(of_set.df, F.col("set_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "set_id")
