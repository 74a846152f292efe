"""Signatures are the bulk of a join's work: they are made once, and not for copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.jaccard_join import shingle_sets, signatures
from millrace.llm.links import connect


def test_rows_are_evaluated_once(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    buckets = [(1, 10), (1, 11), (1, 10), (2, 11), (2, 12), (3, 13), (4, 14), (4, 14), (5, 20), (5, 21), (5, 22)]
    source = spark.createDataFrame(buckets, "sig long, node long").mapInArrow(rows, "sig long, node long")
    seen = []

    def verify(pairs):  # all but 20 with others
        seen.extend((r.a, r.b) for r in pairs.collect())
        return pairs.filter("a <> 20")

    def compare(groups):
        assert sorted((r.head, r.node, r.label) for r in groups.collect()) == [(20, 20, 20), (20, 21, 21), (20, 22, 22)]
        return groups.sparkSession.createDataFrame([(21, 22)], "a long, b long")

    labels = connect(source, verify, compare)
    assert sorted(seen) == [(10, 11), (11, 12), (20, 21), (20, 22)]
    assert sorted((r.node, r.label) for r in labels.df.collect()) == [(10, 10), (11, 10), (12, 10), (21, 21), (22, 21)]
    assert made.value == len(buckets)
    labels.drop()


def test_unwanted_sets_have_no_signatures_and_others_the_same():
    texts = pa.array([" ".join(f"w{i}" for i in range(k, k + 40)) for k in (0, 0, 7, 300)] + ["", "one"])
    ((_, _, g, bounds, _, _),) = shingle_sets(texts, 4, True)
    sig, which = signatures(g, bounds, 85)
    wanted = np.array([True, False, True, True, True, False])
    some, of = signatures(g, bounds, 85, wanted)
    rows = lambda s, w: sorted(zip(w.tolist(), s.tolist()))
    assert rows(some, of) == [x for x in rows(sig, which) if wanted[x[0]]] and len(of)
    assert not len(signatures(g, bounds, 85, np.zeros(6, bool))[0])
