"""Names of words and sets: patterns that cancel out in weak hashes, and names that do collide."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import textkit
from millrace.llm.decontaminate import Index
from millrace.llm.jaccard_join import distinct_names, exact_sets, jaccard_groups, named_sets, within
from millrace.llm.substring_dedup import remove_repeats
from millrace.llm.textkit import Words, blocks, byte_table


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 32, 64, 128, 1024, 4096])
def test_mirrored_words_differ(spark, n):
    x, y = thue_morse(n)
    for _, _, w in blocks(pa.array([f"{x} {y}"]), byte_table("spaces")):
        assert w.name[0] != w.name[1] and w.second_names()[0] != w.second_names()[1] and not w.same(np.array([0]), np.array([1]))[0]


def test_mirrored_words_in_the_operators(spark):
    x, y = thue_morse(1024)
    docs = spark.createDataFrame([(1, x), (2, y), (3, " ".join([x] * 20)), (4, " ".join([x] * 19 + [y])), (5, " ".join([x] * 20))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in remove_repeats(docs, 20).collect()}
    assert got[4] == (0, hashlib.sha256(" ".join([x] * 19 + [y]).encode()).hexdigest()) and got[5][0] == 20 and got[3][0] == 0


def test_colliding_names_are_told_apart_by_their_words(monkeypatch):
    true_names = Words._names
    monkeypatch.setattr(Words, "_names", lambda self, *a: true_names(self, *a) & np.uint64(7))
    texts = [" ".join(f"word{(i * k) % 90}" for i in range(120)) for k in (1, 1, 7)] + [" ".join(f"term{i}" for i in range(120)), "one two", "one three"]
    real = [{tuple(t.split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))} for t in texts]
    for _, _, w in blocks(pa.array(texts), byte_table("spaces")):
        assert not distinct_names(w, 4)
        assert [len(x) for x in exact_sets(w, 4)] == [len(x) for x in real]
    nodes = [int(textkit.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), byte_table("spaces"), True).digests()[0][0]) for t in texts]
    sets = named_sets(nodes, pa.array(texts), 4, True)
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes):
            assert within(sets[a], sets[b], 85) == (100 * len(real[i] & real[j]) >= 85 * len(real[i] | real[j]))


def test_benchmark_with_colliding_names(monkeypatch):
    true_names = Words._names
    monkeypatch.setattr(Words, "_names", lambda self, *a: true_names(self, *a) & np.uint64(3))
    items = pa.table({"i": [1, 2, 3], "t": [" ".join(f"w{i}" for i in range(12)), "just three words", " ".join(f"v{i}" for i in range(30))]})
    index = Index(items, 10, 5)
    texts = ["x " + " ".join(f"w{i}" for i in range(1, 12)) + " y", "here are just three words too", " ".join(f"u{i}" for i in range(30))]
    for _, _, w in blocks(pa.array(texts), byte_table("alnum"), lower=True):
        found, spans = index.hits(w)
    assert found == [{0}, {1}, set()] and spans == [[(1, 12)], [(2, 5)], []]
