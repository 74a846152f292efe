"""A benchmark too large to be sent: joined fingerprints give what the sent benchmark gives, with hot passages and a full map."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate
from millrace.llm.decontaminate import _runs, find_contamination


@pytest.mark.parametrize(("hot", "bits"), [(4, 26), (100_000, 8)])
def test_joined_as_sent(spark, monkeypatch, hot, bits):
    """A passage that half of the documents and items share, short items, repeated ids and rows, nulls, ids that are strings."""
    monkeypatch.setattr(decontaminate, "HOT_ROWS", hot)
    monkeypatch.setattr(decontaminate, "MAP_BITS", bits)
    rng = random.Random(12)
    voc = [f"w{i}" for i in range(400)] + ["Ünï", "日本"]
    say = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    passage = say(25)
    items = [(f"i{i}", f"{say(rng.randint(1, 30))} {passage if i % 2 else ''}") for i in range(30)]
    items += [("i3", say(12)), ("short", "w1 w2"), ("one", "W3."), ("empty", " .,"), ("null", None), (None, passage)]
    docs = [(i, "; ".join([say(rng.randint(0, 80)), passage.upper() if i % 2 else say(5), rng.choice(items[:30])[1]])) for i in range(60)]
    docs += [(70, None), (71, ""), (71, ""), (3, docs[3][1]), (None, passage), (72, say(20_000))]
    bench = spark.createDataFrame(items, "item_id string, text string").repartition(5)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("x"), "words": F.lit(1), "hot": F.lit(2), "length": F.lit(3), "print": F.col("doc_id")}).repartition(7)

    def result(**kw):
        found = find_contamination(rows, bench, carry=("row", "hot", "print"), **kw).collect()
        spans = lambda r: tuple(_runs([(s["a"], s["b"]) for s in r["spans"]]))
        return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, tuple(r["items"]), spans(r), r.row, r.hot, r.print) for r in found)

    whole = result()
    assert result(max_block_words=1) == whole
    assert len(whole) == len(docs) and 30 < sum(r[5] for r in whole) < len(docs) and max(r[3] for r in whole) >= 15


def test_joined_with_nothing(spark):
    """A benchmark without words, and no documents."""
    rows = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ". , ; . , ;"), (2, None)], "item_id long, text string")
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in find_contamination(rows, bench, max_block_words=0).orderBy("doc_id").collect()] == [(1, 3, 0, 0), (2, 0, 0, 0)]
    assert find_contamination(rows.limit(0), bench, max_block_words=0).count() == 0
