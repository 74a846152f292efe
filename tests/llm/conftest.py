from __future__ import annotations

import random

import pytest

#: Columns whose names the operators use inside, with other contents.
CLASHING = ["text_", "size", "node", "sig", "label", "place", "range", "words", "n", "_source", "items", "first"]


@pytest.fixture(scope="session")
def docs_frame(spark):
    """``make(rows)``: documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows):
        rows = [(*r, *[None] * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        for c in CLASHING:
            df = df.withColumn(c, df.doc_id * 0)
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, one word, repeated rows, ties, one very long text without a line end."""
    rng = random.Random(8)
    voc = [f"word{i}" for i in range(500)] + ["Ünï", "日本語", "a"]
    long = " ".join(rng.choice(voc) for _ in range(20_000))
    base = " ".join(rng.choice(voc) for _ in range(120))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, base), (6, base), (6, base), (7, base.upper()), (8, long), (9, long + " more"), (None, base), (None, None),
            (10, "\n".join(["the same line of several words here"] * 5)), (11, "x" * 50_000), (12, "!!! ... 123")]


@pytest.fixture(scope="session")
def corpus(spark, small):
    return [(r[0] + 100_000, *r[1:]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
