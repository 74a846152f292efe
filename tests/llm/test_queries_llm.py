"""The registered queries themselves, and the pipeline's stages against brute force and with columns of clashing names."""

from __future__ import annotations

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries

WORDS, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = {
    "op1_langid": ["doc_id", "held_out", "lang_pred", "score"], "op2_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_jaccard": ["doc_id", "n_shingles", "component_id"], "op4_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op6_html": ["page_id", "url", "text", "n_chars"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op9_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]}
#: Queries whose rows are not those of a table.
MORE = {
    "op11_topk": ["query_id", "rank", "vec_id", "score"], "op12_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_filters": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, name):
    out = queries.queries()[name](spark, small)
    table = "pages" if name in ("op6_html", "op10_warc") else "embeddings" if name == "op9_embeddings" else "documents"
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert out.count() == spark.read.parquet(f"{small}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    result = db.execute(queries.oracle_sql()[name])
    out = queries.queries()[name](spark, small).select(*[d[0] for d in result.description])
    assert out.columns == (COLUMNS | MORE)[name]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_held_out_rows(spark, small):
    got = queries.op1_langid(spark, small).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 20


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t)


def test_stages_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(150)
    rows = docs.collect()
    near = {tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()}
    sets = []
    for r in rows:
        w = WORDS.findall(lower(r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    stays = {}
    for i, r in enumerate(rows):
        stays.setdefault(root[i], []).append(r.doc_id)
    assert {r[0] for r in near} == {min(ids) for ids in stays.values()} and len(near) == len(stays)

    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, small).collect()}
    items = [ALNUM.findall(lower(r.text or "")) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {tuple(x[i : i + 10]) for x in items for i in range(len(x) - 9)} | {tuple(x) for x in items if 0 < len(x) < 10}
    sizes = {len(x) for x in windows}
    for r in rows:
        w = ALNUM.findall(lower(r.text or ""))
        assert (r.doc_id in clean) != any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))


def test_stages_with_clashing_columns_and_odd_rows(spark, small):
    clashing = ["score", "lang_pred", "mixture", "_id", "row", "place", "id", "items", "spans", "contaminated", "carry", "size", "copies", "taken", "rate", "_source", "component_id", "node", "_copy"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    text = "the same words are here twice and more than five of them"
    odd = spark.createDataFrame([(None, text, "en", None, 0), (None, text, "en", None, 0), (7_001, text, "en", "src0", 0), (7_001, None, "en", None, None), (7_001, "", None, "src1", 0),
                                 (7_002, "word " * 20_000, "en", "src1", 1), (7_002, "word " * 20_000, "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(odd).select("*", *[F.col("n_chars").alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        got = out.collect()
        empty = stage(spark, docs.limit(0), small)
        assert empty.count() == 0
        if name == "sharding":
            assert len(got) == docs.count()
            continue
        assert out.columns == docs.columns == empty.columns
        if name == "near_duplicates":
            assert sum(r.text == text for r in got) == 1 and sum(r.doc_id == 7_002 for r in got) == 1 and sum(r.doc_id == 7_001 for r in got) == 3 - (0 if any(r.doc_id == 7_001 and r.text == text for r in got) else 1)
        if name == "decontamination":
            assert sum(not r.text for r in got) == sum(not r.text for r in docs.collect())
