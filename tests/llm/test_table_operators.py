"""Mixing, sharding, pages, archives, vectors and the pipeline: laws, exact round trips and brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import embedding_dedup, warc
from millrace.llm.embedding_dedup import near_duplicates
from millrace.llm.html_extract import extract_main_text, main_text
from millrace.llm.mixing import capped_targets, entropy_balance, mix_to_targets
from millrace.llm.sharding import shard_by_bytes
from millrace.llm.warc import plan_records, read_warc, round_trip, write_warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_capped_targets():
    sizes = {"a": 100, "b": 100, "c": 100, None: 300}
    assert capped_targets(sizes) == pytest.approx({"a": 600 / 7, "b": 1200 / 7, "c": 1800 / 7, None: 600 / 7})
    got = capped_targets({"a": 1000, "b": 10, "c": 0})
    assert got["b"] == 30 and got["c"] == 0 and got["a"] == 980 and all(isinstance(v, float) for v in got.values())
    assert capped_targets({}) == {}


def test_entropy_balance_meets_joint_constraints(spark):
    rng = random.Random(4)
    rows = [(rng.uniform(1, 9), [(rng.randrange(3), 1.0), (3, rng.uniform(0, 2))]) for _ in range(200)]
    m = entropy_balance(spark.createDataFrame(rows, "mass double, features array<struct<k:int,v:double>>"), {0: 200.0, 1: 500.0, 2: 300.0, 3: 1100.0})
    w = [x * np.exp(sum(m[k] * v for k, v in f)) for x, f in rows]
    for k, t in ((0, 200), (1, 500), (2, 300), (3, 1100)):
        assert sum(a * v for a, (_, f) in zip(w, rows) for j, v in f if j == k) == pytest.approx(t, rel=1e-6)


def test_more_sources_than_an_expression_holds(spark):
    rows = [(i, "word " * (1 + i % 7), f"s{i % 5000:04}") for i in range(15_000)]
    got = mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r, (_, _, s) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        by.setdefault(s, []).append(r)
        assert r.taken <= 3 * r.size
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    targets = capped_targets(sizes)
    assert all(rs[0].target == pytest.approx(targets[s]) and abs(sum(r.taken for r in rs) - targets[s]) <= max(r.size for r in rs) for s, rs in by.items())


def test_mixing_laws(docs_frame, corpus, odd_rows):
    rows = corpus + [(i, t, None, random.Random(i or 0).choice(["src1", None, "tiny"])) for i, t in odd_rows] + [(500, "alone " * 3, None, "one")]
    got = mix_to_targets(docs_frame(rows)).collect()
    again = mix_to_targets(docs_frame(rows)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(WORDS.findall(t or ""))
    want, taken = capped_targets(size), {}
    source = {i: s for i, _, _, s in rows if i is not None}
    for r in got:
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
            taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in [x for x in size if x and x.startswith("src") and x != "src1"]:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 20
    assert mix_to_targets(docs_frame(rows).limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding_laws(docs_frame, corpus, odd_rows, shards):
    rows = [r[:2] for r in corpus] + odd_rows + [(7000 + i, "hot copy " * 20) for i in range(150)] + [(8000, "same row")] * 60
    got = shard_by_bytes(docs_frame(rows), shards, ranges=16).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    size = sorted(len((t or "").encode()) + 16 for _, t in rows)
    assert sorted(r["size"] for r in got) == size
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows if i not in (None,)}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got if r.doc_id is not None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - sum(size) / shards) <= size[-1]
    assert shard_by_bytes(docs_frame(rows).limit(0), shards).count() == 0


def test_html(spark):
    site = [(i, f"http://h.example/{i}", f"<html><body class='x-sidebar'><div class=a1>Same words on all pages</div><div class=wrap><p>Text number {i} is <b>its</b> own&nbsp;&amp; more"
             f"<p>Second {i * 7}</div><div class='q'><p>Always this</p></div><div id=comments><p>hi {i}</div></body>") for i in range(15)]
    odd = [(100, None, None), (101, "", ""), (102, "http://z/", "<p>only &lt;x&gt; <br>here<script>a<b</script> ok</P><form>no</form> tail"), (103, "http://z/2", "plain 3 < 4 text"),
           (104, "http://y/", "<header>top</header><article class='with-sidebar'><header><h1>T&eacute;st</h1></header><p>one\n two<ul><li>a<li>b</ul><footer>f</footer></article><aside>s</aside>"),
           (105, "http://y/2", "<main><p>body</p><section class='comments'><article class=comment><p>c</p></article></section></main><nav>n"), (106, "no url", "<b>x"), (106, "no url", "<b>x")]
    pages = spark.createDataFrame(site + odd, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit(1), "node": F.lit(2)})
    for most in (200_000, 0):
        got = extract_main_text(pages, max_sent=most).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(site + odd) and all(r.n_chars == len(r.text) for r in got)
        assert all(by[i] == f"Text number {i} is its own & more Second {i * 7}" for i in range(15))
        assert [by[i] for i in range(100, 107)] == ["", "", "only <x> here ok tail", "plain 3 < 4 text", "Tést one two a b", "body", "x"]
    assert extract_main_text(pages.limit(0)).count() == 0
    assert main_text("<p>" + "word " * 100_000, "", frozenset()).count("word") == 100_000


def expected_records(rows):
    groups, out = {}, {}
    for i, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    for b, ids in groups.items():
        for i in ids:
            again = len(b) >= 1000 and i != max(ids)
            out[i] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", max(ids) if again else None, None if again else b)
    return out


def test_archives_round_trip(spark):
    rng = random.Random(1)
    texts = ["a" * 1500, None, "", "short", "a" * 1500, "short", "b" * 17_000_000, *("".join(chr(rng.randrange(32, 0x2000)) for _ in range(3000)) for _ in range(60))]
    pages = spark.createDataFrame([(i, None if i % 2 else f"http://x/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").withColumn("digest", F.lit(0))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in round_trip(pages).collect()}
            assert got == expected_records(enumerate(texts))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert round_trip(pages.limit(0)).count() == 0
    assert [tuple(r)[:4] for r in round_trip(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).collect()] == [(None, 0, hashlib.sha1(b"").hexdigest(), "response")]


def test_archives_are_plain_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "w")
    write_warc(plan_records(pages), path)
    content = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("part-*")))
    assert content.count(b"WARC/1.1\r\n") == 20 and b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"page 3").digest()) in content
    assert read_warc(spark, path, payloads=False).filter("payload is not null").count() == 0


@pytest.mark.parametrize("size", ["1m", "300", "70"])
def test_false_magic_damage_and_foreign_members(spark, tmp_path, size):
    """Magic bytes inside members, across range boundaries; a member that is no record; a damaged one."""
    rng = random.Random(3)
    inner = gzip.compress(bytes(rng.randrange(256) for _ in range(150)))
    records = [warc.record(i, None, inner * 3 + bytes([i]), "00" * 20, 0, None, False) for i in range(6)]
    store = lambda b: (lambda z: z.compress(b) + z.flush())(zlib.compressobj(0, zlib.DEFLATED, 31))
    members = [store(r) for r in records]
    assert all(m.count(warc.MAGIC) == 4 for m in members)
    damaged = bytearray(warc.gzip_member(records[5]))
    damaged[30] ^= 0xFF
    (tmp_path / "a.warc").write_bytes(b"".join([*members[:2], gzip.compress(b"no record"), *members[2:4], bytes(damaged), *members[4:5]]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r.row: bytes(r.payload) for r in read_warc(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: inner * 3 + bytes([i]) for i in range(5)}


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    rows = [(1000 + i, [float(z) for z in base[i % 40] + rng.normal(size=24) * 0.2]) for i in range(500)]
    rows += [(5000 + i, rows[i % 7][1]) for i in range(60)]
    odd = [(1, None), (2, [0.0] * 24), (3, [1.0] * 23 + [None]), (4, [float("nan")] * 24), (5, [1.0, 2.0]), (6, [2.0, 4.0]), (7, []), (8, [1.0, 2.0]), (9, [float("inf"), 1.0]), (10, [1e300, -1e300]), (11, [1e-300, -1e-300])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "label": F.lit(0)})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = ids.copy()
    for _ in range(len(ids)):
        new = np.array([min(label[i], label[linked[i]].min(initial=1 << 60)) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    for piece in (4000, 60):
        monkeypatch.setattr(embedding_dedup, "PER_PIECE", piece)
        monkeypatch.setattr(embedding_dedup, "PER_CENTRE", 120)
        got = {r.vec_id: r for r in near_duplicates(df).collect()}
        have = np.array([got[i].n_links for i in ids])
        assert (have <= linked.sum(1)).all() and have.sum() >= 0.98 * linked.sum()
        assert np.mean([got[i].component_id == c for i, c in zip(ids, label)]) > 0.98
        assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (1, 2, 3, 4, 7, 9, 5, 6, 8)] == [(0, i, True) for i in (1, 2, 3, 4, 7, 9)] + [(2, 5, True), (2, 5, False), (2, 5, False)]
        assert got[10].component_id == got[11].component_id == 10
    assert near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "", None, None, 0), (10_003, "1234 !!", "en", "src1", 7)], docs.schema)
    at = docs.unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, corpus_pipeline.Table(stage(spark, at, small), "test").df
        seen[name] = at
        if name != "sharding":
            assert at.columns == docs.columns
        if name == "language_id":
            assert at.filter("doc_id > 10000").count() == 0 and at.count() >= 0.99 * docs.count()
        if name == "near_duplicates":
            texts = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (WORDS.findall(r.text.lower()) for r in at.select("text").collect())]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(texts) for b in texts[i + 1 :])
            assert at.count() < before.count()
        if name == "decontamination":
            assert corpus_pipeline.find_contamination(at, spark.read.parquet(f"{small}/benchmark.parquet")).filter("contaminated").count() == 0
    assert seen["sharding"].count() == seen["mixing"].count() > 0
    assert corpus_pipeline.run(spark, small).count() > 0
