"""Filter audit, exact top-k and spelling variants against brute force, with odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import filter_audit as A
from millrace.llm import spelling as S
from millrace.llm import top_k as T
from millrace.llm.wavelet import WaveletMatrix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def audit_by_hand(docs, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    rows = defaultdict(list)
    for d, text, source in docs:
        text = text or ""
        w = WORDS.findall(text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > first[text]}
        rows[source or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out, total = {}, Counter()
    for part, mine in rows.items():
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[part, f] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone), f)
    return {k: (*v[:6], total[k[0], v[6]]) for k, v in out.items()}


def audited(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_filter_audit_by_brute_force(spark, docs_frame, odd_rows, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 1000)
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(voc[: rng.choice([20, 300])]) for _ in range(rng.choice([30, 49, 50, 51, 200]))) for _ in range(25)]
    texts = [t.upper() if i % 7 == 0 else t + " 5% #x" if i % 5 == 0 else t for i, t in enumerate(texts)] + ["Äé " * 60, "ABC" + "é" * 57, "ABC" + "é" * 56]
    rows = [(*r, None, rng.choice(["", None, "s1", "s2"])) for r in odd_rows] + [(100 + rng.randrange(60), rng.choice(texts), None, rng.choice(["s1", "s2", None])) for _ in range(150)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in rng.choices(range(170), k=120)] + [(None, 1, 1), (5, 1, 0), (5, 0, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(7)).withColumn("label", F.lit("x"))
    docs = docs_frame(rows).withColumn("mask", F.lit(1)).withColumn("part", F.lit("no")).withColumn("digest", F.lit(0)).repartition(3)
    assert audited(A.filter_audit(docs, table)) == audit_by_hand([(r[0], r[1], r[3]) for r in rows], labels)
    assert A.filter_audit(docs.limit(0), table).count() == 0
    assert {r.good_lost for r in A.filter_audit(docs, table.limit(0)).select("good_lost").distinct().collect()} == {0}


def test_filter_audit_hands_on_parts_and_finds_first_failures(spark, docs_frame, monkeypatch):
    monkeypatch.setattr(A, "MAX_PARTS", 3)
    rows = [(i, "few words", None, f"part{i % 9}") for i in range(400)]
    got = audited(A.filter_audit(docs_frame(rows).repartition(2), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got == audit_by_hand([(r[0], r[1], r[3]) for r in rows], [(1, 1, 1)])
    table = A.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for m in range(1, 32):
        assert all(o[table[m, j]] in {f for i, f in enumerate("ABCDE") if m >> i & 1} for j, o in enumerate(A.ORDERS))


def best_by_hand(vectors, asks, k):
    code = lambda v: None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * float(x))) for x in v]
    rows = [(i, c) for i, v in vectors if (c := code(v)) is not None]
    out = []
    for a, (i, q) in enumerate(rows):
        if i is not None and asks(i):
            found = [(-sum(x * y for x, y in zip(q, v)), j is None, j) for b, (j, v) in enumerate(rows) if b != a and len(v) == len(q)]
            out += [(i, n, x[2], -x[0]) for n, x in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(300, 6)).round(1)
    values[50:80] = values[50]  # ties
    values[7] = 0
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(values)]
    vectors += [(400, None), (404, [1.0, None] * 3), (408, [float("nan")] * 6), (412, [float("inf")] * 6), (None, [0.5] * 6), (60, [0.1] * 6), (60, [0.1] * 6), (416, []), (420, []), (424, [1.0, 2.0]), (428, [-1.0, 0.25])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("row", F.lit(0)).withColumn("code", F.lit("x")).repartition(3)
    vectors = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    for k, shard in ((5, 40), (3, 8192), (1, 7), (400, 100)):
        got = T.top_k(df, F.col("vec_id") % 4 == 0, k=k, shard_rows=shard)
        assert Counter(tuple(r) for r in got.collect()) == best_by_hand(vectors, lambda i: i % 4 == 0, k)
    assert T.top_k(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0
    assert T.top_k(df.filter("vec_id = 424"), F.col("vec_id") % 4 == 0).count() == 0


def test_threshold_stops_and_whole_numbers_stay_whole():
    rng = np.random.default_rng(2)
    codes = rng.integers(-100, 100, (4000, 3))
    codes[9] = [500, 500, -500]
    lists = T.SortedLists(np.arange(4000), np.arange(4000), np.zeros(4000, bool), codes)
    met = []
    for i in range(40):
        best, points, n = lists.top(codes[i], i, 5)
        full = codes @ codes[i]
        want = sorted((-int(s), j) for j, s in enumerate(full) if j != i)[:5]
        assert [(-int(p), int(j)) for p, j in zip(points, best)] == want
        met.append(n)
    assert max(met) < 4000 and np.median(met) < 1500
    big = np.array([[2**30 + 1, 3], [2**30, 5], [1, 1]])
    best, points, _ = T.SortedLists(np.arange(3), np.arange(3), np.zeros(3, bool), big).top(big[0], 0, 2)
    assert points.tolist() == [(2**30 + 1) * 2**30 + 15, 2**30 + 4]
    with pytest.raises(OverflowError):
        T.SortedLists(np.arange(2), np.arange(2), np.zeros(2, bool), np.array([[2**40], [2**40]])).top(np.array([2**40]), 0, 1)


def near_by_hand(words):
    near = defaultdict(set)
    less = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i] + w[i + 1 :]].add((i, w))
    for short, found in less.items():
        for i, w in found:
            near[w] |= {x for j, x in found if j == i and x != w}
            if short in words:
                near[w].add(short)
                near[short].add(w)
    return near


def forms_by_hand(words):
    near = near_by_hand(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_wavelet_matrix_reports_rectangles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 37, 200):
        values = rng.permutation(n)
        box = np.sort(rng.integers(0, n + 1, (4, 60)).reshape(2, 2, 60), axis=1)
        q, v = WaveletMatrix(values).report(box[0, 0], box[0, 1], box[1, 0], box[1, 1])
        want = {(i, int(x)) for i in range(60) for x in values[box[0, 0, i] : box[0, 1, i]] if box[1, 0, i] <= x < box[1, 1, i]}
        assert set(zip(q.tolist(), v.tolist())) == want and len(q) == len(want)


@pytest.mark.parametrize("chunk", [25, 50_000])
def test_near_words_by_brute_force(spark, chunk):
    rng = random.Random(chunk)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([5, 5, 6, 7, 8]))) for _ in range(300)} | {"".join(rng.choice("xyzuvÿàq") for _ in range(rng.randint(5, 12))) for _ in range(100)}
    words |= {"a" * n for n in (5, 6, 7, 8, 3000, 3001, 3003)} | {"ab" * 500, "ab" * 500 + "a", "ba" * 500, "a" + "ab" * 500}
    words = {w: rng.randint(3, 40) for w in words}
    got = S.near_words(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), chunk)
    near = near_by_hand(words)
    want = {(w, len(x), b := min(x, key=lambda y: (-words[y], y)), words[b]) for w, x in near.items() if x}
    assert {tuple(r) for r in got.collect()} == want


def test_spelling_variants_by_brute_force(spark, docs_frame, odd_rows, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 50)
    monkeypatch.setattr(S, "MAX_COUNTED", 40)
    monkeypatch.setattr(S, "ASKED", 30)
    rng = random.Random(3)
    voc = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = list(odd_rows) + [(i, " ".join(rng.choice(voc[: rng.choice([5, 60])]) + rng.choice(["", ".", "1"]) for _ in range(150)).replace("a", rng.choice("aA"))) for i in range(40)]
    counts = Counter()
    for name, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for r in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if name is None else name}:{r}".encode())
            counts[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    df = docs_frame(rows).withColumn("word", F.lit(1)).withColumn("form", F.lit(2)).repartition(3)
    got = S.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == forms_by_hand(words) and got.count() == len(words)
    assert S.spelling_variants(df.limit(0)).count() == 0


def test_forms_are_followed_to_the_end(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("x", "w39"), ("y", "z")]
    got = dict(S.follow(spark.createDataFrame(links, "word string, form string")).collect())
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "x": "w40", "y": "z"}


def test_texts_are_read_in_pieces_as_in_one(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab É1#AB\n\t") for _ in range(n)) for n in (0, 1, 40, 500, 3000)] + ["a" * 400]
    whole = [(A.failed_filters(t.encode()), S.runs_of(t.encode())) for t in texts]
    monkeypatch.setattr(A, "PIECE", 7)
    monkeypatch.setattr(S, "PIECE", 7)
    assert [(A.failed_filters(t.encode()), S.runs_of(t.encode())) for t in texts] == whole
