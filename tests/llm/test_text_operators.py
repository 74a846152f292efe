"""Text operators against brute force, on whole texts, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, links, substring_dedup
from millrace.llm.decontaminate import find_contamination
from millrace.llm.jaccard_join import jaccard_groups, scheme
from millrace.llm.langid import fit, identify
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.substring_dedup import remove_repeats

WORDS, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def groups_of(links_, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links_:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts(seed=5):
    rng, voc, out, n = random.Random(seed), [f"w{i}" for i in range(300)], [], 10_000
    for size in [*range(1, 40), 60, 90, 200, 400]:
        base = [rng.choice(voc) for _ in range(size)]
        for k in range(4):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 35)) if k else 0):
                i, how = rng.randrange(len(w)), rng.random()
                w[i : i + 1] = [] if how < 0.3 and len(w) > 1 else [w[i], rng.choice(voc)] if how < 0.6 else [rng.choice(voc)]
            out.append((n, " ".join(w)))
            n += 1
    base = [rng.choice(voc) for _ in range(160)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(160)] = rng.choice(voc)
        out.append((n, " ".join(w)))
        n += 1
    return out


@pytest.mark.parametrize(("n", "num", "rows_a_block"), [(4, 85, 512), (5, 80, 16), (3, 60, 512)])
def test_jaccard_groups(docs_frame, odd_rows, corpus, monkeypatch, n, num, rows_a_block):
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", rows_a_block)
    rows = [r[:2] for r in corpus] + near_texts() + [(i, t) for i, t in odd_rows if i is not None]
    sets = {}
    for i, t in rows:
        w = WORDS.findall(lower(t))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[j : j + n]) for j in range(len(w) - n + 1)])
    inverted, linked = {}, []
    for i, s in sets.items():
        seen = Counter(j for g in s for j in inverted.get(g, ()))
        linked += [(i, j) for j, both in seen.items() if 100 * both >= num * (len(s) + len(sets[j]) - both)]
        for g in s:
            inverted.setdefault(g, []).append(i)
    want = groups_of(linked, sets)
    got = jaccard_groups(docs_frame(rows), n, num).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want) - 50


def test_jaccard_odd_rows(docs_frame, odd_rows):
    got = {(r.doc_id, r.n_shingles > 0): r.component_id for r in jaccard_groups(docs_frame(odd_rows)).collect()}
    assert got[None, True] == 5 and got[None, False] is None and got[7, True] == 5 and got[2, False] == 2
    assert jaccard_groups(docs_frame([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("num", [50, 60, 80, 85, 95])
def test_every_scheme_satisfies_the_pigeonhole(num):
    sizes = {}
    for n in range(1, 20_000):
        sizes[jaccard_join.band(n, num)] = n
    for b, hi in sizes.items():  # the largest set of each band, and the largest one it can link with
        m, a, g = scheme(b, num)
        h = (100 - num) * (hi + hi * 100 // num) // (100 + num)
        assert 0 <= g < max(m, 1) and a in (0, m)
        assert (m - g) * (2 if a else 1) >= h + 1, (b, m, a, g, h)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_substrings(docs_frame, odd_rows, corpus, most):
    rng, voc = random.Random(7), [f"w{i}" for i in range(40)]
    shared = [rng.choice(voc) for _ in range(400)]
    rows = [r[:2] for r in corpus] + [(i, t) for i, t in odd_rows if i is not None and i != 6]
    for i in range(100):
        w = []
        while len(w) < rng.randint(5, 200):
            r = rng.random()
            if r < 0.3:
                a = rng.randrange(380)
                w += shared[a : a + rng.randint(10, 60)]
            elif r < 0.5:
                w += [rng.choice(voc[:2])] * rng.randint(1, 50)
            elif r < 0.6:
                w += ["a", "b"] * rng.randint(1, 30)
            else:
                w += [rng.choice(voc) for _ in range(rng.randint(1, 30))]
        rows.append((20_000 + i, "  ".join(w) + "\n"))
    seen, want = set(), {}
    for i, t in sorted(rows):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs_frame(rows), 20, max_sent=most).collect()}
    assert got == want


def test_substring_odd_rows(docs_frame, odd_rows):
    got = remove_repeats(docs_frame(odd_rows), 20, with_text=True).collect()
    assert len(got) == len(odd_rows)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[None, 120].n_removed == 0 and by[5, 120].n_removed == 120 and by[5, 120].kept == "" and by[8, 20_000].n_removed == 0
    assert by[9, 20_001].n_removed == 20_000 and by[9, 20_001].kept == "more"
    assert all(r.n_removed == 120 for r in got if r.doc_id == 6)
    assert remove_repeats(docs_frame(odd_rows).limit(0)).count() == 0
    texts = docs_frame([(1, "a b"), (2, None)]).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    assert {r.doc_id for r in remove_repeats(texts).collect()} == {"id1", "id2"}


def test_decontamination(spark, docs_frame, odd_rows, corpus, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "the of"), (901, "and"), (902, ""), (903, None), (904, "the The OF and of the"), (None, "one"), (901, "and")]
    rows = [r[:2] for r in corpus] + [(i, t) for i, t in odd_rows if i is not None]
    wins = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        if i is not None and w:
            for j in range(max(1, len(w) - 9)):
                wins.setdefault(tuple(w[j : j + 10]), set()).add(i)
    want = set()
    for i, t in rows:
        w, found = ALNUM.findall(lower(t)), set()
        hit = [False] * len(w)
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if own := wins.get(tuple(w[j : j + k])):
                    found |= own
                    hit[j : j + k] = [True] * k
        want.add((i, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for kw in ({}, {"max_block_words": 600}, {"k": 3}):
        got = find_contamination(docs_frame(rows), bench, **kw)
        assert {tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()} == want
    none = find_contamination(docs_frame(odd_rows), bench.limit(0)).collect()
    assert len(none) == len(odd_rows) and not any(r.contaminated for r in none)
    assert find_contamination(docs_frame(odd_rows).limit(0), bench).count() == 0


def test_language_id(docs_frame, corpus, odd_rows):
    docs = docs_frame(corpus)
    train = docs.filter(F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in identify(docs, fit(train)).collect()}
    held = [(i, lang) for i, _, lang, _ in corpus if i % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = identify(docs_frame(odd_rows), fit(train)).collect()
    assert len(odd) == len(odd_rows)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} >= {1, 2, 3, 12} and all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert {r.lang_pred for r in identify(docs, fit(train.limit(0))).collect()} == {"und"}
    assert identify(docs.limit(0), fit(train)).count() == 0


def test_language_mixtures(docs_frame, corpus):
    longest = {}
    for _, t, lang, _ in corpus:
        longest[lang] = max(longest.get(lang, ""), t, key=len)
    a, b = (longest[x][:4000] for x in ("en", "de"))
    r = identify(docs_frame([(1, a + " " + b), (2, a)]), fit(docs_frame(corpus))).orderBy("doc_id").collect()
    assert set(r[0].mixture) == {"en", "de"} and 0.35 < r[0].score < 0.65 and r[1].mixture == {"en": 1.0}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normal(line):
    return " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()) if w)


def test_fuzzy_lines_against_edit_similarity(docs_frame, corpus):
    """Whatever goes is linked by edit similarity, and at least 0.9 of what is linked goes, on lines of the corpus with a word
    or a letter changed."""
    rng = random.Random(3)
    pool = sorted({x for _, t, *_ in corpus for x in (t or "").split("\n") if 5 <= len(normal(x).split()) <= 60 and len(normal(x)) >= 30})
    rng.shuffle(pool)
    lines = pool[:260]
    for x in lines[:160]:
        w = x.split(" ")
        i = rng.randrange(len(w))
        w[i] = rng.choice(rng.choice(pool).split(" ")) if rng.random() < 0.6 else w[i] + "x"
        lines.append(" ".join(w) if rng.random() < 0.7 else " ".join(w).upper())
    norm = [normal(x) for x in lines]
    linked = [(i, j) for i in range(len(norm)) for j in range(i) if abs(len(norm[i]) - len(norm[j])) <= 0.2 * max(len(norm[i]), len(norm[j]))
              and edit_distance(norm[i], norm[j]) <= 0.2 * max(len(norm[i]), len(norm[j]))]
    group = groups_of(linked, range(len(norm)))
    got = {r.doc_id: r.n_removed for r in dedup_lines(docs_frame(list(enumerate(lines)))).collect()}
    want = [i for i in group if group[i] != i]
    gone = [i for i in got if got[i]]
    assert len(want) > 100 and set(gone) <= {i for i, j in linked} | {j for i, j in linked}
    for g in set(group.values()):  # one of each connected group stays at least
        assert any(not got[i] for i in group if group[i] == g)
    assert len(gone) >= 0.9 * len(want), (len(gone), len(want))


def test_odd_lines(docs_frame, odd_rows):
    odd = {(r.doc_id, r.n_lines): r for r in dedup_lines(docs_frame(odd_rows), with_text=True).collect()}
    assert odd[1, 0].kept == "" and odd[10, 5].n_removed == 4 and odd[None, 1].n_removed == 0 and odd[5, 1].n_removed == 1
    assert odd[8, 1].n_removed + odd[9, 1].n_removed == 1  # 100 thousand characters, one word more
    assert dedup_lines(docs_frame(odd_rows).limit(0)).count() == 0


def test_near_copies_of_one_line(docs_frame):
    """A large group of variants of one line, near to it and not to each other, keeps one."""
    rng = random.Random(2)
    base = [f"word{chr(97 + i)}{i * 37 % 100}" for i in range(20)]
    rows = [(i, " ".join(base)) for i in range(50)]
    for i in range(50, 400):
        w = list(base)
        for j in rng.sample(range(20), 2):
            w[j] = f"other{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = [r.n_removed for r in dedup_lines(docs_frame(rows)).collect()]
    assert sum(got) >= 0.97 * (len(rows) - 1)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    want = groups_of(edges, {x for e in edges for x in e})
    lone = {x for e in edges for x in e} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.label for r in links.components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    assert got == {k: v for k, v in want.items() if k not in lone}
    assert links.components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def test_signatures_depend_on_the_window_only():
    import numpy as np
    import pyarrow as pa

    from millrace.llm.textkit import blocks, byte_table

    rng, voc = random.Random(9), ["a", "b", "c", "dd"]
    window = [rng.choice(voc) for _ in range(20)]
    texts = [" ".join([rng.choice(voc) for _ in range(rng.randrange(9))] + window + [rng.choice(voc) for _ in range(rng.randrange(9))]) for _ in range(200)]
    found = set()
    for _, _, w in blocks(pa.array(texts), byte_table("spaces")):
        at, sig, _ = substring_dedup.window_signatures(w, 20)
        grams = w.grams(20)
        target = Counter(grams[at].tolist()).most_common(1)[0][0]
        found |= set(sig[grams[at] == np.uint64(target)].tolist())
    assert len(found) == 1
