"""What the review of round 1 found cut short."""

from __future__ import annotations

import math

import pytest

from millrace.llm import embedding_dedup
from millrace.llm.common import Table
from millrace.llm.embedding_dedup import audit_recall, near_duplicates
from millrace.llm.html_extract import extract_main_text, main_text
from millrace.llm.queries import op8_lines


def removed_by_op8(docs_frame, path, rows):
    docs_frame(rows).select("doc_id", "text").write.parquet(f"{path}/documents.parquet")
    return {r.doc_id: r.n_removed for r in op8_lines(docs_frame(rows).sparkSession, str(path)).collect()}


def test_lines_alike_but_for_digits_or_a_fifth(docs_frame, tmp_path):
    line = "report of the meeting held on day {} of month {} page {}"
    rows = [(1, line.format(12, 10, 7)), (2, line.format(27, 11, 4)), (3, "one entirely different line about other things")]
    # Words of two letters have no weight in the SimHash: these are within three bits, at similarity 0.82.
    rows += [(4, "aa bb cc dd extraordinarily incomprehensible"), (5, "ee ff gg hh extraordinarily incomprehensible")]
    assert removed_by_op8(docs_frame, tmp_path, rows) == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_short_lines_and_lines_without_spaces(docs_frame, tmp_path):
    thai = "ภาษาไทยเขียนโดยไม่มีช่องว่างระหว่างคำ"
    rows = [(1, "Read more\n\n日本語の長い行には空白がありません\n* * *"), (2, f"read MORE!\n\n日本語の長い行には空白がありません\n* * *\n{thai}"), (3, f"{thai}\nRead less\n ")]
    assert removed_by_op8(docs_frame, tmp_path, rows) == {1: 0, 2: 3, 3: 1}


def on_circle(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def test_audit_averages_over_nodes_and_guards_every_turn(spark, monkeypatch):
    group = [(i, 1, on_circle(i * 0.001)) for i in range(200)]
    pairs = [(1000 + i, 1, on_circle(90 + i // 2 * 4 + i % 2 * 0.01)) for i in range(80)]
    nodes = spark.createDataFrame(group + pairs, "node long, mult long, embedding array<double>")
    found = spark.createDataFrame([(i, 199, None) for i in range(200)], "node long, links long, label long")
    assert abs(audit_recall(nodes, found, 0.9999, every=1) - 200 / 280) < 1e-9
    assert audit_recall(nodes.filter("node % 2 = 0 and node >= 1000"), found, 0.9999) is None
    monkeypatch.setattr(embedding_dedup, "_links", lambda *a: Table(found.limit(0), "none"))
    with pytest.raises(RuntimeError, match="recall 0.0000"):
        near_duplicates(nodes.selectExpr("node AS vec_id", "embedding"), 0.9999)


def test_elements_without_a_closing_tag():
    for page in ("<p>one<svg class=icon/> two</p><p>three", "<p>one<math/> two</p><p>three", "<div>one two<svg><path d=x></div><p>three", "<p>one two</p><svg><g><p>three",
                 "<div>one two<canvas></div><p>three", "<div>one two<select><option>x</div><p>three", "<p>one <svg><text>x</text></svg>two</p><p>three"):
        assert main_text(page, "", frozenset()) == "one two three", page
    assert main_text("<p>one<script>a <p>b", "", frozenset()) == "one"


def test_importance_decides_for_classes_of_known_hosts(spark):
    wrap = ("<div class='content with-sidebar'><p>Story {0}</p></div>", "<div id=search-results><p>Story {0}</p></div>",
            "<article><header class='entry-header'><h1>Story {0}</h1></header></article>", "<div class='content with-sidebar'><article>Story {0}</article></div>")
    rows = [(100 * h + i, f"http://h{h}.example/{i}", w.format(i) + "<div class=sidebar><p>Links</p></div><div class='comment-list'>hi {0}</div>".format(i)) for h, w in enumerate(wrap) for i in range(12)]
    rows.append((900, "http://few.example/1", "<div class=sidebar><p>Links</p></div><p>alone</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (200_000, 0):
        got = {r.page_id: r.text for r in extract_main_text(pages, max_sent=most).collect()}
        assert got == {100 * h + i: f"Story {i}" for h in range(4) for i in range(12)} | {900: "alone"}
