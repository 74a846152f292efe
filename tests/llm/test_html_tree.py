"""The style tree against a brute-force version, and pages that are hard to parse."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import pytest

from millrace.llm.html_extract import extract_main_text, main_text, style_counts


def test_style_tree_by_brute_force(spark):
    rng = random.Random(4)
    shared = [f"shared words number {i}" for i in range(6)]
    rows, blocks, styles, contents = [], {}, defaultdict(list), defaultdict(list)
    for host in range(5):
        for page in range(3 + 2 * host):
            body, texts, kids = [], [], []
            own_contents = set()
            for label in sorted(rng.sample("abcdefgh", 5)):
                say = rng.choice(shared[:2]) if label < "d" else f"page {page} of {host} says {label}" if label > "f" or rng.random() < 0.4 else rng.choice(shared[2:])
                body.append(f"<div class={label}1><p>{say}</p></div>")
                texts.append((label, say))
                kids.append(label)
                own_contents.add((label, say))
                styles[host, label].append("p")
            styles[host, ""].append(tuple(kids))
            for label, say in own_contents:
                contents[host, label].append(say)
            rows.append((100 * host + page, f"http://h{host}.example/{page}", "<body>" + "".join(body) + f"<i>{page}</i></body>"))
            blocks[100 * host + page] = (host, [*texts, ("", str(page))])

    def gone(host, label):
        if not label:
            return False
        # The node that holds the text is the p in the div: no children of its own, contents as counted.
        m = len(styles[host, label])
        if len([r for r in rows if r[0] // 100 == host]) < 4 or m < 4:
            return False
        n = Counter(contents[host, label])
        content = 1 - sum(math.log(k) for k in n.values()) / len(n) / math.log(m)
        return 0.1 * 0.0 + 0.9 * content < 0.3

    want = {i: " ".join([s for label, s in texts if not gone(host, label)]) for i, (host, texts) in blocks.items()}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert any(gone(h, x) for h, x in contents) and not all(gone(h, x) for h, x in contents)
    for most in (200_000, 0):
        assert {r.page_id: r.text for r in extract_main_text(pages, max_sent=most).collect()} == want


@pytest.mark.parametrize(("page", "want"), [
    ("<body><form action=x><article><p>Story</p></article><input></form></body>", "Story"),
    ("<body><form action=x><div><p>Story of the page</p><button>Go</button></div></form></body>", "Story of the page"),
    ("<body><p>A longer story text here</p><form><label>Name</label><input></form></body>", "A longer story text here"),
    ("<article><div class='section-header'><h2>Head</h2></div><p>x</p><div class='share-price'><p>12</p></div></article>", "Head x 12"),
    ("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p></article>", "let x=2 be"),
    ("<div class='comments'><p>hi</p></div><div class=ad>buy</div><div class='sidebar-widget'>w</div><p>t</p>", "t"),
    ("<main><p>in</p></main><p>out</p>", "in"),
    ("<p title='x>y'>q</p><p title=\"a>b'c\">r", "q r"),
    ("<p>a < b &amp; c <3 d</p><!-- a > b --><p>z</p><!-- open", "a < b & c <3 d z")])
def test_pages_by_hand(page, want):
    assert main_text(page, "", frozenset()) == want


def test_outside_an_article_the_tree_decides_on_known_hosts():
    assert main_text("<main><p>in</p></main><p>out</p><div class=ad>buy</div>", "", frozenset(), known_host=True) == "in out"


@pytest.mark.parametrize("page", ["<div class=x>t " * 26_000, "<div class=x>" * 32_000, "<a " * 350_000, "<a " * 350_000 + ">", "<a \"'>" * 200_000, "<span>" * 60_000 + "<p>x</p><div>y</div>" * 5_000,
                                  "<b>" * 20_000 + "<div>" * 20_000 + "</b>" * 20_000, "<!-- " * 200_000, "< " * 300_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page, "h", frozenset())
    style_counts(page, "h")
    assert time.perf_counter() - began < 4
