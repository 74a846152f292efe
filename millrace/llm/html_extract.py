"""Main text of web pages by site style trees.

The pages of a host are merged by element style (the path of element names and classes). A node that shows the same
children and the same contents on all pages of its host has low entropy-based importance and is boilerplate; one
whose contents differ from page to page is content. Two scans: the first reduces every node's children and contents
to counts, the second removes the branches of low importance. Elements that are boilerplate by definition
(navigation, footers, controls, comments, ...) have importance 0 by themselves. Words in a class or id are a prior:
they decide on hosts of few pages, where entropy tells nothing, and outside an article body; elsewhere the tree
decides.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare

#: A host's nodes count as known from this many different pages on; below, only names and classes decide.
MIN_PAGES = 4
#: Contents of nodes under this importance go: outside an article body, and in elements with a class inside one.
LOW = 0.3
#: Weight of a node's own children against what lies below it, as in the published method.
GAMMA = 0.9
#: Unimportant nodes, known hosts and repeated pages are sent to all tasks up to this many; more are joined.
MAX_SENT = 200_000
#: The end tag of an inline element looks for its start so many open elements up at most.
INLINE_DEPTH = 200
#: A form is a wrapper of the page, not a form, if it holds an article, main or h1, or this share of the page's text.
WRAPPER_SHARE = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br
math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded semantics""".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg canvas object audio video select".split())
#: Of these, elements whose contents are text up to their closing tag; the others hold elements and are boilerplate by name.
RAW_TEXT = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = RAW | frozenset("head nav footer aside button input dialog menu fieldset legend datalist map applet annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promotion
nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer sidebar sidebars aside widget widgets toolbar
cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login search share sharing social
comment comments commentlist respond disqus reply replies related recommended recommendations copyright skip""".split())
#: Words that say nothing by themselves: a class is boilerplate if all its parts are of these or the above, and one is above.
PLAIN_WORDS = frozenset("""area bar bars block blocks body bottom box boxes col column container content footer form global group header holder inline inner item items
left link links list lists main mobile module outer page panel post primary right row secondary section site slot small strip sub title top wrap wrapper""".split())
#: These mark a page's head or foot, and nothing inside an article.
EDGE_WORDS = frozenset(("header", "masthead", "footer"))
#: Elements that hold a page or its article: a class such as "with-sidebar" says nothing about them.
HOLDERS = frozenset(("html", "body", "main", "article"))
COMMENT_WORDS = frozenset(("comment", "comments", "reply", "replies"))
#: Names that begin with these are readers' comments, which differ from page to page as an article does.
COMMENT_STARTS = COMMENT_WORDS | frozenset(("commentlist", "respond", "disqus"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",),
         "p": ("article", "body", "button", "div", "main", "section", "td", "th", "table", "li", "blockquote", "aside", "nav", "footer", "header", "form")}

#: A tag, in which quoted values may hold ">"; possessive, so that a tag without an end is read once.
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    """An open element. ``key``: hash of its style path, and ``style``: its node in the tree (itself, or for an inline element
    without a class the one around it); ``noise``: boilerplate by its name or a class, ``sure``: by its name alone;
    ``inside``: in an article; ``classed``: some element of the article down to here has a class."""

    __slots__ = ("classed", "form", "inside", "key", "label", "live", "name", "noise", "parent", "style", "sure", "wraps")

    def __init__(self, name: str, label: str, parent: "Node | None", noise: bool, sure: bool, inside: bool, classed: bool, own: bool, key: int):
        self.name, self.label, self.parent, self.noise, self.sure, self.inside, self.classed, self.key = name, label, parent, noise, sure, inside, classed, key
        self.style = self if own else parent.style
        self.live, self.wraps = False, False
        self.form = self if name == "form" else parent.form if parent else None


def style_of(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """The style label of an element, whether its name, role or class marks it as boilerplate, and whether that is sure:
    by more than the words of a class or id, which content may have too."""
    if not _TELLING.search(attributes):
        sure = name in DROPPED or (name == "header" and not inside)
        return name, sure, sure
    a = {}
    for k, v in _ATTRIBUTE.findall(attributes):
        a.setdefault(k.lower(), v.strip("\"'"))
    classes = a.get("class", "").split()
    parts = [[w.lower() for w in _PART.findall(c)] for c in (*classes, a.get("id", ""))]
    if name in HOLDERS:
        noise = sure = name == "article" and any(w in COMMENT_WORDS for p in parts for w in p)
    else:
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        sure = name in DROPPED or (name == "header" and not inside) or a.get("role", "").lower() in ROLES or hidden or any(p and p[0] in COMMENT_STARTS for p in parts)
        telling = NOISE_WORDS - EDGE_WORDS if inside else NOISE_WORDS
        noise = sure or any(any(w in telling for w in p) and all(w in NOISE_WORDS or w in PLAIN_WORDS or w.isdigit() for w in p) for p in parts)
    return name + "".join(f".{c}" for c in sorted(classes)), noise, sure


def parse(page: str, host: str = "", known: bool = False) -> tuple[list[tuple[Node, str]], bool]:
    """Text blocks in page order, each with the innermost element that holds it, and whether the page has an article body
    (with ``known``, also one in a branch that is not surely boilerplate). One pass, and one node an element, however the
    page is nested."""
    stack = [_root(host)]
    count: Counter = Counter()  # open elements by name
    out: list[tuple[Node, str]] = []
    text: list[str] = []
    has_main = False

    def flush() -> None:
        if text:
            if s := " ".join(html_module.unescape("".join(text)).split()):
                out.append((stack[-1], s))
            text.clear()

    def cut(i: int) -> None:
        for x in stack[i:]:
            count[x.name] -= 1
        del stack[i:]

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        if not any(count[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                flush()
                cut(i)
                return
            if stack[i].name in within:
                return

    at, n = 0, len(page)
    last_end, comments = page.rfind(">"), True
    while at < n:
        start = page.find("<", at)
        if start != at:
            text.append(page[at : n if start < 0 else start])
            if start < 0:
                break
            at = start
        after = page[at + 1 : at + 2]
        if not (after.isascii() and after.isalpha()) and after not in ("/", "!", "?"):
            text.append("<")
            at += 1
            continue
        if at > last_end:  # a tag that never ends: the page is cut off
            break
        if after in ("!", "?"):
            end = page.find("-->", at + 4) if comments and page.startswith("<!--", at) else -1
            comments = comments and (end >= 0 or not page.startswith("<!--", at))
            if page.startswith("<!--", at) and end < 0:
                break  # a comment that never ends
            at = end + 3 if end >= 0 else page.find(">", at) + 1
            continue
        m = _TAG.match(page, at)
        if m:
            name, attributes, ends, at = m[1].lower(), m[2], after == "/", m.end()
        else:  # a quote that never ends, or no name
            end, x = page.find(">", at), _NAME.match(page, at + 1 + (after == "/"))
            if x is None or x.end() > end:
                at = end + 1
                continue
            name, attributes, ends, at = x[0].lower(), page[x.end() : end], after == "/", end + 1
        if ends:
            if name == "br":
                text.append(" ")
                continue
            if not count[name]:
                continue
            deepest = max(0, len(stack) - 1 - INLINE_DEPTH) if name in INLINE else 0
            where = next((i for i in range(len(stack) - 1, deepest, -1) if stack[i].name == name), 0)
            if not where:
                continue
            if name in INLINE and any(x.name not in INLINE for x in stack[where + 1 :]):
                if not stack[where].noise:
                    count[name] -= 1
                    del stack[where]
            else:
                if name not in INLINE:
                    flush()
                cut(where)
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name not in INLINE:
                flush()
            continue
        if name in RAW_TEXT:
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = found.end() if found else n
            continue
        if name not in INLINE:
            if name in CLOSES_P:
                close(("svg", "math", "select"), ("foreignobject", "annotation-xml"))  # left open: such elements end them
                close(("p",), SCOPE["p"])
            if name in SAME_CLOSES:
                close(SAME_CLOSES[name], SCOPE[name])
            flush()
        top = stack[-1]
        label, noise, sure = style_of(name, attributes, top.inside)
        main = name in ("article", "main") and not noise
        if (main or name == "h1") and top.form is not None:
            top.form.wraps = True
        if noise and not top.noise and name in INLINE and text:
            flush()
        has_main |= main and not (top.sure if known else top.noise)
        if not attributes.rstrip().endswith("/"):
            classed = "." in label
            own = name not in INLINE or classed or noise
            stack.append(Node(name, label, top, top.noise or noise, top.sure or sure, top.inside or main, top.classed or (classed and top.inside and name not in HOLDERS), own,
                              _hash(f"{top.key}/{label}") if own else top.key))
            count[name] += 1
    flush()
    return out, has_main


def _root(host: str) -> Node:
    root = Node.__new__(Node)
    root.name = root.label = ""
    root.parent = root.form = None
    root.noise = root.sure = root.inside = root.classed = root.live = root.wraps = False
    root.key, root.style = _hash(host), root
    return root


def style_counts(page: str, host: str) -> list[tuple[int, bool, int]]:
    """(node, whether it is about contents, feature) of one page, without repeats: the children of each node that hold
    text, and the contents found directly in it."""
    blocks, _ = parse(page, host)
    children: dict[int, dict[str, None]] = {}
    contents: set[tuple[int, bool, int]] = set()
    for x, s in blocks:
        x = x.style
        contents.add((x.key, True, _hash(s)))
        children.setdefault(x.key, {})
        while x.parent is not None and not x.live:  # up to what an earlier block has been through
            x.live = True
            above = x.parent.style
            children.setdefault(above.key, {})[x.label] = None
            x = above
    return [*contents, *((k, False, _hash("\n".join(c))) for k, c in children.items())]


def forms_of(blocks: list[tuple[Node, str]]) -> set[Node]:
    """The forms of a page that are forms, and not wrappers of most of it."""
    size: Counter = Counter()
    for x, s in blocks:
        if x.form is not None:
            size[x.form] += len(s)
    total = sum(len(s) for _, s in blocks)
    return {f for f, k in size.items() if not f.wraps and k <= WRAPPER_SHARE * total}


def main_text(page: str | None, host: str, low: frozenset[int] | set[int], known_host: bool = False) -> str:
    """The page's main text. Boilerplate by name goes, and so do forms. Elsewhere a class or id that marks a branch decides
    outside the article body and on hosts of few pages; on a known host, importance decides for the rest: for all
    branches outside an article body, where nothing unmarked goes that is important, and inside one for those that have
    a class."""
    if not page:
        return ""
    blocks, has_main = parse(page, host, known_host)
    forms = forms_of(blocks)
    kept: list[str] = []
    spare: list[str] = []
    for x, s in blocks:
        if x.sure or x.form in forms:
            continue
        outside = has_main and not x.inside
        if x.noise and (outside or not known_host):
            continue
        if outside and not known_host:
            continue
        if not outside:
            spare.append(s)
        gone = (outside or not x.inside or x.noise or x.classed) and x.style.key in low
        if not gone:
            kept.append(s)
    return " ".join(kept or spare)  # a page all of whose text is common to its site keeps it


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def importance(counts: DataFrame) -> DataFrame:
    """``node, m, own, content`` from ``node, is_content, feature, n`` (pages): entropy of the children's styles, and 1
    less the mean entropy of the contents, both to the base m; 1 where there is one page."""
    m = counts.filter("not is_content").groupBy("node").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    content = counts.filter("is_content").groupBy("node").agg(F.avg(F.log("n")).alias("c"))
    log_m = F.log("m")
    return m.join(content, "node", "left").select(
        "node", "m", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * log_m)).otherwise(1.0).alias("own"),
        F.when(F.col("m") > 1, 1 - F.col("c") / log_m).otherwise(1.0).alias("content"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_pages: int = MIN_PAGES, low: float = LOW, max_sent: int = MAX_SENT) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Text blocks of the article body (of the whole body where a page marks none), character references decoded, white
    space runs in a block one space, blocks joined in page order by one space. Repeated pages count once in a host's
    style tree. Null or empty pages give an empty text; pages without a host share one tree of their own; markup
    that is cut off or nested wrongly is read as far as it goes. Other columns are ignored; no rows, no result rows.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"),
                        host_of(F.col(f"`{url_col}`")).alias("host"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                seen: Counter = Counter()
                for page, host, copies in zip(*(part.column(k).to_pylist() for k in range(3))):
                    for x in style_counts(page, host):
                        seen[host, *x] += 1 / copies
                keys = list(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64()))] + [pa.array(seen.values(), pa.float64())],
                    names=["host", "node", "is_content", "feature", "n"])

    def sendable(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(max_sent + 1).count() <= max_sent else df

    # Copies of a page say nothing about its site: together they count as one page. Pages without copies meet nothing.
    once = Table(rows.filter("html is not null").groupBy("host", F.xxhash64("html").alias("h")).agg(F.count("*").alias("copies")), "pages-once")
    many = Table(once.df.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("host"), "known-hosts")
    copied = Table(once.df.filter("copies > 1").select(F.col("host").alias("_host"), F.col("h").alias("_h"), "copies"), "pages-copied")
    # The trees of known hosts only: no others are asked for.
    there = rows.filter("html is not null").join(sendable(many.df), "host", "left_semi")
    there = there.join(sendable(copied.df), (F.col("host") == F.col("_host")) & (F.xxhash64("html") == F.col("_h")), "left")
    counts = there.select("html", "host", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(count, "host string, node long, is_content boolean, feature long, n double")
    counts = Table(counts.groupBy("host", "node", "is_content", "feature").agg(F.round(F.sum("n"), 6).alias("n")), "style-counts")
    hosts = counts.df.filter("not is_content").groupBy("node").agg(F.first("host").alias("host"))
    scored = importance(counts.df).filter(F.col("m") >= min_pages)
    score = F.when(F.col("content").isNull(), F.col("own")).otherwise((1 - GAMMA) * F.col("own") + GAMMA * F.col("content"))
    unimportant = Table(scored.filter(score < low).join(hosts, "node").select("host", "node"), "style-low")
    few = max(t.df.limit(max_sent + 1).count() for t in (unimportant, many)) <= max_sent

    def extract(batches: Iterator[pa.RecordBatch], sent=None) -> Iterator[pa.RecordBatch]:
        at, nodes = None, frozenset()  # pages of a host come one after the other where they were joined with its list
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = []
                for j, (page, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if sent is not None:
                        texts.append(main_text(page, host, sent.value[0], host in sent.value[1]))
                        continue
                    if host != at:
                        own = part.column(4)[j].as_py()
                        at, nodes, known = host, frozenset(own or ()), own is not None
                    texts.append(main_text(page, host, nodes, known))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    if few:
        sent = spark.sparkContext.broadcast(tuple(frozenset(r[0] for r in d.collect()) for d in (unimportant.df.select("node"), many.df)))
        return rows.mapInArrow(lambda b: extract(b, sent), f"page_id {kind}, url string, text string, n_chars long")
    low_nodes = unimportant.df.groupBy("host").agg(F.collect_list("node").alias("low"))
    # A row for each known host, be its list empty; a node of many pages is on a known host.
    by_host = Table(many.df.join(low_nodes, "host", "left").select("host", F.coalesce("low", F.array().cast("array<long>")).alias("low")), "style-by-host")
    return rows.join(by_host.df, "host", "left").select("page_id", "url", "html", "host", "low").mapInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars long")
