"""Main text of web pages by consensus host paths.

Pass 1 parses every page, scores its containers by the running text they hold
against links and boilerplate, and votes with the generalised path (tags and
classes, digits removed) of the best one.  Spark sums the votes per host and
path.  A host whose best path has at least half of its votes has a consensus;
there paths with at least ``SHARE`` of the best path's votes win, however many
(at most six can).  Pass 2 takes each page's container on a winning path: its
own best one if that has won, else the most voted path that the page has
running text on.  A page that has none, or whose host has no consensus, keeps
its own best.

Votes are summed in each task first, so a host with a third of all pages costs
a row per task and path.  The winners are one row per host; Spark picks a
broadcast only if their measured size allows it and otherwise splits skewed
hosts.

Defined results: null and empty html give an empty text; a page without a url
or host stands alone; nothing is cut off, whatever the length; repeated rows are treated
alike (each votes); an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import map_batches
from tremor.session import materialize

#: least share of the best path's votes with which a path wins
SHARE = 0.2

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][\w:-]*)(?P<attrs2>[^>]*)>"
    r"|<[!?][^>]*>|</[^>]*>", re.S)
_ATTR = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|itemprop|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NOT_SHOWN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object select title xmp".split())
CONTAINERS = frozenset("article main section div td body blockquote center table".split())
OUTSIDE = frozenset("nav aside footer form menu dialog button head fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: words in a class, id or role that mark what is not the article
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "foot gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion "
    "recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar "
    "widget widgets complementary contentinfo search login disclaimer alert toc replies reply discussion".split())
#: beginnings that mark it in run-together names (commentlist, adsbygoogle)
OUTSIDE_STARTS = ("comment", "sidebar", "advert", "adsby", "newsletter", "breadcrumb", "navig", "cookie", "sponsor", "subscri", "footer", "topbar", "menubar")
#: what marks even an article element as not the page's own
OUTSIDE_ARTICLE = frozenset("comment comments reply replies teaser teasers related recommended promo promoted sponsored ad ads advert".split())
#: what marks a section of the article by its id alone, if no other word is in it
OUTSIDE_SECTION = frozenset("comment comments reply replies respond disqus sidebar ad ads advert".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: words that mark the article itself
INSIDE_WORDS = frozenset("article articlebody body content entry main post story text".split())


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset
    outside: bool
    path: str
    certain: bool = False  # outside by its tag or hidden, not by a word alone
    parts: list = field(default_factory=list)  # strings and child numbers, in page order
    text: int = 0      # characters of running text below, outside links and boilerplate
    linked: int = 0    # characters of link text below
    blocks: int = 0    # paragraphs below


def _classes(attrs: str, tag: str = "", inside: bool = False) -> tuple[frozenset, str, bool]:
    """(words of class, id and role; class names for the path; hidden).  Ids of
    headings, and of sections inside an article, are made from their titles."""
    words, shown, hidden = set(), [], False
    for m in _ATTR.finditer(attrs):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or bool(_NOT_SHOWN.search(value))
        elif name != "aria-hidden":
            own = {w.lower() for w in _WORDS.findall(value)}
            if name != "id" or tag not in HEADINGS and not (inside and tag == "section" and not own <= OUTSIDE_SECTION):
                words.update(own)
        if name == "class":
            shown = sorted(filter(None, (re.sub(r"[0-9]+", "", c).strip("-_").lower() for c in value.split())))
    return frozenset(words), ".".join(shown), hidden


def _marked(words: frozenset) -> bool:
    return bool(words & OUTSIDE_WORDS) or any(w.startswith(OUTSIDE_STARTS) for w in words)


def parse(html: str) -> list[Node]:
    """A page's elements; open ends, stray tags and bad markup are borne."""
    nodes = [Node("", -1, frozenset(), False, "")]
    open_, pos, limit = [0], 0, html.rfind(">") + 1

    def text(s: str) -> None:
        if s:
            nodes[open_[-1]].parts.append(entities.unescape(s))

    def close(tags: tuple[str, ...], fence: tuple[str, ...]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[i]].tag
            if tag in tags:
                del open_[i:]
                return
            if tag in fence:
                return

    m = _TOKEN.search(html, 0, limit) if limit else None
    while m:
        text(html[pos:m.start()])
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if name and (m["end"] or m["end2"]):
            if name == "br":
                nodes[open_[-1]].parts.append(" ")
            elif name in INLINE or name not in ("html", "body"):
                for i in range(len(open_) - 1, 0, -1):
                    if nodes[open_[i]].tag == name:
                        del open_[i:]
                        break
                    if name in INLINE and nodes[open_[i]].tag not in INLINE:
                        break
                if name not in INLINE:
                    nodes[open_[-1]].parts.append(" ")
        elif name:
            attrs = m["attrs"] or m["attrs2"] or ""
            if name in CLOSES_P:
                close(("p",), ("article", "body", "button", "div", "main", "section", "table", "td"))
            if name in CLOSES:
                tags, fence = CLOSES[name]
                close(tuple(tags.split()), fence)
            if name in RAW:
                e = None if attrs.endswith("/") and name in ("svg", "math") else re.compile(f"</{name}(?=[\\s>/])[^>]*>", re.I).search(html, pos)
                pos = e.end() if e else pos if attrs.endswith("/") else len(html)
                nodes[open_[-1]].parts.append(" " if name not in ("svg", "math") else "")
            elif name in VOID:
                nodes[open_[-1]].parts.append("" if name in INLINE else " ")
            elif not (name in ("html", "body") and any(nodes[i].tag == name for i in open_)):
                up = open_[-1]
                inside_article = any(nodes[i].tag in ("article", "main") for i in open_)
                inside = inside_article or any(nodes[i].words & INSIDE_WORDS for i in open_ if nodes[i].tag != "body")
                words, shown, hidden = _classes(attrs, name, inside)
                certain = outside = hidden or name in OUTSIDE or name == "header" and not inside_article
                if not outside and name in ("article", "main"):
                    certain = outside = name == "article" and bool(words & OUTSIDE_ARTICLE)
                elif not outside and name not in ("html", "body"):
                    outside = _marked(words) and not words & {"article", "articlebody"}
                    outside = outside or "header" in words and not inside_article and not words & INSIDE_WORDS
                path = nodes[up].path if name in INLINE or name in ("html", "p") else f"{nodes[up].path}/{name}" + (f".{shown}" if shown and name != "body" else "")
                nodes.append(Node(name, up, words, outside, path, certain))
                nodes[up].parts.append(len(nodes) - 1)
                open_.append(len(nodes) - 1)
        m = _TOKEN.search(html, pos, limit) if pos < limit else None
    text(html[pos:])
    _spare(nodes)
    return nodes


def _spare(nodes: list[Node]) -> None:
    """A word alone shuts no element that holds the page's article or main; on
    a page without these, none that holds most of the running text."""
    marked = [n.outside and not n.certain for n in nodes]
    if not any(marked):
        return
    size, gone, link, under = [0] * len(nodes), [False] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        if i:
            gone[i], link[i] = n.certain or gone[n.parent], n.tag == "a" or link[n.parent]
            under[i] = marked[i] or under[n.parent]
        if not gone[i] and not link[i]:
            size[i] = sum(len(p.strip()) for p in n.parts if isinstance(p, str))
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
    articles = [i for i, n in enumerate(nodes) if n.tag in ("article", "main") and not gone[i] and size[i]]
    if articles:
        largest = max(size[i] for i in articles)
        # an article in the open, unless it is a mere teaser beside the largest
        if any(not under[i] and 2 * size[i] >= largest for i in articles):
            held = {i for i in articles if nodes[i].tag == "main"}
        else:
            held = {i for i in articles if nodes[i].tag == "main" or size[i] == largest}
        for i in held:
            while i > 0:
                if marked[i]:
                    nodes[i].outside = False
                i = nodes[i].parent
    else:
        for i, n in enumerate(nodes):
            if marked[i] and 2 * size[i] > size[0]:
                n.outside = False


def _weigh(nodes: list[Node]) -> None:
    """Sums text, links and paragraphs upwards; children come after parents."""
    shut, link = [False] * len(nodes), [False] * len(nodes)
    for i, n in enumerate(nodes):
        if i:
            shut[i] = n.outside or shut[n.parent]
            link[i] = n.tag == "a" or link[n.parent]
        if not shut[i]:
            size = sum(len(p.strip()) for p in n.parts if isinstance(p, str))
            if link[i]:
                n.linked += size
            else:
                n.text += size
            n.blocks += n.tag == "p"
    for n in reversed(nodes[1:]):
        up = nodes[n.parent]
        up.text, up.linked, up.blocks = up.text + n.text, up.linked + n.linked, up.blocks + n.blocks


def _score(n: Node) -> float:
    if n.outside or n.tag and n.tag not in CONTAINERS:
        return 0.0
    own = n.text * n.text / (n.text + n.linked) if n.text else 0.0
    hint = 3.0 if n.tag == "article" or n.words & {"articlebody"} else 1.5 if n.tag == "main" or n.words & INSIDE_WORDS else 1.0
    return own * hint


def best_container(nodes: list[Node]) -> int:
    """The best score; of nested ones that hold nearly the same text the inner.
    Where nothing scores, the body without what is certainly boilerplate."""
    scores = [0.0 if n.outside else _score(n) for n in nodes]
    shut = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        shut[i] = n.outside or shut[n.parent]
        if shut[i]:
            scores[i] = 0.0
    best = max(range(len(nodes)), key=lambda i: (scores[i], -i))
    if not scores[best]:
        for n in nodes:
            n.outside = n.certain
        return next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    inner = [i for i in range(best + 1, len(nodes)) if scores[i] >= 0.9 * scores[best] and _within(nodes, i, best)]
    return inner[-1] if inner else best


def _within(nodes: list[Node], i: int, top: int) -> bool:
    while i > top:
        i = nodes[i].parent
    return i == top


def text_of(nodes: list[Node], top: int) -> str:
    """Text below a container without what lies outside the article."""
    out, work = [], [(top, iter(nodes[top].parts))]
    while work:
        i, parts = work[-1]
        for p in parts:
            if isinstance(p, str):
                out.append(p)
            elif not nodes[p].outside:
                if nodes[p].tag not in INLINE:
                    out.append(" ")
                work.append((p, iter(nodes[p].parts)))
                break
        else:
            work.pop()
            if nodes[i].tag not in INLINE:
                out.append(" ")
    return " ".join("".join(out).split())


def vote(html: str | None) -> tuple[str, float]:
    """(generalised path of the best container, weight of the vote)."""
    if not html:
        return "", 0.0
    nodes = parse(html)
    _weigh(nodes)
    best = best_container(nodes)
    n = nodes[best]
    # long pages convince more, but no page outvotes many
    return n.path, min(1.0, n.text / 500.0)


def extract(html: str | None, paths: list[str] | None) -> str:
    if not html:
        return ""
    nodes = parse(html)
    _weigh(nodes)
    best = best_container(nodes)
    for path in [] if not paths or nodes[best].path in paths else paths:
        same = [i for i, n in enumerate(nodes) if n.path == path and n.tag not in INLINE and n.tag != "p" and n.text]
        if same:
            best = max(same, key=lambda i: (nodes[i].text, -i))
            break
    # several containers of one kind side by side are one article
    own = nodes[best]
    group = [i for i, n in enumerate(nodes) if n.path == own.path and n.parent == own.parent and n.tag == own.tag and not n.outside and n.tag in CONTAINERS]
    return " ".join(filter(None, (text_of(nodes, i) for i in group or [best])))


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"),
                        F.when(host != "", host).alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): winning paths, most votes first."""

    def cast(batch):
        votes = [vote(h) for h in batch.column(1).to_pylist()]
        return {"host": batch.column(0), "path": [v[0] for v in votes], "votes": [v[1] for v in votes]}

    cast_ = map_batches(pages.filter("host is not null").select("host", "html"), cast, "host string,path string,votes double")
    # hundredths, so that sums do not depend on their order
    sums = materialize(cast_.groupBy("host", "path").agg(F.sum(F.round(F.col("votes") * 100).cast("long")).alias("votes"))
                       .filter("votes > 0"), "host-votes")
    clear = sums.groupBy("host").agg(F.max("votes").alias("best"), F.sum("votes").alias("total")).filter("2 * best >= total")
    won = sums.join(clear, "host").filter(F.col("votes") >= SHARE * F.col("best"))
    return won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(-F.col("votes"), "path")))["path"].alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    own = with_host(pages, id_col, url_col, html_col)
    winners = materialize(host_paths(own), "host-paths")

    def run(batch):
        texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(own.join(winners, "host", "left").select("page_id", "url", "html", "paths"), run,
                       "page_id bigint,url string,text string,n_chars bigint")
