"""HTML extraction by consensus of a host's pages.

Each page scores its containers: how much running text they hold, against links and against what
lies around it.  Containers are named by a generalised path (tags with their classes, digits made
equal), pages vote on the paths per host, and every page is extracted again with the path that won
on its host.  A page without that path uses its own best container.

Votes are whole numbers summed per (host, path) before the shuffle, so a host with a third of all
pages is no hot group; the winners come back to pages over a salted join, one small row a host and
salt.  Parsing is a plain scan of tags that forgives unclosed and crossed ones.

Defined cases: a null or empty page, or one without text, gives an empty text; a null url is a host
of its own; repeated rows vote and are extracted one by one; equal votes go to the longer, then the
greater path; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "xmp", "template", "noscript", "svg", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "html body p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address form fieldset details summary center hr menu dialog hgroup legend".split()
)
CONTAINER = {"body", "div", "section", "article", "main", "td", "center", "blockquote"}
DROP = RAW | set("head nav header footer aside form button select option menu dialog object embed canvas audio video map label fieldset datalist".split())
#: Words of class names, ids and roles that mark what is not the article.
FURNITURE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars menu menus "
    "nav navbar navigation breadcrumb breadcrumbs masthead header footer notice notices cookie cookies consent gdpr alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments commentlist reply replies respond responses disqus related "
    "recommended recommendations pagination pager widget widgets toolbar skip copyright disclaimer complementary contentinfo search".split()
)
#: Of these, what can also name an article's own element.
FURNITURE_ARTICLE = set("ad ads advert adverts advertisement sponsored promo comment comments reply replies respond related teaser".split())
NEGATION = {"no", "has", "with", "without", "is", "not"}
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
#: Stops the search for an element to end.
SCOPE = {"table", "td", "th", "div", "section", "article", "main", "body", "html", "ul", "ol", "dl", "blockquote", "aside", "nav", "header", "footer", "form"}
WEIGHT = {"article": 3.0, "main": 2.5, "body": 0.5}
CONTENT = set("article content post entry story main body text".split())


@dataclass(slots=True)
class Node:
    tag: str
    up: int
    path: str
    dropped: bool
    link: bool
    content: bool = False
    prose: int = 0
    linked: int = 0
    noise: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # node, block number, text


def _names(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def _furniture(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROP:
        return True
    if tag in ("html", "body"):
        return False
    marks = FURNITURE_ARTICLE if tag in ("article", "main", "h1") else FURNITURE
    for value in [*attributes.get("class", "").split(), attributes.get("id", ""), attributes.get("role", "")]:
        names = _names(value)
        if names and names[0] not in NEGATION and marks.intersection(names):
            return True
    return False


def parse(text: str) -> Page:
    """Elements and text runs of a page, in page order; runs of one block share a number."""
    page = Page([Node("", -1, "", False, False)])
    stack, block, at = [0], 0, 0
    for m in MARK.finditer(text):
        if m.start() < at:
            continue
        if m.start() > at:
            page.runs.append((stack[-1], block, text[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                page.runs.append((stack[-1], block, html.escape(m[0][9:].removesuffix("]]>"))))
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                block += 1
            if tag == "br":
                page.runs.append((stack[-1], block, " "))
            for depth in range(len(stack) - 1, 0, -1):
                if page.nodes[stack[depth]].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and page.nodes[stack[depth]].tag in BLOCK:
                    break
            continue
        if tag == "br":
            page.runs.append((stack[-1], block, " "))
        if tag in BLOCK:
            block += 1
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = page.nodes[stack[depth]].tag
                if tag in ENDS.get(open_tag, ()):
                    del stack[depth:]
                    break
                if open_tag in SCOPE:
                    break
        if tag in VOID:
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3] or m[6] or "")}
        up = stack[-1]
        parent = page.nodes[up]
        path = parent.path
        if tag in BLOCK:
            classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
            path = f"{path}/{'.'.join([tag, *classes])}"
        content = bool(CONTENT.intersection(_names(f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('itemprop', '')} {attributes.get('role', '')}")))
        page.nodes.append(Node(tag, up, path, parent.dropped or _furniture(tag, attributes), parent.link or tag == "a", content))
        stack.append(len(page.nodes) - 1)
        if tag in RAW:
            if (m[3] or m[6] or "").rstrip().endswith("/"):
                stack.pop()
                continue
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = close.end() if close else len(text)
            stack.pop()
    if at < len(text):
        page.runs.append((stack[-1], block, text[at:]))
    return page


def _joined(page: Page, wanted: set[int] | None) -> str:
    """Blocks of the kept runs below the wanted nodes, one space between."""
    inside: list[bool] = []
    for i, node in enumerate(page.nodes):
        inside.append(wanted is None or i in wanted or (node.up >= 0 and inside[node.up]))
    blocks, number = [], -1
    for node, block, text in page.runs:
        if page.nodes[node].dropped or not inside[node]:
            continue
        if block != number:
            blocks.append([])
            number = block
        blocks[-1].append(html.unescape(text))
    texts = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def scores(page: Page) -> dict[str, float]:
    """The score of each container path: running text, by its share of all that the container holds."""
    for node, _, text in page.runs:
        n = len(text.strip())
        if n:
            own = page.nodes[node]
            kind = "noise" if own.dropped else "linked" if own.link else "prose"
            setattr(own, kind, getattr(own, kind) + n)
    for i in range(len(page.nodes) - 1, 0, -1):
        node = page.nodes[i]
        up = page.nodes[node.up]
        up.prose, up.linked, up.noise = up.prose + node.prose, up.linked + node.linked, up.noise + node.noise
    held = Counter()
    for node in page.nodes:
        if node.tag in CONTAINER and not node.dropped and node.prose:
            pure = node.prose / (node.prose + 2 * node.linked + node.noise)
            held[node.path] += node.prose * pure * WEIGHT.get(node.tag, 1.0) * (1.5 if node.content else 1.0)
    return held


def votes(text: str) -> list[tuple[str, int]]:
    """What a page gives each of its container paths: a million points in proportion to their scores."""
    held = scores(parse(text))
    total = sum(held.values())
    return [(path, round(1_000_000 * score / total)) for path, score in held.items()] if total else []


def extract(text: str | None, path: str | None) -> str:
    """The article: below the elements of the winning path, else below the page's own best container."""
    page = parse(text or "")
    wanted = {i for i, node in enumerate(page.nodes) if path and node.path == path and node.tag in CONTAINER and not node.dropped}
    if wanted and (got := _joined(page, wanted)):
        return got
    own = max(scores(page).items(), key=lambda x: (x[1], len(x[0]), x[0]), default=(None, 0))[0]
    return _joined(page, {i for i, node in enumerate(page.nodes) if node.path == own and node.tag in CONTAINER} if own else None)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path with most votes on each host."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = Counter()
            for host, text in zip(batch["host"], batch["html"], strict=True):
                for path, points in votes(text or ""):
                    sums[host, path] += points
            yield pd.DataFrame([(h, p, n) for (h, p), n in sums.items()], columns=["host", "path", "points"])

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(vote, "host string, path string, points bigint")
    sums = cast.groupBy("host", "path").agg(F.sum("points").alias("points"))
    return sums.groupBy("host").agg(F.max(F.struct("points", F.length("path").alias("n"), "path")).alias("best")).select("host", "best.path")


def extract_pages(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """page_id, url and text of every page."""

    @F.pandas_udf("string")
    def again(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([extract(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)

    salted = winning_paths(pages).select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"))
    return rows.join(salted, ["host", "salt"], "left").select("page_id", "url", again("html", "path").alias("text"))
