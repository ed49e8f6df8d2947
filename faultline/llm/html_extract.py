"""Main text of web pages by consensus host paths.

Each page is read into a tree of its containers. Containers collect scores from the text blocks
below them, and each page proposes its best ones as generalised paths: tags with their classes,
digits taken out. Spark adds the votes of all pages of a host, a page's votes summing to at most
one, and the winning path of the host is then used to extract its pages anew. A page that has no
container on the winning path, or no host, uses its own best container. What is extracted is the
nearest ``article`` or ``main`` around the chosen container; where there is none, containers below
the body are climbed as long as unflagged text lies beside, so it does not depend on lengths.

Blocks of menus, page headers, footers, sidebars, notices, adverts, forms and reader comments,
told by tag, role and words in class and id, are neither scored nor extracted; nor are scripts,
styles and the head. A container so named only by its class is kept if an ``article`` or ``main``
lies within it.

Defined results: null and empty html give the empty text; every input row gives one row, repeated
rows included; a null url has no host. Columns other than the three read are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import scratch, ship, table
from faultline.llm.url_filter import host_of

#: Elements by their part in a page.
UNREAD = frozenset("head script style noscript template iframe object svg math canvas audio video textarea select option title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img input".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body main article section div td blockquote center".split())
#: A start tag on the left ends open elements on the right, up to the nearest container.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations widget "
    "toolbar pagination pager copyright legal disclaimer skip".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
GOOD_WORDS = frozenset("article content entry post story body text main".split())
LAYOUT_PREFIXES = frozenset("has with no without is".split())
NEVER_BY_CLASS = frozenset("html body main article".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I) for tag in RAW}
#: Votes that a page may cast; the rest of its containers score less than these.
BALLOT = 5
#: Hosts whose paths, some hundred bytes each, are broadcast; beyond it, copies of a host in a join.
BROADCAST_HOSTS, SALTS = 50_000, 32
LEAST_CHARS = 25


class Page:
    """Containers of a page as parallel lists, and its text blocks in page order."""

    __slots__ = ("parent", "label", "depth", "tag", "inside", "flag", "bonus", "blocks")

    def __init__(self, html: str):
        self.parent, self.label, self.depth, self.tag, self.inside = [-1], [""], [0], ["html"], [False]
        self.flag, self.bonus = [0], [0]
        self.blocks: list[tuple[int, str, float, bool]] = []  # (container, text, share of links, heading)
        self._read(html)
        self._settle()

    def _node(self, parent: int, tag: str, attrs: str) -> int:
        flag, bonus, label = 0, 0, tag
        if tag in BOILERPLATE_TAGS:
            flag = 0 if tag == "header" and self.inside[parent] else 2
        if tag in ("article", "main"):
            bonus = 25
        if attrs:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
                flag = 2
            if found.get("role", "").lower() in BOILERPLATE_ROLES:
                flag = 2
            names = f"{found.get('class', '')} {found.get('id', '')}"
            if not names.isspace():
                for name in names.split():
                    parts = [w.lower() for w in NAME_WORD.findall(name)]
                    if tag not in NEVER_BY_CLASS and not (parts and parts[0] in LAYOUT_PREFIXES):
                        if BOILERPLATE_WORDS.intersection(parts) and not (self.inside[parent] and "header" in parts):
                            flag = max(flag, 1)
                    if GOOD_WORDS.intersection(parts):
                        bonus = max(bonus, 10)
                classes = sorted({re.sub(r"\d+", "", c) for c in found.get("class", "").split()} - {""})
                label = ".".join([tag, *classes])
        self.parent.append(parent)
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        self.tag.append(tag)
        self.flag.append(flag)
        self.bonus.append(bonus)
        return len(self.parent) - 1

    def path(self, node: int) -> str:
        """Labels from the root to a container; made when asked for, as nesting may be deep."""
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return "/".join(["", *reversed(labels)])

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open block elements: (tag, node that holds its text)
        opened: Counter = Counter()  # their tags
        text: list[str] = []
        linked, links, unread, heading = 0, 0, 0, False
        at, end = 0, len(html)

        def flush() -> None:
            nonlocal linked, heading
            if text:
                raw = "".join(text)
                joined = " ".join((unescape(raw) if "&" in raw else raw).split())
                if joined:
                    self.blocks.append((stack[-1][1], joined, min(1.0, linked / len(raw)), heading))
                text.clear()
            linked = 0

        while at < end:
            token = TOKEN.search(html, at)
            upto = token.start() if token else end
            if upto > at and not unread:
                text.append(html[at:upto])
                if links:
                    linked += upto - at
            if not token:
                break
            at = token.end()
            tag = token["tag"] or token["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            closing = bool(token["end"] or token["end2"])
            attrs = token["attrs"] or token["attrs2"] or ""
            if tag in INLINE:
                if tag == "a":
                    links = max(0, links - 1) if closing else links + 1
                continue
            if tag == "br":
                if not unread:
                    text.append(" ")
                continue
            if not closing and tag in UNREAD:
                if tag in RAW:
                    at = RAW_END[tag].search(html, at).start()
                elif not attrs.endswith("/"):
                    unread += 1
                    opened[tag] += 1
                    stack.append((tag, -1))
                continue
            if closing:
                if tag in RAW:
                    continue
                if opened[tag]:
                    flush()
                    links = 0
                    while True:
                        gone, _ = stack.pop()
                        opened[gone] -= 1
                        unread -= gone in UNREAD
                        if gone == tag:
                            break
                    heading = any(t in HEADINGS for t, _ in stack[-2:])
                elif tag == "p":
                    flush()
                continue
            if unread and tag == "body":  # a head that was never closed
                while stack[-1][1] < 0:
                    opened[stack.pop()[0]] -= 1
                unread = 0
            if unread:
                continue
            flush()
            links = 0
            if tag in VOID:
                continue
            while stack[-1][0] == "p" or stack[-1][0] in HEADINGS:  # these hold no block
                opened[stack.pop()[0]] -= 1
            for other in CLOSES.get(tag, ()):
                if stack[-1][0] == other:
                    opened[stack.pop()[0]] -= 1
            node = stack[-1][1]
            if tag in CONTAINERS or tag in BOILERPLATE_TAGS or tag in ("ul", "ol", "table", "dl") or "class" in attrs or "id" in attrs:
                node = self._node(node, tag, attrs)
            heading = tag in HEADINGS
            if attrs.endswith("/") and tag not in CONTAINERS:
                continue
            opened[tag] += 1
            stack.append((tag, node))
        flush()

    def _settle(self) -> None:
        """Spare containers named by class alone that hold an article; pass the others' flag down."""
        holds = [tag in ("article", "main") for tag in self.tag]
        for i in range(len(self.parent) - 1, 0, -1):
            if holds[i]:
                holds[self.parent[i]] = True
                if self.flag[i] == 1:
                    self.flag[i] = 0
        for i in range(1, len(self.parent)):
            self.flag[i] = max(self.flag[i], self.flag[self.parent[i]])

    def scores(self) -> dict[int, float]:
        """Score of each container from the blocks below it; nearer ones count more."""
        out: dict[int, float] = {}
        for node, text, linked, heading in self.blocks:
            if self.flag[node] or heading:
                continue
            n = len(text)
            worth = (1 + min(text.count(","), 3) + min(n / 100, 3)) * (1 - linked) if n >= LEAST_CHARS else 0.3 * (1 - linked)
            share = 1.0
            while node >= 0 and share > 0.1:
                if self.tag[node] in CONTAINERS:
                    out[node] = out.get(node, 0.0) + worth * share
                    share *= 0.5
                node = self.parent[node]
        return {i: s + self.bonus[i] for i, s in out.items() if s > 0}

    def ballot(self) -> list[tuple[str, float]]:
        """Best paths of the page with their shares of its vote."""
        best: dict[str, float] = {}
        for node, score in sorted(self.scores().items(), key=lambda x: (-x[1], self.depth[x[0]], x[0])):
            best.setdefault(self.path(node), score)
            if len(best) == BALLOT:
                break
        total = sum(best.values())
        return [(p, s / total) for p, s in best.items()]

    def _whole(self, chosen: set[int]) -> set[int]:
        """The nearest article or main of each container, else its highest ancestor that adds text."""
        held = [0] * len(self.parent)  # headings and texts that are not mostly links
        for node, text, linked, heading in self.blocks:
            held[node] += not self.flag[node] and linked < 0.5 and (heading or len(text) >= LEAST_CHARS)
        for i in range(len(self.parent) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        out, around = set(), [-1] * len(self.parent)  # the nearest article or main, 0 if none
        top = [-1] * len(self.parent)
        for i in range(len(self.parent)):
            up = self.parent[i]
            around[i] = i if self.tag[i] in ("article", "main") and not self.flag[i] else around[up] if i else 0
            climbs = i > 0 and self.tag[up] in CONTAINERS and self.tag[up] not in ("html", "body") and not self.flag[up]
            # top: the highest container reached by steps that each add text
            top[i] = top[up] if climbs and (held[up] > held[i] or top[up] != up) else i
        for i in chosen:
            out.add(around[i] or top[i])
        return out

    def text(self, path: str | None) -> str:
        """Blocks of the containers on ``path``, else of the best container, else of the page."""
        depth, last = (path.count("/"), path.rpartition("/")[2]) if path else (-1, "")
        chosen = {
            i for i, label in enumerate(self.label)
            if label == last and self.depth[i] == depth and not self.flag[i] and self.path(i) == path
        }
        if not chosen:
            scores = self.scores()
            chosen = {max(scores, key=lambda i: (scores[i], -i))} if scores else {0}
        chosen = self._whole(chosen)
        within = [False] * len(self.parent)
        for i in range(len(self.parent)):
            within[i] = i in chosen or (i > 0 and within[self.parent[i]])
        return "\n".join(t for node, t, _, _ in self.blocks if within[node] and not self.flag[node])


def _ballots(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([[{"path": p, "vote": v} for p, v in Page(html).ballot()] if html else [] for html in pages])


def _texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, paths in batches:
        yield pd.Series([Page(html).text(path) if html else "" for html, path in zip(pages, paths)])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes among the pages (host, html) of each host."""
    kind = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("vote", T.DoubleType())]))
    votes = pages.where("host <> ''").select("host", F.explode(F.pandas_udf(_ballots, kind)("html")).alias("b")).select("host", "b.*")
    # whole millionths add up alike in any order
    total = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1e6).cast("long")).alias("votes"))
    return total.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def _with_path(rows: DataFrame, winners: DataFrame, n_hosts: int, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Rows with the path of their host. Few hosts are broadcast, so no page is shuffled.

    More hosts are joined with a salt, so that the pages of one large host go to several tasks.
    """
    if n_hosts <= broadcast_hosts:
        return rows.join(F.broadcast(winners), "host", "left")
    salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    ship(pages.sparkSession)
    rows = pages.select(
        F.col(id_column), F.col(url_column), host_of(F.coalesce(F.col(url_column), F.lit(""))).alias("host"), F.col(html_column).alias("html")
    )
    winners, n_hosts = scratch(pages.sparkSession, "host-paths").keep_counted(winning_paths(rows), "winners")
    placed = _with_path(rows, winners, n_hosts)
    text = F.pandas_udf(_texts, T.StringType())("html", "path")
    return placed.select(id_column, url_column, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
