"""Cards and detail texts out of captured pages.

Each site is a declaration: lists of selectors, tried in order. One Arrow
function reads them all, so that a new site is a new entry. Captured pages have no
layout: hidden elements count, and a block element ends a line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import keys
from gleaner.functions.text import first_present, squeeze, title_text
from gleaner.operators.collect import detail_text
from gleaner.operators.shared import small_batches

# Elements without an end tag, elements that end a line, elements whose text is none.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
SILENT = frozenset("script style noscript svg template head".split())

#: Characters of pages that are read before their rows are handed on: a batch of Spark's may be any number of pages of any size.
MOST_CHARS = 1 << 20


@dataclass(frozen=True)
class Site:
    """Selectors of one site. Each field's list is tried in order."""

    name: str
    cards: tuple[str, ...]
    link: tuple[str, ...]
    title: tuple[str, ...]
    company: tuple[str, ...]
    location: tuple[str, ...]
    pane: tuple[str, ...]
    detail: tuple[str, ...] = ()
    next: tuple[str, ...] = ()
    id_attribute: str = ""
    slow: bool = False
    strip_query: bool = False
    clean_title: bool = False


# The selectors of the known sites.
SITES = {
    "indeed": Site(
        name="Indeed",
        cards=("div.job_seen_beacon", "[data-testid='slider_item']", "td.resultContent"),
        link=("h2.jobTitle a", "a.jcs-JobTitle", "a[data-jk]"),
        title=("h2.jobTitle",),
        company=("[data-testid='company-name']",),
        location=("[data-testid='text-location']",),
        pane=("#jobDescriptionText", "[id*='jobDescriptionText']"),
        next=("a[data-testid='pagination-page-next']", "a[aria-label='Next Page']", "a[aria-label='Next']"),
        id_attribute="data-jk",
    ),
    "linkedin": Site(
        name="LinkedIn",
        cards=("div.job-card-container", "li.jobs-search-results__list-item", "li[data-occludable-job-id]", "div[data-job-id]"),
        link=("a.job-card-container__link", "a.job-card-list__title", "a[href*='/jobs/view/']"),
        title=(".job-card-list__title--link", ".job-card-list__title"),
        company=(".job-card-container__primary-description", ".artdeco-entity-lockup__subtitle", "[class*='subtitle']"),
        location=(".job-card-container__metadata-item", "[class*='metadata-item']", ".artdeco-entity-lockup__caption"),
        pane=("#job-details", ".jobs-description__content", ".jobs-box__html-content"),
        next=("button[aria-label='View next page']", ".jobs-search-pagination__button--next"),
        slow=True,
        strip_query=True,
        clean_title=True,
    ),
    "stepstone": Site(
        name="StepStone",
        cards=("[data-at='job-item']",),
        link=("a[data-at='job-item-title']", "a[href*='/stellenangebote--']"),
        title=(),
        company=("[data-at='job-item-company-name']",),
        location=("[data-at='job-item-location']",),
        pane=("[data-at='job-ad-content']",),
        detail=("[data-at='job-ad-content']", "[class*='job-ad-display']", "article", "main"),
        next=("a[aria-label='Nächste']", "[data-at='pagination-next']"),
    ),
}


_BLANKS = re.compile(r"[ \t\r\f]{2,}|[\t\r\f]")  # what is not one blank already
_GAP = re.compile(r"\n{3,}")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str]
    parent: "Node | None" = None
    children: list = field(default_factory=list)
    at: int = 0  # number in document order, and the first one behind its descendants
    end: int = 0

    def text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append("\n")
            elif n.tag not in SILENT:
                if n.tag in BLOCK:
                    out.append("\n")
                    stack.append("\n")
                stack.extend(reversed(n.children))
        text = _BLANKS.sub(" ", "".join(out)).replace(" \n", "\n").replace("\n ", "\n")
        return _GAP.sub("\n\n", text).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


class Page:
    """The nodes of a page in document order, and what each selector fits among them: each is looked for once."""

    def __init__(self, html: str):
        t = _Tree()
        t.feed(html)
        t.close()
        self.root, self.nodes, self.found, self.having = t.root, [], {}, {}
        stack: list[tuple[Node, bool]] = [(t.root, True)]
        while stack:
            n, opens = stack.pop()
            if not opens:
                n.end = len(self.nodes)
                continue
            n.at = len(self.nodes)
            self.nodes.append(n)
            for name in (n.tag, *["[" + a for a in n.attributes]):
                self.having.setdefault(name, []).append(n)
            stack.append((n, False))
            stack.extend((c, True) for c in reversed(n.children) if isinstance(c, Node))

    def fits(self, selector: str) -> list[int]:
        """Numbers of the nodes that the selector fits."""
        if selector not in self.found:
            compounds = _compile(selector)
            self.found[selector] = [n.at for n in self.having.get(_needed(selector), ()) if _matches(n, compounds)]
        return self.found[selector]

    def close(self) -> None:
        """Let go of the nodes, which point at each other: they are freed at once and not when Python next looks for such rings."""
        for n in self.nodes:
            n.parent = None

    def select(self, selectors: Sequence[str]) -> list[Node]:
        """All that any of the selectors fits, in document order, each once."""
        return [self.nodes[i] for i in sorted({i for s in selectors for i in self.fits(s)})]

    def first(self, selectors: Sequence[str], root: Node | None = None) -> Node | None:
        """What the first selector that fits anything below root finds first."""
        root = root or self.root
        for s in selectors:
            found = self.fits(s)
            i = bisect_right(found, root.at)
            if i < len(found) and found[i] < root.end:
                return self.nodes[found[i]]
        return None


_COMPOUND = re.compile(r"(?:\[[^\]]*\]|[^\s\[])+")
_PART = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)'([^']*)')?\]")


@lru_cache(maxsize=None)
def _compile(selector: str):
    """A selector of compounds (tag, .class, #id, [name], [name='x'], [name*='x']) with blanks for descent."""
    return [[m.groups() for m in _PART.finditer(compound)] for compound in _COMPOUND.findall(selector)]


@lru_cache(maxsize=None)
def _needed(selector: str) -> str:
    """What a node must have for the selector to fit it: an attribute, as [name, or else a tag."""
    last = _compile(selector)[-1]
    named = [name for _, _, _, name, _, _ in last if name] + ["class" for _, cls, *_ in last if cls] + ["id" for _, _, ident, *_ in last if ident]
    return "[" + named[0] if named else last[0][0].lower()


def _fits(n: Node, compound) -> bool:
    for tag, cls, ident, name, op, value in compound:
        if tag and n.tag != tag.lower() or cls and cls not in n.attributes.get("class", "").split() or ident and n.attributes.get("id") != ident:
            return False
        if name:
            has = n.attributes.get(name)
            if has is None or op == "=" and has != value or op == "*=" and value not in has:
                return False
    return True


def _matches(n: Node, compounds) -> bool:
    if not n.tag or not _fits(n, compounds[-1]):
        return False
    rest, up = compounds[:-1], n.parent
    while rest and up is not None:
        if up.tag and _fits(up, rest[-1]):
            rest = rest[:-1]
        up = up.parent
    return not rest


_CARD = pa.struct([(c, pa.string()) for c in ("href", "id", "link_text")] + [(c, pa.list_(pa.string())) for c in ("title", "company", "location")])
_FOUND = [("cards", pa.list_(_CARD)), ("pane", pa.string()), ("details", pa.list_(pa.string())), ("has_next", pa.bool_())]
_CARD_SQL = "array<struct<href:string,id:string,link_text:string,title:array<string>,company:array<string>,location:array<string>>>"


def _texts(page: Page, root: Node, selectors) -> list[str]:
    return [n.text() if (n := page.first((s,), root)) is not None else "" for s in selectors]


#: The parts of a page that read_page can look for; linkless: among the cards also those without a link.
PARTS = ("cards", "linkless", "pane", "details", "next")


def read_page(site: Site | None, html: str | None, parts: Sequence[str] = PARTS) -> tuple:
    """(cards, pane, detail candidates, whether there is a next page) of one page; of parts that are not asked for, what a page without them has.

    A card without a link has None for href, id and link_text.
    """
    if site is None or not html:
        return [], None, [], False
    page = Page(html)
    cards = []
    for card in page.select(site.cards) if "cards" in parts else []:
        a = page.first(site.link, card)
        if a is not None or "linkless" in parts:
            link = (a.attributes.get("href", ""), a.attributes.get(site.id_attribute, ""), a.text()) if a is not None else (None, None, None)
            cards.append(dict(zip(("href", "id", "link_text"), link)) | {c: _texts(page, card, getattr(site, c)) for c in ("title", "company", "location")})
    pane = page.first(site.pane) if "pane" in parts else None
    pane = pane.text() if pane is not None else None
    details = _texts(page, page.root, site.detail) if "details" in parts else []
    has_next = "next" in parts and page.first(site.next) is not None
    page.close()
    return cards, pane, details, has_next


def _reader(sites: dict[str, Site], parts: Sequence[str], most: int):
    def told(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        kept = [i for i, n in enumerate(batch.schema.names) if n != "html"]
        columns = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(_FOUND)]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *columns], names=[*[batch.schema.names[i] for i in kept], *[n for n, _ in _FOUND]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            site, html = batch.column("site"), batch.column("html")
            found, begun, chars = [], 0, 0
            for i in range(batch.num_rows):  # a page's text at a time is a Python string
                text = html[i].as_py()
                found.append(read_page(sites.get(site[i].as_py()), text, parts))
                chars += len(text or "")
                if chars >= most or i + 1 == batch.num_rows:
                    yield told(batch.slice(begun, len(found)), found)
                    found, begun, chars = [], i + 1, 0

    return run


def read_pages(pages: DataFrame, sites: dict[str, Site] = SITES, parts: Sequence[str] = PARTS) -> DataFrame:
    """pages (url, html, other columns) without html, with site, cards, pane, details and has_next; parts: what to look for. One pass, no shuffle.

    The site is the first whose host pattern fits; pages of no known site have no cards. A task holds a batch of 8 MB of Spark's, or one page, and what was read of MOST_CHARS of its pages, or of
    one page: the session hands on such batches from then on.
    """
    small_batches(pages.sparkSession)
    rows = pages.withColumn("site", keys.site(F.col("url")))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "html")
    return rows.mapInArrow(_reader(sites, tuple(parts), MOST_CHARS), f"{typed}, cards {_CARD_SQL}, pane string, details array<string>, has_next boolean")


def scan_cards(pages: DataFrame, sites: dict[str, Site] = SITES) -> DataFrame:
    """One row per card: the page's columns without html, pos, title, company, location, url, source and query.

    Addresses are made whole from the page's; a missing address is made from the card's id. What has no link is
    no card here. Cards are not yet checked or deduplicated, see collect_cards.
    """
    read = read_pages(pages, sites, ["cards"])
    kept = [c for c in pages.columns if c not in ("html", "url")]
    rows = read.select(*kept, F.col("url").alias("__page"), "site", F.posexplode("cards").alias("pos", "c"))
    base = keys.origin(F.col("__page"))
    href = keys.absolute(F.coalesce("c.href", F.lit("")), base)
    made = F.when(F.coalesce("c.id", F.lit("")) != "", F.concat(base, F.lit("/viewjob?jk="), F.col("c.id")))
    stripped = [k for k, s in sites.items() if s.strip_query]
    cleaned = [k for k, s in sites.items() if s.clean_title]
    whole = F.coalesce(F.nullif(href, F.lit("")), made, F.lit(""))
    pick = lambda c: first_present(*[squeeze(F.get(f"c.{c}", i)) for i in range(3)])
    title = first_present(pick("title"), squeeze(F.col("c.link_text")))
    return rows.select(
        *kept, "pos",
        F.when(F.col("site").isin(cleaned), title_text(title)).otherwise(title).alias("title"), pick("company").alias("company"), pick("location").alias("location"),
        F.when(F.col("site").isin(stripped), keys.without_query(whole)).otherwise(whole).alias("url"),
        keys.site_label(F.col("site")).alias("source"), keys.search_query(F.col("__page")).alias("query"),
    )


def next_pages(pages: DataFrame, sites: dict[str, Site] = SITES) -> DataFrame:
    """(page's columns without html, site, n_cards, has_next): whether a page leads on to another, and how many cards are on it, with a link or without one."""
    kept = [c for c in pages.columns if c != "html"]
    return read_pages(pages, sites, ["cards", "linkless", "next"]).select(*kept, "site", F.size("cards").alias("n_cards"), "has_next")


def scan_details(pages: DataFrame, sites: dict[str, Site] = SITES) -> DataFrame:
    """(page's columns without html, description): the first candidate text that is long enough, on sites with detail pages;
    elsewhere the pane's text."""
    read = read_pages(pages, sites, ["pane", "details"])
    most = max([1, *(len(s.detail) for s in sites.values())])
    fetched = detail_text(*[F.get("details", i) for i in range(most)])
    with_detail = [k for k, s in sites.items() if s.detail]
    kept = [c for c in pages.columns if c != "html"]
    return read.select(*kept, F.when(F.col("site").isin(with_detail), fetched).otherwise(F.coalesce("pane", F.lit(""))).alias("description"))
