"""Listing pages → posting records.

A small per-page helper turns HTML into candidate entries; everything else — URL rules,
text filters, deduplication in the page, choice of layout, keys — is Column expressions on
the candidate array of the same row, so the whole extraction is one narrow stage.
"""

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata import vocab
from jobstrata.functions.rules import normalise_date_posted
from jobstrata.functions.urls import (
    SiteRules, era_site, is_posting_url, numbered_site, record_key, resolve_url, slug_site,
)
from jobstrata.schemas import LISTING_RECORD

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "template"}
# plain tags, as most pages have throughout, and the text between them
_PLAIN = re.compile(
    r'<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z_:][-a-zA-Z0-9_:.]*="[^"<>&]*")*)[ \t\n\r\f]*(/?)>'
    r"|</([a-zA-Z][a-zA-Z0-9]*)>|([^<]+)")
_PLAIN_ATTRIBUTE = re.compile(r'([a-zA-Z_:][-a-zA-Z0-9_:.]*)="([^"]*)"')
# elements whose content follows other rules
_RAW = {"plaintext", *HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())}


@dataclass(slots=True)
class Node:
    index: int
    tag: str
    attrs: dict
    classes: list
    parent: int
    end: int = 0
    first_text: int = 0
    last_text: int = 0
    place: int = 0


@dataclass(frozen=True)
class Step:
    """One simple selector: tag, class and attribute, each optional."""

    tag: str
    css: str
    attribute: str
    value: str

    def fits(self, node):
        return (
            (not self.tag or node.tag == self.tag) and (not self.css or self.css in node.classes)
            and (not self.attribute or (self.attribute in node.attrs and (
                not self.value or self.value in node.attrs[self.attribute].split())))
        )


def _step(text):
    head, _, attribute = text.partition("[")
    tag, _, css = head.partition(".")
    name, _, value = attribute.rstrip("]").partition("=")
    return Step(tag, css, name, value.strip("'\""))


@lru_cache(maxsize=None)
def _parsed(selectors):
    """Comma-separated descendant chains of simple selectors."""
    return tuple(tuple(_step(t) for t in one.split()) for one in selectors.split(","))


class Page(HTMLParser):
    """Flat element list in document order; a subtree is a contiguous index range."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes, self.texts, self._open, self._pending = [], [], [], ""
        self.by_class, self.by_tag = defaultdict(list), defaultdict(list)
        self.children = defaultdict(list)  # by parent: elements, or the texts of bare strings (blank ones as "")
        self._found, self._silent = {}, 0
        rest = self._read_plain(html)
        if rest:
            self.feed(rest)
            self.close()
        self._flush()
        while self._open:
            self._shut()

    def _read_plain(self, html):
        """Read up to the first thing that is no plain tag or text, and give what is left to the full parser."""
        at, match = 0, _PLAIN.match
        while found := match(html, at):
            tag, attrs, closed, end, text = found.groups()
            if text is not None:
                self._pending += unescape(text) if "&" in text else text
            elif end is not None:
                self.handle_endtag(end.lower())
            else:
                tag = tag.lower()
                if tag in _RAW:
                    break
                self.handle_starttag(tag, [(k.lower(), v) for k, v in _PLAIN_ATTRIBUTE.findall(attrs)] if attrs else ())
                if closed:
                    self.handle_endtag(tag)
            at = found.end()
        return html[at:]

    def _flush(self):
        if not self._pending:
            return
        text, self._pending = self._pending.strip(), ""
        if self._silent:
            return
        self.children[self._open[-1] if self._open else -1].append(text)
        if text:
            self.texts.append(text)

    def _shut(self):
        node = self.nodes[self._open.pop()]
        node.end, node.last_text = len(self.nodes), len(self.texts)
        self._silent -= node.tag in _SILENT

    def handle_starttag(self, tag, attrs):
        self._flush()
        parent = self._open[-1] if self._open else -1
        held = {k: v or "" for k, v in attrs}
        siblings, index = self.children[parent], len(self.nodes)
        node = Node(index, tag, held, held["class"].split() if "class" in held else [], parent, 0, len(self.texts), 0, len(siblings))
        self.nodes.append(node)
        siblings.append(node)
        self.by_tag[tag].append(index)
        for css in dict.fromkeys(node.classes) if node.classes else ():
            self.by_class[css].append(index)
        self._open.append(index)
        self._silent += tag in _SILENT
        if tag in _VOID:
            self._shut()

    def handle_endtag(self, tag):
        self._flush()
        if self._open and self.nodes[self._open[-1]].tag == tag:
            self._shut()
        elif any(self.nodes[i].tag == tag for i in self._open):
            while self.nodes[self._open[-1]].tag != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        self._pending += data

    def handle_comment(self, data):
        self._flush()
        self.children[self._open[-1] if self._open else -1].append("")

    def text(self, node, joiner=""):
        return joiner.join(self.texts[node.first_text:node.last_text])

    def _matches(self, node, steps):
        *above, last = steps
        if not last.fits(node):
            return False
        up = node.parent
        while above and up >= 0:
            if above[-1].fits(self.nodes[up]):
                above.pop()
            up = self.nodes[up].parent
        return not above

    def _matching(self, steps, within, first=False):
        """Indexes of the matching elements inside an element, ascending, or of the first; only those with the last step's class or tag are looked at."""
        last, found = steps[-1], []
        listed = self.by_class.get(last.css) if last.css else self.by_tag.get(last.tag)
        if not listed:
            return found
        low, high = (within.index + 1, within.end) if within is not None else (0, len(self.nodes))
        for place in range(bisect_left(listed, low), len(listed)):
            i = listed[place]
            if i >= high:
                break
            if self._matches(self.nodes[i], steps):
                found.append(i)
                if first:
                    break
        return found

    def select(self, selectors, within=None):
        """Matching elements in document order."""
        found = [i for steps in _parsed(selectors) for i in self._matching(steps, within)]
        return [self.nodes[i] for i in sorted(set(found))] if found else []

    def one(self, selectors, within=None):
        """First matching element."""
        firsts = [i for steps in _parsed(selectors) for i in self._matching(steps, within, first=True)]
        return self.nodes[min(firsts)] if firsts else None

    def first_text_of(self, selectors, within, longer_than=0):
        """Text of the first element of each selector, in selector order, first long enough."""
        for s in selectors:
            found = self.one(s, within)
            if found is not None and len(self.text(found)) > longer_than:
                return self.text(found)
        return ""

    def texts_after(self, node):
        """Texts of the siblings behind a node, elements, comments and bare strings alike, blank ones as "" ."""
        for child in islice(self.children[node.parent], node.place + 1, None):
            yield child if isinstance(child, str) else self.text(child)

    def signs(self, index):
        """The editorial words and the first date inside an element, or in the page for -1; found once each."""
        if index not in self._found:
            whole = self.text(self.nodes[index], " ") if index >= 0 else " ".join(self.texts)
            self._found[index] = tuple(m.group(0) if m else "" for m in (_EDITORIAL.search(whole), _DATE.search(whole)))
        return self._found[index]


_DATE = re.compile(vocab.DATE_PATTERN)
_JOB_LINK = re.compile(vocab.JOB_LINK_PATTERN, re.I)
_CHROME = re.compile(vocab.CHROME_TEXT_PATTERN, re.I)
_EDITORIAL = re.compile(vocab.EDITORIAL_TEXT_PATTERN, re.I)


def _entry(layout, rank, href, title, company="", location="", date="", context="", stamp=""):
    """A candidate; `context` holds what later filters look at, `stamp` the first date around it, never whole texts."""
    return {"layout": layout, "rank": rank, "href": href, "title": title, "company": company, "location": location,
            "date_posted": date, "context": context, "stamp": stamp}


def _structured(page, profile, year):
    for rank, selector in enumerate(profile.container_selectors):
        for box in page.select(selector):
            link = page.one("a[href]", box)
            if link is not None:
                title = page.first_text_of(vocab.TITLE_SELECTORS, box) or page.text(link)
                yield _entry("structured", rank, link.attrs["href"], title,
                             page.first_text_of(vocab.COMPANY_SELECTORS, box),
                             page.first_text_of(vocab.PLACE_SELECTORS, box),
                             page.first_text_of(vocab.DATE_SELECTORS, box))


def _anchors(page, profile, year):
    for a in page.select("a[href]"):
        parent = page.nodes[a.parent] if a.parent >= 0 else None
        above = page.nodes[parent.parent] if parent is not None and parent.parent >= 0 else None
        title = page.text(a) or page.first_text_of(["h2", "h3", "h4", ".titulo"], parent)
        yield _entry("anchor_fallback", 1000, a.attrs["href"], title,
                     page.first_text_of(vocab.COMPANY_SELECTORS[:3], above),
                     page.first_text_of(vocab.PLACE_SELECTORS[:3], above),
                     page.first_text_of([".data", ".date", ".publicacao"], above))


def _headings(page, profile, year):
    blocks = page.select("article.post, div.post, div.type-post, div.entry")
    for box in blocks or page.select("h2, h3"):
        heading = box.tag in ("h2", "h3")
        link = page.one("a" if heading else "a[rel='bookmark'], .entry-title a, h2 a, h1 a, h3 a", box)
        if link is not None:
            stamp = None if heading else page.one(".published, .entry-date, time, .date", box)
            yield _entry("headings", 0, link.attrs.get("href", ""), page.text(link),
                         date=page.text(stamp) if stamp is not None else "")


def _era_anchors(page, rank):
    for a in page.select("a[href]"):
        near = islice(page.texts_after(page.nodes[a.parent]), 3) if a.parent >= 0 else ()
        company = next((t for t in near if 2 < len(t) < 80 and not _DATE.search(t)), "")
        editorial, date = page.signs(a.parent)
        yield _entry("era_anchors", rank, a.attrs["href"], page.text(a), company[:60], context=editorial, stamp=date)


def _grid(page, rank):
    for item in page.select(".item"):
        cells = [page.one(f".c{i}", item) for i in (1, 2, 3, 4)]
        link = (page.one("a[href]", cells[0]) if cells[0] is not None else None) or page.one("a[href]", item)
        title, company, place, stamp = [page.text(c) if c is not None else "" for c in cells]
        yield _entry("grid", rank, link.attrs["href"] if link else "", title or (page.text(link) if link else ""),
                     company, place[:60], stamp, stamp=page.signs(item.index)[1])


def _home(page, rank):
    for box in page.select(".ofertasMiddle, .ofertasDestaqueMiddle"):
        links = page.select("a[href]", box)
        jobs = [a for a in links if _JOB_LINK.search(a.attrs["href"]) or "/emprego/" in a.attrs["href"]
                or "Vacancy" in a.attrs["href"]]
        long = [a for a in links if len(page.text(a)) > 8 and not _CHROME.search(page.text(a))]
        link = next(iter(jobs or long), None)
        if link is not None:
            company = next((t for t in page.texts_after(link) if len(t) > 2 and not _DATE.search(t)), "")
            yield _entry("home", rank, link.attrs["href"], page.text(link), company[:60], stamp=page.signs(box.index)[1])


def _results(page, rank, domain):
    for box in page.select(".resultadosBox"):
        links = page.select("a[href]", box)
        jobs = [a for a in links if _JOB_LINK.search(a.attrs["href"])]
        local = [a for a in links if domain in a.attrs["href"] or a.attrs["href"].startswith(("/emprego", "/vagas"))]
        link = next(iter(jobs or local), None)
        whole = page.text(box, " ")
        date = _DATE.search(whole)
        before = whole[:date.start()].strip() if date else whole
        after = whole[date.end():].strip() if date else ""
        title = page.first_text_of(["h2", "h3", "h4", ".titulo", ".title", ".cargo"], box, longer_than=3)
        yield _entry("results", rank, link.attrs["href"] if link else "",
                     title or (page.text(link) if link else "") or before[:120].strip(),
                     page.first_text_of([".empresa", ".company", ".entidade", ".empregador"], box, longer_than=1),
                     after.split("|")[0].strip()[:60], context=whole[:80], stamp=date.group(0) if date else "")


def _by_era(page, profile, year):
    """First and second choice of layout for the page's year; none for a page without a year."""
    if year is None:
        return
    if year >= 2016:
        yield from _results(page, 0, profile.rules.domain)
        yield from _grid(page, 1)
    elif year >= 2013:
        yield from _grid(page, 0)
        yield from _home(page, 1)
    elif year >= 2010:
        yield from _home(page, 0)
        yield from _grid(page, 1)
    else:
        yield from _era_anchors(page, 0)
        yield from _home(page, 1)


_LAYOUTS = {"structured": _structured, "anchor_fallback": _anchors, "headings": _headings, "by_era": _by_era}


@dataclass(frozen=True)
class ListingProfile:
    """How the pages of one site are read."""

    source: str
    rules: SiteRules
    layouts: tuple
    key_mode: str = "url"
    dates_from_text: bool = False
    container_selectors: tuple = tuple(vocab.CONTAINER_SELECTORS)


def container_profile(source: str, domain: str) -> ListingProfile:
    return ListingProfile(source, numbered_site(domain), ("structured", "anchor_fallback"))


def heading_profile(source: str, domain: str) -> ListingProfile:
    return ListingProfile(source, slug_site(domain), ("headings",))


def era_profile(source: str, domain: str) -> ListingProfile:
    return ListingProfile(source, era_site(domain), ("by_era",), "snapshot_url", True)


def page_candidates(html: Column, year: Column, profile: ListingProfile, layout: str) -> Column:
    """Array of candidate entries of a page in one layout, in document order; none for a null page."""
    names = [f.name for f in LISTING_RECORD]
    kinds = {T.StringType(): pa.string(), T.IntegerType(): pa.int32()}
    record = pa.struct([(f.name, kinds[f.dataType]) for f in LISTING_RECORD])

    def read(source, page_year):
        if not source:
            return []
        found = list(_LAYOUTS[layout](Page(source), profile, page_year))
        for i, e in enumerate(found):
            e["pos"] = i
        return found

    @F.arrow_udf(T.ArrayType(LISTING_RECORD))
    def candidates(sources: pa.Array, years: pa.Array) -> pa.Array:
        entries, ends = [], [0]
        for source, page_year in zip(sources.to_pylist(), years.to_pylist()):
            entries += read(source, page_year)
            ends.append(len(entries))
        columns = [pa.array([e[n] for e in entries], record.field(n).type) for n in names]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(record)))

    # kept apart from the projections around it, so that a page is read once a layout and never inside a lambda
    return candidates.asNondeterministic()(html, year)


def text_blocked(text: Column) -> Column:
    """Site chrome, navigation or editorial text, or an unlikely length."""
    return (
        ~F.length(text).between(8, 150) | text.rlike("(?iU)" + vocab.CHROME_TEXT_PATTERN)
        | text.rlike("(?iU)" + vocab.NAV_TEXT_PATTERN) | text.rlike("(?iU)" + vocab.EDITORIAL_TEXT_PATTERN)
    )


def _wanted_before(c):
    """Filters that apply before entries with the same link are merged."""
    title, layout = c["title"], c["layout"]
    read_more = title.contains("Leia mais") | title.contains("Ler mais") | title.contains("Página")
    return (
        F.when(layout == "headings", (F.length(title) >= 8) & ~read_more)
        .when(layout == "era_anchors", ~text_blocked(title) & c["href"].rlike("(?iU)" + vocab.JOB_LINK_PATTERN))
        .otherwise(F.lit(True))
    )


def _wanted_after(c):
    title, layout = c["title"], c["layout"]
    chrome = "(?iU)" + vocab.CHROME_TEXT_PATTERN
    return (
        F.when(layout == "era_anchors", ~c["context"].rlike("(?iU)" + vocab.EDITORIAL_TEXT_PATTERN))
        .when(layout.isin("grid", "home"), (F.length(title) >= 3) & ~title.rlike(chrome))
        # this layout looks for chrome words at the head of the box only
        .when(layout == "results", (F.length(title) >= 3) & ~c["context"].rlike(chrome))
        .otherwise(F.lit(True))
    )


_FOUND = T.ArrayType(T.StructType([*LISTING_RECORD.fields, T.StructField("url", T.StringType())]))


def _with_url(c, rules):
    return F.struct(*[c[f.name].alias(f.name) for f in LISTING_RECORD], resolve_url(c["href"], rules).alias("url"))


def _first_by_link(entries: Column) -> Column:
    """The first entry of each rank and link, in order; sorting keeps this near-linear for large pages."""
    def key(c):
        link = F.when(c["url"] == "", c["pos"].cast("string")).otherwise(c["url"])
        return F.concat_ws("|", c["rank"].cast("string"), link)

    def firsts(ordered):
        found = F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k - 1)["key"] != x["key"], F.lit(True)))
        return F.sort_array(F.transform(found, lambda x: x["at"]))

    ordered = F.array_sort(F.transform(entries, lambda c, i: F.struct(key(c).alias("key"), i.alias("at"))))
    places = F.flatten(F.transform(F.array(ordered), firsts))
    return F.transform(places, lambda at: F.get(entries, at))


def extract_listings(pages: DataFrame, profile: ListingProfile, page_url: str = "page_url", ts: str = "ts",
                     year: str = "year", html: str = "html") -> DataFrame:
    """Posting records of all pages.

    Per page the first layout (or container selector) that yields records is used, and each
    canonical URL counts once, at its first position.  A page is read again for the next
    layout only if the one before left nothing.
    """
    out = pages.select(F.col(page_url).alias("wayback_url"), F.col(ts).alias("arquivo_timestamp"),
                       F.col(year).alias("year"), F.col(html).alias("_html"), F.lit(None).cast(_FOUND).alias("_c"))
    for layout in profile.layouts:
        unread = F.when(F.coalesce(F.size("_c"), F.lit(0)) <= 0, F.col("_html"))
        out = out.withColumn("_n", page_candidates(unread, F.col("year"), profile, layout))
        out = out.withColumn("_n", F.transform("_n", lambda c: _with_url(c, profile.rules)))
        out = out.withColumn("_n", F.filter("_n", lambda c: is_posting_url(c["url"], profile.rules) & _wanted_before(c)))
        out = out.withColumn("_n", _first_by_link(F.col("_n")))
        out = out.withColumn("_n", F.filter("_n", _wanted_after))
        out = out.withColumn("_c", F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.col("_c"))).drop("_n")
    out = out.withColumn("_best", F.array_min(F.transform("_c", lambda c: c["rank"])))
    rows = out.select("wayback_url", "arquivo_timestamp", "year",
                      F.inline(F.filter("_c", lambda c: c["rank"] == F.col("_best"))))
    date = F.col("date_posted")
    if profile.dates_from_text:
        def nonempty(x):
            return F.when(x != "", x)

        date = F.coalesce(nonempty(normalise_date_posted(date)), nonempty(F.substring(date, 1, 10)),
                          normalise_date_posted(F.col("stamp")))
    company = F.when(F.col("company") == vocab.ANONYMOUS_COMPANY, "").otherwise(F.col("company"))
    return rows.select(
        record_key(F.col("url"), F.col("arquivo_timestamp"), F.col("title"), profile.key_mode).alias("record_id"),
        "year", "title", company.alias("company"), "location", date.alias("date_posted"),
        F.col("url").alias("original_url"), "wayback_url", "arquivo_timestamp", F.lit(profile.source).alias("source"),
        "pos",
    )
