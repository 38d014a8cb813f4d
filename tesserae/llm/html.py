"""HTML main text by nearest-URL page differencing.

A page is parsed into blocks, one line of text each, menus and footers included. Pages are ordered
by host and URL path; each is paired with that neighbour of the same host that shares more leading
path segments (the one before it on ties). Neighbours with the same html are copies of the page, and
the next page beyond them is taken. The lines of the two are aligned by their longest
common subsequence, and the shared ones, which repeat from page to page and so belong to the site,
are deleted. Where that would leave nothing the pair are versions of one page: the other neighbour
is tried, and if it leaves nothing either the lines stay.

Two things go before the differencing. Elements and roles that never hold the article (``nav``,
``footer``, ``aside``, ``form``, a header outside the article and the like, and boxes whose class or
id is one of ``_AD``, ``_SIDE`` or ``_CHROME`` as a whole word) are aligned but never returned. And
an ``article`` is the author's own word on where the text stands: a page with one returns its
article, of which a shared line is deleted only if it consists of links, or if both pages also have
it outside their articles; a sentence that two articles share is content. Teaser cards, that is several
articles with less text than what stands beside them, are no such word.

An article or main element inside a menu, form, header or marked box that was never closed, or that
is in truth a wrapper, counts as content again; articles inside comments, sidebars, asides and
footers do not.

One shuffle: rows are range-partitioned by (host, path), so a host with a third of all pages spreads
over partitions, and a page's neighbours stand beside it in its task. Only the first and last pages
of a partition need their neighbour from another one; these few go to one more, small step.

Defined results: null or empty html gives an empty text; a null url is a host of its own with an
empty path; repeated rows are copies of each other; a page alone on its host keeps its lines; pages
of any length are parsed whole; ties of path are ordered by url, id and content; an empty table
gives an empty result; input columns other than the three are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.runtime import ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_GONE = frozenset("script style noscript template iframe object svg math canvas audio video title select textarea".split())
#: Elements that are site or page furniture; an article inside the second kind is none either.
_FRAME = frozenset("nav form button dialog menu header".split())
_ASIDE = frozenset("aside footer".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_BOXES = frozenset("address blockquote details div dl fieldset figure hgroup ins ol section table ul".split())
_FRAME_ROLES = frozenset("navigation banner search dialog alert alertdialog form menu menubar".split())
_ASIDE_ROLES = frozenset("contentinfo complementary".split())
_AD = frozenset("ad ads advert advertisement adsbygoogle sponsored".split())
_SIDE = frozenset("comments comment-list commentlist comments-area disqus_thread sidebar".split())
_CHROME = frozenset(
    "menu navbar breadcrumb breadcrumbs footer site-footer site-header masthead newsletter cookie-notice cookie-banner "
    "cookie-consent notice share social modal popup".split()
)
_SPACE = re.compile(r"\s+")
OUT, REST, MAIN, ARTICLE = range(4)


class Line(NamedTuple):
    text: str
    zone: int
    links: bool


class _Blocks(HTMLParser):
    """Lines of a page with their zone, and whether they consist of links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.articles = 0
        self.open: Counter[str] = Counter()
        self.held: list[tuple[str, tuple]] = []  # element, and the state to go back to
        self.state = (REST, False, False)  # zone, no text here, no article here
        self.anchors = 0
        self.text: list[str] = []
        self.plain = False

    def flush(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if line:
                self.lines.append(Line(line, self.state[0], not self.plain))
            self.plain = False

    def _entered(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple:
        zone, gone, strict = self.state
        said = {k: v or "" for k, v in attrs}
        role = said.get("role", "").strip().lower()
        if tag == "main" or role == "main":
            return (zone if zone == ARTICLE else MAIN), False, False
        if tag == "article" or role == "article":
            self.articles += not strict
            return (OUT if strict else ARTICLE), False, strict
        if tag in ("html", "body"):
            return self.state
        hidden = "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", ""))
        if tag in _GONE or hidden:
            return zone, True, strict
        marks = set(f"{said.get('class', '')} {said.get('id', '')}".lower().split()) if tag in _BOXES else set()
        if tag in _ASIDE or role in _ASIDE_ROLES or marks & _SIDE:
            return OUT, gone, True
        inside = zone in (MAIN, ARTICLE)
        frame = tag in _FRAME and not (tag == "header" and inside)
        if frame or role in _FRAME_ROLES or marks & _AD or (zone != ARTICLE and marks & _CHROME):
            return OUT, gone, strict
        return self.state

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.flush()
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag == "a":
            self.anchors += 1
            return
        state = self._entered(tag, attrs)
        if state != self.state or tag in _BOXES or tag in ("article", "main", "body", "html"):
            self.flush()
            self.held.append((tag, self.state))
            self.open[tag] += 1
            self.state = state

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        elif tag in _BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        while self.open[tag]:
            self.flush()
            name, self.state = self.held.pop()
            self.open[name] -= 1
            if name == tag:
                return

    def handle_data(self, data):
        if not self.state[1]:
            self.text.append(data)
            self.plain = self.plain or (not self.anchors and not data.isspace())


class Page(NamedTuple):
    lines: list[Line]
    hashes: list[int]
    articles: int


def parse(html: str | None) -> Page:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return Page(parser.lines, [xxhash.xxh64_intdigest(x.text.encode()) for x in parser.lines], parser.articles)


def wanted(page: Page, shared: set[int]) -> tuple[list[int], int]:
    """Places of the lines that may be the article, and the zone that the page itself marks."""
    places = {z: [i for i, x in enumerate(page.lines) if x.zone == z] for z in (REST, MAIN, ARTICLE)}
    size = lambda at: sum([len(page.lines[i].text) for i in at if i not in shared])
    beside = sorted(places[REST] + places[MAIN])
    if places[ARTICLE] and (page.articles == 1 or size(places[ARTICLE]) >= size(beside)):
        return places[ARTICLE], ARTICLE
    if places[ARTICLE]:
        return sorted(beside + places[ARTICLE]), REST
    return (places[MAIN], MAIN) if places[MAIN] else (places[REST], REST)


def differenced(page: Page, others: Iterable[Page]) -> str:
    """The text of ``page`` after differencing with the first of ``others`` that leaves any."""
    for other in others:
        shared = set(common_lines(page.hashes, other.hashes))
        chosen, zone = wanted(page, shared)
        if zone == ARTICLE:
            beside = [{h for h, x in zip(p.hashes, p.lines, strict=True) if x.zone != ARTICLE} for p in (page, other)]
            shared = {i for i in shared if page.lines[i].links or all(page.hashes[i] in b for b in beside)}
        left = [i for i in chosen if i not in shared]
        if left or not chosen:
            return "\n".join([page.lines[i].text for i in left])
    return "\n".join([page.lines[i].text for i in wanted(page, set())[0]])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski)."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < min(hi_a, hi_b) and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    where: dict[int, list[int]] = {}
    for j in range(hi_b - 1, lo - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(lo, hi_a):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle = []
    at = links[-1] if links else None
    while at:
        middle.append(at[0])
        at = at[1]
    return [*range(lo), *reversed(middle), *range(hi_a, len(a))]


def steps_shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


class Run(NamedTuple):
    """Neighbouring pages of a host with the same html: copies of one page, as (path, url, id, k, mine)."""

    host: str
    html: str
    rows: list[tuple]

    def path(self, end: int) -> str:
        return self.rows[end][0]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Sorted rows (host, path, url, id, k, html, mine) by runs."""
    now = None
    for batch in batches:
        for i in range(batch.num_rows):
            host, path, url, key, k, html, *mine = [c[i].as_py() for c in batch.columns]
            if not now or now.host != host or now.html != html:
                if now:
                    yield now
                now = Run(host, html, [])
            now.rows.append((path, url, key, k, mine[0] if mine else True))
    if now:
        yield now


def in_place(found: Iterable[Run], inner: bool) -> Iterator[tuple[Run, str]]:
    """Each run with its text after differencing with its neighbours; ``inner`` leaves out the first and last."""
    trail: list[tuple[Run | None, Page | None]] = [] if inner else [(None, None)]
    for run in _ended(found, inner):
        trail.append((run, parse(run.html) if run else None))
        if len(trail) < 3:
            continue
        (before, p), (now, page), (after, n) = trail
        del trail[0]
        sides = [(r, x) for r, x in ((before, p), (after, n)) if r and r.host == now.host]
        if len(sides) == 2 and steps_shared(now.path(-1), after.path(0)) > steps_shared(now.path(0), before.path(-1)):
            sides.reverse()
        yield now, differenced(page, [x for _, x in sides])


def _ended(found: Iterable[Run], inner: bool) -> Iterator[Run | None]:
    yield from found
    if not inner:
        yield None


def _texts(kind: pa.DataType, inner: bool):
    """Texts of the pages of a partition; ``inner``: of those whose neighbours are all in it."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.string(), pa.string()), strict=True)], ["id", "url", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for found, text in in_place(runs(batches), inner):
            for _, url, key, _, mine in found.rows:
                if mine:
                    held.append((key, url, text))
                    size += len(text)
                if size > 4 << 20 or len(held) >= 2000:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def _edges(kind: pa.DataType):
    """The first and the last run of a partition (``mine``), and the ends of the runs beside them."""
    types = [pa.string(), pa.string(), pa.string(), kind, pa.int64(), pa.string(), pa.bool_()]

    def out(run: Run, mine: bool) -> Iterator[pa.RecordBatch]:
        rows = run.rows if mine else run.rows[:1] + run.rows[1:][-1:]
        for at in range(0, len(rows), 500):
            some = [(run.host, p, u, i, k, run.html, mine) for p, u, i, k, _ in rows[at : at + 500]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], [*_KEYS, "html", "mine"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[Run] = []
        for n, found in enumerate(runs(batches)):
            if n == 0:
                yield from out(found, True)
                continue
            if n == 2:
                yield from out(last[0], False)
            last = [*last[-1:], found]
        if len(last) == 2 and n > 2:
            yield from out(last[0], False)
        if last:
            yield from out(last[-1], True)

    return run


_KEYS = ["host", "path", "url", "id", "k"]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)``, one row per row of ``pages``."""
    spark = pages.sparkSession
    ship(spark)
    named = pages.select(
        F.col(f"`{url_col}`").alias("url"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")
    )
    kind, url = named.schema["id"].dataType, F.coalesce("url", F.lit(""))
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    rows = named.select(
        F.lower(F.regexp_extract(url, scheme + r"([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(F.regexp_replace(url, scheme + "[^/?#]*", ""), r"[?#].*$", "").alias("path"),
        "url",
        "id",
        F.xxhash64("html").alias("k"),
        "html",
    )
    # a fixed number of partitions, so that both readers of the exchange see the same ends
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *_KEYS).sortWithinPartitions(*_KEYS)
    of, said = to_arrow_type(kind), f"id {kind.simpleString()}, url string, text string"
    inner = placed.mapInArrow(_texts(of, True), said)
    schema = f"host string, path string, url string, id {kind.simpleString()}, k long, html string, mine boolean"
    edges = placed.mapInArrow(_edges(of), schema)
    # two runs and two pages a partition
    rest = edges.repartition(1).sortWithinPartitions(*_KEYS).mapInArrow(_texts(of, False), said)
    return inner.unionByName(rest)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return main_text(pages).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )
