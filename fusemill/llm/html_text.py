"""HTML extraction by consensus host paths.

Each page's containers are scored on the executors by how much running text they hold; Spark sums the scores by host and generalised
tag-class path (numbers in class names are alike), and the path with the greatest sum wins the host. Pages are then extracted again from the
containers on the winning path; a page without text there falls back on its own best path.

A page is parsed once: its blocks of text, and for each path the runs of blocks that its containers hold, are written to the shared folder, so that the second
extraction only joins runs of blocks. Every path of a page that holds text votes. Containers on one path never hold each other; all of them are extracted, in page order.

Scale: neither html nor text is shuffled while the winners, one row a host, are at most ``BROADCAST_HOSTS``, which is counted: they are broadcast. More of them
meet the pages in a join over ``SALT`` parts of each host, so that a host of a third of all pages is dealt to as many tasks. The vote is a partial aggregate by
host and path.

The extracted text is the containers' blocks without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of
readers: elements of such tags, roles or class and id names are left out. White space in a block becomes one space, blocks are joined by
line feeds, character references are decoded. Line breaks inside a block are white space.

Defined results: null or empty html gives '' and 0; a null url has the empty host; markup of any kind and length is read whole without failing, unclosed elements
end with what holds them; equal votes go to the deeper path, then the later name; repeated rows and null ids are extracted each; an empty table gives an empty
result; further columns pass under any name, and one named like an added column is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.llm.common import ROW, boxed, cut, named, stored, unboxed

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div body td".split())
#: Start tags that end an open element, up to the nearest element of the second set.
_ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_SCOPE = frozenset("article section div body td th table blockquote li figure main aside header footer nav form".split())
SKIP_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select textarea svg canvas object embed audio video menu head title dialog".split())
_TELLING = frozenset(("main", "h1"))
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
SKIP_NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|rail|aside|cookies?|consent|gdpr|notice|notices|alert|banner|modal|popup|overlay"
    r"|ads?|advert|adverts|advertisement|sponsored?|promo|promoted|share|sharing|social|related|recommended|subscribe|newsletter|signup|login|pagination|pager|widget"
    r"|comments?|commentlist|respond|replies|disqus|skip|toolbar|tags)(?:$|[-_\s\d])",
    re.I,
)
#: Names of readers' comments, which may well be longer than the article.
COMMENT_NAMES = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|respond|replies|disqus)(?:$|[-_\s\d])", re.I)
#: A block that a name (or form) marks for skipping stays if it holds this share of the page's running text: then the name tells of the layout, not of the content.
LAYOUT_SHARE = 0.6
#: Hosts whose winning paths are broadcast at most, and the parts that a host is dealt to beyond.
BROADCAST_HOSTS, SALT = 50_000, 64
_BONUS = {"article": 1.5, "main": 1.4, "body": 0.9, "td": 0.9}


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    path: str
    skip: bool
    link: bool
    order: int
    text: int = 0  # characters of running text below
    links: int = 0
    start: int = 0  # first block
    end: int = -1
    suspect: str = ""  # marked for skipping by its name: "block", "layout" (a name of several parts, or a form) or "comments"
    held: frozenset[str] = frozenset()  # which of article, main and h1 stand below


@dataclass(slots=True)
class Page:
    containers: list[Element] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    owners: list[tuple[Element, int]] = field(default_factory=list)  # of each block: the element that holds it, and its linked characters
    suspects: list[Element] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4]) for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _name(tag: str, a: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in a.get("class", "").split()})
    return ".".join([tag, *classes])


def parse(source: str) -> Page:
    """Blocks of text outside skipped elements, and the containers with the blocks that they span."""
    page = Page()
    root = Element("", None, "", False, False, 0)
    stack = [root]
    open_tags: dict[str, int] = {}
    pending: list[tuple[str, bool]] = []

    def flush() -> None:
        if not pending:
            return
        text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in pending))).strip()
        linked = sum(len(t) for t, is_link in pending if is_link)
        pending.clear()
        if text:
            page.blocks.append(text)
            page.owners.append((stack[-1], min(linked, len(text))))
            e = stack[-1]
            while e is not None:
                e.text += len(text)
                e.links += min(linked, len(text))
                e = e.parent

    def close(depth: int) -> None:
        """Pop the stack down to ``depth`` elements."""
        while len(stack) > depth:
            if stack[-1].tag in BLOCK:
                flush()
            e = stack.pop()
            open_tags[e.tag] -= 1
            e.end = len(page.blocks)

    def end(tags: frozenset[str], scope: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                close(k)
                return
            if stack[k].tag in scope:
                return

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None or m.start() > at:
            text = source[at : m.start() if m else n]
            if not stack[-1].skip:
                pending.append((text, stack[-1].link))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_tags.get(tag):
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                # the end of an inline element doesn't reach out of the block that holds it
                if tag in BLOCK or not any(stack[k].tag in BLOCK for k in range(depth + 1, len(stack))):
                    close(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in _ENDS:
            end(*_ENDS[tag])
        if tag in BLOCK:
            if open_tags.get("p"):
                end(frozenset(("p",)), _SCOPE)
            flush()
        if tag == "br" or tag in VOID:
            if not stack[-1].skip:
                pending.append((" ", False))
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("a", "b", "i", "span", "em", "strong"):
            continue
        up = stack[-1]
        a = _attributes(m[3])
        skip, suspect = up.skip, ""
        if not skip and tag not in ("html", "body", "article", "main"):
            label = a.get("class", "") + " " + a.get("id", "")
            skip = tag in SKIP_TAGS - {"form"} or a.get("role", "").lower() in SKIP_ROLES or "hidden" in m[3] and re.search(r"(?:^|\s)hidden(?:\s|=|$)", m[3]) is not None
            skip = skip or a.get("aria-hidden", "").lower() == "true"
            if not skip and (tag == "form" or label != " " and any(SKIP_NAMES.search(x) for x in label.split())):
                # what holds blocks is judged when the whole page is known; within a line a name is enough
                marks = [x for x in label.split() if SKIP_NAMES.search(x)]
                suspect = "comments" if COMMENT_NAMES.search(label) else "layout" if all(SKIP_NAMES.fullmatch(x) is None for x in marks) else "block"
                skip = tag not in BLOCK
        e = Element(tag, up, f"{up.path}/{_name(tag, a)}" if tag in BLOCK else up.path, skip, up.link or tag == "a", len(page.containers), start=len(page.blocks), suspect=suspect)
        if suspect and not skip:
            page.suspects.append(e)
        if tag in _TELLING and not skip:
            above = up
            while above is not None:
                above.held |= {tag}
                above = above.parent
        stack.append(e)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in CONTAINER and not skip:
            page.containers.append(e)
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            if not skip:
                pending.append((source[at : stop.start() if stop else n], e.link))
            at = stop.start() if stop else n
    close(1)
    flush()
    root.end = len(page.blocks)
    page.containers.append(root)  # what stands in no container
    _without_suspects(page, root)
    return page


def _without_suspects(page: Page, root: Element) -> None:
    """Take out the blocks of the elements marked for skipping, but for those whose name tells of the page's layout.

    Such an element holds main, or LAYOUT_SHARE of the page's running text with no article outside; and either an article lies inside or the name is made of several parts (side-by-side, has-related): one
    word alone (notice) tells what it holds, however short the rest of the page is. One named after comments has to hold main or h1, since comments may outweigh the article and be articles themselves.
    """
    _take_out(page, {id(e) for e in page.suspects if e.suspect == "comments" and not {"main", "h1"} & e.held})
    whole = root.text - root.links
    articles = [e for e in page.containers if e.tag in ("article", "main") and e.text > 0]
    gone: set[int] = set()
    for e in page.suspects:
        layout = e.suspect == "comments" or "main" in e.held
        if not layout and e.text - e.links >= LAYOUT_SHARE * whole > 0:
            within = [_under(x, {id(e)}) for x in articles]
            layout = all(within) and (any(within) or e.suspect == "layout")
        if not layout:
            gone.add(id(e))
    _take_out(page, gone)


def _under(e: Element | None, tops: set[int]) -> bool:
    while e is not None:
        if id(e) in tops:
            return True
        e = e.parent
    return False


def _take_out(page: Page, gone: set[int]) -> None:
    """Take the elements of these ids out of the page, with what stands below."""
    if not gone:
        return
    stays: list[int] = [0]  # of the blocks before each place, how many stay
    for text, (owner, linked) in zip(page.blocks, page.owners, strict=True):
        out = _under(owner, gone)
        stays.append(stays[-1] + (not out))
        e = owner if out else None
        while e is not None:
            e.text -= len(text)
            e.links -= linked
            e = e.parent
    kept = [k for k in range(len(page.blocks)) if stays[k + 1] > stays[k]]
    page.blocks, page.owners = [page.blocks[k] for k in kept], [page.owners[k] for k in kept]
    page.containers = [e for e in page.containers if not _under(e, gone)]
    page.suspects = [e for e in page.suspects if not _under(e, gone)]
    for e in page.containers:
        e.start, e.end = stays[e.start], stays[e.end]


def score(e: Element) -> float:
    """Running text of a container, links counted against it, weighed by what its tag promises."""
    return max(0.0, e.text - 2.0 * e.links) * _BONUS.get(e.tag, 0.8 if not e.tag else 1.0)


@dataclass(slots=True)
class Run:
    """What a page holds on one path."""

    path: str
    score: float
    share: float
    spans: list[tuple[int, int]]


def runs(page: Page) -> list[Run]:
    """Paths with text, the page's best one first: greatest score, then deepest, then first in the page.

    share is the vote: the part of the best score, sharpened so that a container that all pages have, as body, doesn't win by being everywhere. What
    stands in no container has the empty path and no vote.
    """
    by_path: dict[str, list[Element]] = {}
    for e in page.containers:
        if e.text > 0:
            by_path.setdefault(e.path if e.tag else "", []).append(e)
    found = [Run(p, sum(map(score, es)), 0.0, [(e.start, e.end) for e in sorted(es, key=lambda e: e.start)]) for p, es in by_path.items()]
    first = {p: min(e.order for e in es) for p, es in by_path.items()}
    found.sort(key=lambda r: (-r.score, -r.path.count("/"), first[r.path]))
    top = max((r.score for r in found if r.path), default=0.0)
    for r in found:
        r.share = (r.score / top) ** 8 if r.path and top > 0 else 0.0
    return found


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARSED = "struct<blocks:array<string>,runs:array<struct<path:string,share:double,spans:array<struct<start:int,end:int>>>>>"


def _parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for sources in batches:
        pages = [parse(x or "") for x in sources]
        found = [[{"path": r.path, "share": r.share, "spans": [{"start": a, "end": b} for a, b in r.spans]} for r in runs(p)] for p in pages]
        yield pd.DataFrame({"blocks": [p.blocks for p in pages], "runs": found})


def _winners(parsed: DataFrame) -> DataFrame:
    """host, path, votes: the winning path of each host. parsed: host, runs."""
    votes = parsed.select("host", F.explode("runs").alias("r")).where(F.col("r.share") > 0).select("host", "r.path", "r.share")
    summed = votes.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"))
    best = F.max(F.struct("votes", (F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("depth"), "path"))
    return summed.groupBy("host").agg(best.alias("b")).select("host", F.col("b.path").alias("path"), F.col("b.votes").alias("votes"))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the winning path of each host."""
    parsed = pages.select(host_of(named(url_col)).alias("host"), F.pandas_udf(_parsed, _PARSED)(named(html_col)).alias("p"))
    return _winners(parsed.select("host", "p.runs"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) plus host, path (the winning one, null without any), text and n_chars."""
    columns = pages.columns if keep is None else keep
    made = F.pandas_udf(_parsed, _PARSED)(named(html_col))
    page = pages.select(boxed(pages.select(*[named(c) for c in columns])), host_of(named(url_col)).alias("host"), made.alias("p"))
    parsed = stored(page.select(ROW, "host", "p.*"))
    winners = cut(_winners(parsed)).select(F.col("host").alias("of_host"), F.col("path").alias("won"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = parsed.join(F.broadcast(winners), F.col("host") == F.col("of_host"), "left")
    else:
        dealt = parsed.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
        each = winners.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = dealt.join(each, (F.col("host") == F.col("of_host")) & (F.col("part") == F.col("of_part")), "left")
    on_path = F.get(F.filter("runs", lambda r: r["path"] == F.col("won")), F.lit(0))
    joined = joined.select(ROW, "host", "won", "blocks", F.coalesce(on_path, F.get("runs", F.lit(0)))["spans"].alias("spans"))
    held = F.flatten(F.transform("spans", lambda s: F.slice("blocks", s["start"] + 1, s["end"] - s["start"])))
    text = F.coalesce(F.array_join(held, "\n"), F.lit(""))
    out = joined.select(ROW, "host", "won", text.alias("text"))
    return unboxed(out, columns, host=F.col("host"), path=F.col("won"), text=F.col("text"), n_chars=F.length("text").cast("long"))
