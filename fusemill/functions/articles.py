"""Article cleaning and chunking: HTML to blocks with their section path, blocks to chunks of bounded token counts.

Both need a parser or an encoder, so they run in Arrow batches, one article at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an encyclopedia page holds beside its article.
DROPPED_TAGS = ["script", "style", "nav", "footer", "aside"]
DROPPED_TAG_CLASSES = [("sup", "reference"), ("sup", "mw-ref"), ("span", "mw-ref"), ("a", "mw-ref"), ("ol", "references"), ("div", "reflist")]
DROPPED_IDS = ["mw-references-wrap", "toc", "catlinks"]
DROPPED_CLASSES = "toc mw-toc vector-toc navbox vertical-navbox navbox-inner metadata ambox mbox-small hatnote dablink mw-editsection IPA ext-phonos".split()
DROPPED_LINK_TITLES = ("Help:IPA", "Help:Pronunciation")
ARTICLE_CLASS = "mw-parser-output"

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Start tags that end an open element, and the elements beyond which they don't look.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


@dataclass(eq=False)
class Element:
    tag: str
    attributes: dict[str, str]
    parts: list[Element | str] = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def below(self) -> Iterator[Element]:
        """Elements below this one, in page order."""
        todo = [p for p in reversed(self.parts) if isinstance(p, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [p for p in reversed(e.parts) if isinstance(p, Element)]

    def text(self) -> str:
        """Trimmed strings below, joined by spaces."""
        out, todo = [], list(reversed(self.parts))
        while todo:
            p = todo.pop()
            if isinstance(p, Element):
                todo += reversed(p.parts)
            elif p.strip():
                out.append(p.strip())
        return " ".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Element("", {})]

    def _end(self, tags: set[str], until: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES:
            self._end(*_CLOSES[tag])
        if tag in _ENDS_PARAGRAPH:
            self._end({"p"}, {"table", "td", "th", "li", "div", "blockquote"})
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].parts and isinstance(self.open[-1].parts[-1], str):
            self.open[-1].parts[-1] += data
        else:
            self.open[-1].parts.append(data)


def tree(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.open[0]


def _unwanted(e: Element) -> bool:
    a = e.attributes
    return (
        e.tag in DROPPED_TAGS
        or a.get("id") in DROPPED_IDS
        or any(c in DROPPED_CLASSES or (e.tag, c) in DROPPED_TAG_CLASSES for c in e.classes)
        or (e.tag == "a" and a.get("title", "").startswith(DROPPED_LINK_TITLES))
    )


def _pruned(e: Element, unwanted: Callable[[Element], bool]) -> None:
    for x in [e, *e.below()]:
        x.parts = [p for p in x.parts if isinstance(p, str) or not unwanted(p)]


class Block(NamedTuple):
    text: str
    section_path: list[str]
    block_type: str  # paragraph, list or, in a chunker's buffer, overlap


def section_below(path: Sequence[str], heading: str, tag: str) -> list[str]:
    """The section path under a heading: what is above its level, one part at least, and the heading."""
    level = int(tag[1:]) if tag[1:].isdigit() else 2
    return [*path[: max(1, level - 1)], heading]


def blocks_of(html: str | None) -> list[Block]:
    """Headings, paragraphs and lists of the article in page order, without tables, references, navigation and pronunciation.

    Null and empty html have none. A list inside a list is a block of its own and part of the outer one's text.
    """
    page = tree(html or "")
    _pruned(page, _unwanted)
    everything = list(page.below())
    root = next((e for e in everything if e.tag == "div" and ARTICLE_CLASS in e.classes), None) or next((e for e in everything if e.tag == "body"), page)
    _pruned(root, lambda e: e.tag == "table")
    path, out = ["Lead"], []
    for e in root.below():
        if e.tag in _HEADINGS or e.tag == "p":
            text = e.text()
            if e.tag != "p":
                path = section_below(path, text, e.tag)
            if text:
                out.append(Block(text, list(path), "paragraph"))
        elif e.tag in ("ul", "ol"):
            items = [p.text() for p in e.parts if isinstance(p, Element) and p.tag == "li"]
            if items:
                out.append(Block("\n".join(f"- {x}" for x in items), list(path), "list"))
    return out


BLOCKS = "array<struct<text:string,section_path:array<string>,block_type:string>>"


def blocks(html: Column) -> Column:
    """Array of (text, section_path, block_type)."""

    @F.pandas_udf(BLOCKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([[b._asdict() for b in blocks_of(p)] for p in pages], dtype=object)

    return run(html)


class Fact(NamedTuple):
    subject: str
    label: str
    value: str


def _whole(e: Element) -> str:
    """All text below, as it stands."""
    return "".join(p if isinstance(p, str) else _whole(p) for p in e.parts)


def _first(e: Element, tag: str, name: str) -> Element | None:
    return next((x for x in e.below() if x.tag == tag and name in x.classes), None)


def _row_values(row: Element) -> Iterator[str]:
    """What a labelled row says: spans that stand in its data cell itself, then links (those of a birthplace as one value), then list items."""
    cell = _first(row, "td", "infobox-data")
    yield from (_whole(p) for p in (cell.parts if cell else []) if isinstance(p, Element) and p.tag == "span")
    links = [x for x in row.below() if x.tag == "a"]
    at_birth = any(links[0] is x for place in row.below() if place.tag == "div" and "birthplace" in place.classes for x in place.below()) if links else False
    said = [t for x in links if (t := _whole(x))]
    yield from [", ".join(said)] if at_birth else said
    yield from (_whole(x) for x in row.below() if x.tag == "li")


def facts_of(html: str | None, title: str | None = None) -> list[Fact]:
    """Facts of a page's infobox tables in page order; the subject is a table's ``fn`` name, else the page's title. Null html, other tables, rows without a label and empty values have none."""
    out = []
    for table in (e for e in tree(html or "").below() if e.tag == "table" and "infobox" in e.classes):
        named = _first(table, "div", "fn")
        subject = _whole(named) if named else title or ""
        for row in (e for e in table.below() if e.tag == "tr"):
            label = _first(row, "th", "infobox-label")
            if label:
                out += [Fact(subject, _whole(label), v) for v in _row_values(row) if v]
    return out


def infobox_facts(html: Column, title: Column) -> Column:
    """Array of (subject, label, value)."""

    @F.pandas_udf("array<struct<subject:string,label:string,value:string>>")
    def run(pages: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([facts_of(p, t) for p, t in zip(pages, titles, strict=True)], dtype=object)

    return run(html, title)


def infobox_text(facts: Column) -> Column:
    """One line a fact, trimmed as a whole."""
    return F.regexp_replace(F.array_join(F.transform(facts, lambda f: F.concat(f["subject"], F.lit(" -- "), f["label"], F.lit(" --> "), f["value"])), "\n"), r"^\s+|\s+$", "")


class Piece(NamedTuple):
    text: str
    section_path: list[str]
    start: int
    end: int
    n_tokens: int


class Encoder(NamedTuple):
    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]

    def tail(self, text: str, n: int) -> str:
        """The text of the last ``n`` tokens."""
        ids = self.encode(text)
        return self.decode(ids[max(0, len(ids) - n) :]) if ids and n else ""


def chunked(parts: Sequence[Block], encoder: Encoder, least: int = 0, most: int = 500, overlap: int = 100) -> list[Piece]:
    """Blocks joined by blank lines into chunks of at most ``most`` tokens, each beginning with the last ``overlap`` of the one before.

    A longer block is cut into windows of its own. An overlap that leaves the next block no room goes. Offsets count the chunks one after another.
    """
    out: list[Piece] = []
    held: list[Block] = []
    size = at = 0
    count = lambda t: len(encoder.encode(t))

    def put(text: str, path: list[str], n: int) -> None:
        nonlocal at
        out.append(Piece(text, path, at, at + len(text), n))
        at += len(text)

    def flush() -> None:
        nonlocal held, size
        text = "\n\n".join(b.text for b in held if b.text)
        put(text, held[-1].section_path, count(text))
        tail = encoder.tail(text, overlap)
        held, size = [Block(tail, held[-1].section_path, "overlap")], count(tail)

    for b in parts:
        if not b.text.strip():
            continue
        ids = encoder.encode(b.text)
        if len(ids) > most:
            if held:
                flush()
            for k in range(0, len(ids), most - overlap):
                window = ids[k : k + most]
                put(encoder.decode(window), b.section_path, len(window))
            held, size = [], 0
            continue
        if held and size + len(ids) > most:
            if len(held) == 1 and held[0].block_type == "overlap" and size < least:
                held, size = [], 0
            else:
                flush()
                if size + len(ids) > most:
                    held, size = [], 0
        held.append(b)
        size += len(ids)
    if held:
        text = "\n\n".join(b.text for b in held if b.text)
        put(text, held[-1].section_path, count(text))
    return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizers JSON file, made once in a worker."""
    if path not in _encoders:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _encoders[path] = Encoder(lambda x: t.encode(x, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False))
    return _encoders[path]


def token_count(text: Column, tokenizer_path: str) -> Column:
    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder_of(tokenizer_path)
        for texts in batches:
            yield pd.Series([len(e.encode(t or "")) for t in texts])

    return run(text)


PIECES = "array<struct<text:string,section_path:array<string>,start:int,end:int,n_tokens:int>>"


def chunks(docs: DataFrame, tokenizer_path: str, key: str = "doc_key", blocks_col: str = "blocks", least: int = 0, most: int = 500, overlap: int = 100) -> DataFrame:
    """key, idx, chunk_id (hash of key, number and text), text, section_path, start, end, n_tokens."""

    @F.pandas_udf(PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder_of(tokenizer_path)
        for many in batches:
            out = []
            for bs in many:
                parts = [Block(b["text"], list(b["section_path"]), b["block_type"]) for b in (bs if bs is not None else [])]
                out.append([p._asdict() for p in chunked(parts, e, least, most, overlap)])
            yield pd.Series(out, dtype=object)

    each = docs.select(F.col(key), F.posexplode(run(F.col(blocks_col))).alias("idx", "p")).select(key, "idx", "p.*")
    return each.withColumn("chunk_id", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col("idx").cast("string"), F.col("text")), 256))


def sentence_list(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
