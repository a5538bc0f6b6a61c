"""Metadata and section structure of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from docloom.functions.text import jvm, strip
from docloom.session import fresh

# a type object, for a type's name could only be read with a session at hand
SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("breadcrumb", T.ArrayType(T.StringType()))]))
# Patterns of front matter, its keys, version and title lines and headings; elements with body text.
FRONTMATTER = r"\A---\s*\n(.*?)\n---\s*\n"
FRONT_KEY = r"^\s*{}\s*:\s*(.+)$"
VERSION_LINE = r"^\s*(?:doc[_ ]?)?version\s*[:=]\s*(.+)$"
TITLE_LINE = r"^\s*title\s*[:=]\s*(.+)$"
HEADING = r"^(#{1,6})\s+(.*)$"
BODY = frozenset(["p", "li", "td", "blockquote"])
#: Bytes of a batch's texts that are Python objects at once (one text at least); the rest stays in Arrow's buffers.
SLICE_BYTES = 1 << 20
#: Lines from the top in which a version or title line counts.
HEAD_LINES = 40
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = ("script", "style", "template")


def push(stack: list[str], level: int, title: str) -> list[str]:
    """The breadcrumb after a heading: deeper levels go, skipped ones are empty."""
    return [*stack[: level - 1], *[""] * (level - 1 - len(stack)), title]


def markdown_segments(text: str | None) -> list[tuple[str, list[str]]]:
    out, stack, body = [], [], []
    for line in [*(text or "").splitlines(), None]:
        found = re.match(HEADING, line) if line is not None else None
        if line is not None and not found:
            body.append(line)
            continue
        if kept := "\n".join(body).strip():
            out.append((kept, stack))
        body = []
        if found:
            stack = push(stack, len(found[1]), found[2].strip())
    return out


class _Html(HTMLParser):
    """Headings set the breadcrumb from where they open; each body element gives its own whole text, nested ones too.

    An end tag ends what is open inside its element; nothing else ends an element.
    """

    def __init__(self):
        super().__init__()
        self.out, self.stack, self.open = [], [], []  # open: (tag, pieces of text, or None)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        sink = None
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            sink = []
            self.stack = push(self.stack, int(tag[1]), sink)
        elif tag in BODY:
            sink = []
            self.out.append((sink, self.stack))
        self.open.append((tag, sink))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if (data := data.strip()) and not any(tag in _UNSEEN for tag, _ in self.open):
            for _, sink in self.open:
                if sink is not None:
                    sink.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def html_segments(text: str | None) -> list[tuple[str, list[str]]]:
    parser = _Html()
    parser.feed(text or "")
    parser.close()
    return [(" ".join(words), ["".join(c) for c in crumbs]) for words, crumbs in parser.out if words]


class _Head(HTMLParser):
    """The first title's text and the first meta element of the name version."""

    def __init__(self):
        super().__init__()
        self.title, self.meta, self.inside, self.children = None, None, False, 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        if tag == "meta" and self.meta is None and attrs.get("name") == "version":
            self.meta = attrs.get("content") or ""
        if self.inside and tag != "title":
            self.children += 2  # a title with elements in it has no text of its own
        if tag == "title" and self.title is None:
            self.title, self.inside = [], True

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "title"

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)
            self.children += 1


def html_head(text: str) -> tuple[str | None, str | None]:
    """version and title of a page; None where it says neither."""
    parser = _Head()
    for at in range(0, len(text), 1 << 16):
        parser.feed(text[at : at + (1 << 16)])
        if parser.meta is not None and parser.title is not None and not parser.inside:
            break
    else:
        parser.close()
    title = "".join(parser.title or []) if len(parser.title or []) == parser.children else ""
    return (parser.meta.strip() if parser.meta else None), (title.strip() if title else None)


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's texts that take SLICE_BYTES at most, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES, "right")))
        yield first, last
        first = last


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_HEAD = pa.struct([("version", pa.string()), ("title", pa.string())])


@arrow_udf(T.StructType([T.StructField("version", T.StringType()), T.StructField("title", T.StringType())]))
def _head(text: pa.Array) -> pa.Array:
    parts = []
    for a, b in slices(text):
        found = [html_head(t) if t is not None else (None, None) for t in text.slice(a, b - a).to_pylist()]
        parts.append(pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], fields=list(_HEAD)))
    return _joined(parts, _HEAD)


_CRUMBS = pa.list_(pa.string())
_SEGMENT = pa.struct([("text", pa.string()), ("breadcrumb", _CRUMBS)])


def _lists(rows: list[list], kind: pa.DataType | None = None, values: pa.Array | None = None) -> pa.ListArray:
    """Rows of values; values: theirs in order, where they are no plain ones."""
    flat = pa.array(list(chain.from_iterable(rows)), kind) if values is None else values
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), flat)


@arrow_udf(SEGMENTS)
def segment(text: pa.Array, mime: pa.Array) -> pa.Array:
    """Segments by type: Markdown and HTML by their headings, other types as one segment without a breadcrumb."""

    def one(t, m):
        if m == "text/markdown":
            return markdown_segments(re.sub(FRONTMATTER, "", t or "", count=1, flags=re.S))
        if m == "text/html":
            return html_segments(t)
        return [(t, [])] if t else []

    parts = []
    for a, b in slices(text):
        rows = [one(t, m) for t, m in zip(text.slice(a, b - a).to_pylist(), mime.slice(a, b - a).to_pylist())]
        flat = list(chain.from_iterable(rows))
        made = [pa.array([t for t, _ in flat], pa.string()), _lists([c for _, c in flat], pa.string())]
        parts.append(_lists(rows, values=pa.StructArray.from_arrays(made, fields=list(_SEGMENT))))
    return _joined(parts, pa.list_(_SEGMENT))


def segments(text: Column, mime: Column) -> Column:
    """Segments by type; only Markdown and HTML are read outside the JVM."""
    marked = F.coalesce(mime.isin("text/markdown", "text/html"), F.lit(False))
    plain = F.array(F.struct(text.alias("text"), F.array().cast("array<string>").alias("breadcrumb")))
    none = F.array().cast(SEGMENTS)
    return F.when(marked, segment(F.when(marked, text), mime)).when(F.length(text) > 0, plain).otherwise(none)


#: Codes of what the Markdown reader takes for structure, line ends and heading marks, and of their own sign, which comes first.
_CODES = {c: "\\" + chr(ord("a") + i) for i, c in enumerate("\\#\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")}
_END, _NULL = r"\.", r"\0"


def escaped(text: Column, title: bool = False) -> Column:
    """Text that the Markdown reader hands on as it stands, for restored to read: marked ends keep outer white space and empty texts, null
    has a code. In a body LF stays the end of a line; a title has no lines."""
    codes = [(c, code) for c, code in _CODES.items() if title or c != "\n"]
    coded = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), codes, text)
    # the JVM looks a class up in a table if all its characters are below U+0100, in half the time
    narrow = text.rlike("[" + "".join(c for c, _ in codes if c < "\u0100").replace("\\", "\\\\") + "]")
    some = reduce(lambda found, c: found | text.contains(c), "\u2028\u2029", narrow)
    return F.coalesce(F.concat(F.lit(_END), F.when(some, coded).otherwise(text), F.lit(_END)), F.lit(_NULL))


def restored(text: Column) -> Column:
    """What escaped was given, alone or among other text; null if that holds an escaped null."""
    bare = F.replace(text, F.lit(_END), F.lit(""))
    plain = reduce(lambda t, pair: F.replace(t, F.lit(pair[1]), F.lit(pair[0])), reversed(_CODES.items()), bare)
    return F.when(bare.contains("\\"), F.when(~bare.contains(_NULL), plain)).otherwise(bare)


def _found(text: Column, pattern: str, flags: str = "im") -> Column:
    """The first match's first group, stripped; null without a match."""
    return strip(F.nullif(F.regexp_extract(text, jvm(pattern, flags), 1), F.lit("")))  # the groups take one character at least


def metadata(df: DataFrame, text: str = "text", mime: str = "mime_type", pdf_title: str | None = None) -> DataFrame:
    """Adds version and title: Markdown from its front matter, HTML from its head, PDF the title in the column pdf_title; else from
    the first 40 lines. version falls back to "1". Only HTML is read outside the JVM."""
    t, kind = F.col(text), F.col(mime)
    head = F.array_join(F.slice(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", HEAD_LINES + 1), 1, HEAD_LINES), "\n")
    own = fresh("own_head", df.columns)
    read = df.withColumn(own, _head(F.when(kind == "text/html", t)))
    is_front = (kind == "text/markdown") & t.rlike(jvm(FRONTMATTER, "s"))
    block = F.regexp_extract(t, jvm(FRONTMATTER, "s"), 1)
    front = lambda key: F.regexp_replace(_found(block, FRONT_KEY.format(key)), r"^[\"']+|[\"']+$", "")
    version = F.when(is_front, front("version")).when(kind == "text/html", F.col(f"{own}.version"))
    title = F.when(is_front, front("title")).when(kind == "text/html", F.col(f"{own}.title"))
    if pdf_title:
        title = title.when(kind == "application/pdf", F.nullif(strip(F.col(pdf_title)), F.lit("")))
    version = F.coalesce(version, _found(head, VERSION_LINE))
    found = {"version": F.coalesce(F.nullif(version, F.lit("")), F.lit("1")), "title": F.coalesce(title, _found(head, TITLE_LINE))}
    return read.withColumns(found).drop(own)
