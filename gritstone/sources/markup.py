"""HTML pages and Markdown texts as block tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page chrome by tag, and by parts of a class, id or role.
CHROME_TAGS = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "svg"}
CHROME_HINTS = ("nav", "menu", "sidebar", "banner", "cookie", "advert", "breadcrumb", "footer", "social", "related", "comment")
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_KINDS = {"p": "paragraph", "li": "list", "pre": "code", "table": "table", "figcaption": "caption", "blockquote": "paragraph"}
_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_KEPT = {"main", "article", "html", "body"}

# The share of the body's text that makes a div the content; inline markup and what stays of it, in order.
DENSE = 0.3
INLINE = (
    (r"!\[([^\]]*)\]\([^)]*\)", ""), (r"\[([^\]]*)\]\(([^)]*)\)", r"\1"), (r"`([^`]*)`", r"\1"),
    (r"(\*\*\*|___)(.+?)\1", r"\2"), (r"(\*\*|__)(.+?)\1", r"\2"), (r"(\*|_)(.+?)\1", r"\2"),
)

BLOCKS = "id long, ord long, kind string, text string, section_path array<string>, level int"
_ARROW = pa.schema([("id", pa.int64()), ("ord", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("section_path", pa.list_(pa.string())), ("level", pa.int32())])


def html_title(html: Column, url: Column) -> Column:
    """The first h1's text; else the title without its site suffix; else the end of the address."""
    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))

    h1 = plain(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "), r"\s*[|-]\s*[^|-]+$", ""))
    return F.coalesce(F.nullif(h1, F.lit("")), F.nullif(title, F.lit("")), F.regexp_extract(url, "([^/]+)/?$", 1))


class _Walker(HTMLParser):
    """Collects text blocks; a block start closes an open paragraph, chrome is left out with all it holds.

    Elements that may hold the content (main, article, role=main, div) are noted in the same pass with the blocks
    between their tags and the characters of their texts, so that ``content`` can choose one at the end.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, int | None]] = []
        self.open: list[tuple[str, bool]] = []
        self.hidden, self.kind, self.level, self.parts = 0, None, None, []
        self.meta: dict[str, str] = {}
        self.headline: dict[str, list[str]] = {}
        self.size, self.roots, self.held, self.body = 0, [], [], None

    def _root(self, tag: str, role: str) -> None:
        kind = tag if tag in ("main", "article") else "role" if role == "main" else "div" if tag == "div" else None
        if tag == "body" and self.body is None:
            self.body = self.size
        if kind:
            self.flush()
            self.roots.append([kind, len(self.out), None, self.size])
        self.held.append(len(self.roots) - 1 if kind else None)

    def _close(self) -> None:
        at = self.held.pop()
        if at is not None:
            self.flush()
            self.roots[at][2], self.roots[at][3] = len(self.out), self.size - self.roots[at][3]

    def content(self) -> list[tuple[str, str, int | None]]:
        """The blocks of the first main, else article, else role=main, else of the div with most text if that is
        over ``DENSE`` of the body's, else all."""
        while self.held:
            self._close()
        for kind in ("main", "article", "role"):
            for k, first, last, _ in self.roots:
                if k == kind:
                    return self.out[first:last]
        divs = [r for r in self.roots if r[0] == "div"]
        best = max(divs, key=lambda r: r[3], default=None)
        if best and best[3] > DENSE * (self.size - (self.body or 0)):
            return self.out[best[1] : best[2]]
        return self.out

    def flush(self) -> None:
        if self.kind:
            text = "".join(self.parts)
            text = text.strip("\n") if self.kind == "code" else re.sub(r"[ \t\r\f\v]+", " ", text) if self.kind == "table" else re.sub(r"\s+", " ", text)
            text = re.sub(r"(?: \| )*\n(?: \| )*", "\n", text).strip(" |\n") if self.kind == "table" else text.strip()
            if re.search(r"\w", text):
                self.out.append((self.kind, text, self.level))
        self.kind, self.level, self.parts = None, None, []

    def handle_starttag(self, tag, attrs):
        named = {k: (v or "") for k, v in attrs}
        if tag in _VOID:
            if tag == "br" and self.kind:
                self.parts.append("\n" if self.kind == "code" else " ")
            if tag == "meta" and named.get("content"):
                if named.get("name") == "description":
                    self.meta.setdefault("description", named["content"].strip())
                if named.get("property", "").startswith("og:"):
                    self.meta["og_" + named["property"][3:]] = named["content"].strip()
            return
        hint = " ".join(named.get(k, "") for k in ("class", "id", "role")).lower()
        chrome = tag in CHROME_TAGS or (tag not in _KEPT and (named.get("role") == "navigation" or any(h in hint for h in CHROME_HINTS)))
        if (tag in _KINDS or tag in _HEADINGS) and self.kind != "table":
            self.flush()
            if tag == "p":  # an open paragraph and the marks in it end here
                while self.open and any(t == "p" for t, _ in self.open[-8:]):
                    t, hid = self.open.pop()
                    self.hidden -= hid
                    self._close()
                    if t == "p":
                        break
            self.kind, self.level = ("heading", _HEADINGS[tag]) if tag in _HEADINGS else (_KINDS[tag], None)
        elif self.kind == "table" and tag == "tr":
            self.parts.append("\n")
        elif self.kind == "table" and tag in ("td", "th"):
            self.parts.append(" | ")
        self.open.append((tag, chrome))
        self.hidden += chrome
        self._root(tag, named.get("role", "") if not self.hidden else "") if not self.hidden else self.held.append(None)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, hid = self.open.pop()
                self.hidden -= hid
                self._close()
                if t == tag:
                    break
            if tag in _KINDS or tag in _HEADINGS:
                self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.size += len(data.strip())
        if self.kind and not self.hidden:
            self.parts.append(data)
        for tag in ("h1", "title"):
            if any(t == tag for t, _ in self.open[-6:]):
                self.headline.setdefault(tag, []).append(data)


def _walked(html: str | None) -> _Walker:
    walker = _Walker()
    walker.feed(html or "")
    walker.close()
    walker.flush()
    return walker


def parse_html(html: str | None) -> list[tuple[str, str, int | None]]:
    """(kind, text, heading level) of the blocks of a page's content, in order."""
    return _walked(html).content()


def html_document(html: str, source: str) -> tuple[str, dict[str, str], list[tuple[str, str, int | None]]]:
    """Title (h1, else title without its site suffix, else the end of the address), metadata (description, og_*), blocks."""
    walker = _walked(html)
    h1, title = (re.sub(r"\s+", " ", " ".join(walker.headline.get(t, []))).strip() for t in ("h1", "title"))
    plain = re.sub(r"\s*[|–\-]\s*[^|–\-]+$", "", title) or title
    tail = re.sub(r"^https?://|[?#].*$", "", source).strip("/").rsplit("/", 1)[-1]
    return h1 or plain or (tail if source.startswith("http") else re.sub(r"\.[^.]*$", "", tail)), walker.meta, walker.content()


def markdown_document(text: str, source: str) -> tuple[str, dict[str, str], list[tuple[str, str, int | None]]]:
    """Title (front matter's, else the first heading of level 1, else the file's name), front matter of single lines, blocks."""
    meta = dict(re.findall(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(\S.*?)[ \t]*$", text.split("\n---", 1)[0])) if text.startswith("---\n") and "\n---" in text[3:] else {}
    blocks = parse_markdown(text)
    name = re.sub(r"\.[^.]*$", "", source.rsplit("/", 1)[-1])
    return meta.get("title", "").strip("\"'") or next((b for k, b, level in blocks if level == 1), name), meta, blocks


def strip_inline(text: str) -> str:
    """Prose without inline markup: images go, links keep their label, code and emphasis their body, nested emphasis from
    the longest marks to the shortest."""
    for pattern, body in INLINE:
        text = re.sub(pattern, body, text)
    return text


_FENCE, _ATX, _LIST = re.compile(r"\s{0,3}(`{3,}|~{3,})(.*)$"), re.compile(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")


def parse_markdown(text: str | None) -> list[tuple[str, str, int | None]]:
    """(kind, text, heading level): fences, ATX and setext headings, tables, lists and paragraphs."""
    lines = (text or "").split("\n")
    if lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        lines = lines[[x.strip() for x in lines].index("---", 1) + 1 :]
    out: list[tuple[str, str, int | None]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            kind = "table" if len(held) > 1 and re.fullmatch(r"[\s|:-]*-[\s|:-]*", held[1]) and "|" in held[0] else "list" if _LIST.match(held[0]) else "paragraph"
            out.append((kind, "\n".join(held) if kind != "paragraph" else " ".join(x.strip() for x in held), None))
            held.clear()

    fence, code = None, []
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not m[2].strip():
                out.append(("code", "\n".join(code), None))
                fence, code = None, []
            else:
                code.append(line)
        elif m:
            flush()
            fence = m[1]
        elif not line.strip():
            flush()
        elif h := _ATX.match(line):
            flush()
            out.append(("heading", h[2], len(h[1])))
        elif held and len(held) == 1 and re.fullmatch(r"\s{0,3}(=+|-{2,})\s*", line) and "|" not in held[0]:
            out.append(("heading", held.pop().strip(), 1 if "=" in line else 2))
        else:
            held.append(line)
    if code:
        out.append(("code", "\n".join(code), None))
    flush()
    plain = [(kind, body if kind == "code" else strip_inline(body), level) for kind, body, level in out]
    return [b for b in plain if b[1].strip()]


def inline_stripped(text: Column) -> Column:
    """``strip_inline`` as a Column expression."""
    for pattern, body in INLINE:
        text = F.regexp_replace(text, pattern, body.replace("\\", "$"))
    return text


def _block_rows(df: DataFrame, parse) -> DataFrame:
    """Blocks of (id, text): a heading pops those of its level and deeper, and isn't in its own path."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _ARROW]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                stack: list[tuple[int, str]] = []
                for k, (kind, body, level) in enumerate(parse(text.as_py())):
                    if level:
                        while stack and stack[-1][0] >= level:
                            stack.pop()
                    for column, value in zip(rows, (key, k, kind, body, [t for _, t in stack], level)):
                        column.append(value)
                    if level:
                        stack.append((level, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)

    return df.mapInArrow(run, BLOCKS)


def html_blocks(pages: DataFrame) -> DataFrame:
    """(id, html) -> BLOCKS."""
    return _block_rows(pages.select(F.col("id").cast("long"), F.col("html").cast("string")), parse_html)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(id, text) -> BLOCKS."""
    return _block_rows(docs.select(F.col("id").cast("long"), F.col("text").cast("string")), parse_markdown)
