"""Extraction of typed blocks from plain text, Markdown, HTML and code, and the canonical document.

A block is (kind, text, offset, length, heading_path, attrs) with byte offsets into the source. Parsers run in Arrow
batches; each is a plain function of one text, registered by extension.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Extractor versions and extensions.
VERSIONS = {"html": 4, "md": 2, "pdf": 2, "txt": 1, "code": 1}
EXTENSIONS = {
    "txt": "txt text log",
    "md": "md markdown mdown mkd",
    "html": "html htm",
    "pdf": "pdf",
    "code": "rs py js ts tsx jsx go java kt c cpp cc h hpp cs rb php swift",
}
BLOCK = "struct<kind:string,text:string,offset:bigint,length:bigint,heading_path:array<string>,attrs:map<string,string>>"


def extractor_for(path: str) -> str | None:
    """Key of the extractor for a path, by its extension."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return next((k for k, names in EXTENSIONS.items() if ext in names.split()), None)


def extractor_column(path: str = "path") -> F.Column:
    """The same as a native expression."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for key, names in EXTENSIONS.items():
        out = F.when(ext.isin(names.split()), key).otherwise(out)
    return out


def _block(kind: str, text: str, source: str, start: int, end: int, path: list[str], attrs: dict | None = None) -> dict:
    return {"kind": kind, "text": text, "offset": len(source[:start].encode()), "length": len(source[start:end].encode()), "heading_path": list(path), "attrs": attrs or {}}


def plaintext_blocks(text: str) -> tuple[str | None, list[dict]]:
    """Paragraphs between lines that are empty but for spaces and tabs."""
    out, start = [], None
    at = 0
    for line in [*text.splitlines(keepends=True), ""]:
        blank = not line.strip(" \t\r\n")
        if blank and start is not None:
            body = text[start:at].rstrip("\r\n")
            out.append(_block("Paragraph", body, text, start, start + len(body), []))
            start = None
        elif not blank and start is None:
            start = at
        at += len(line)
    return None, out


def code_blocks(text: str, language: str = "") -> tuple[str | None, list[dict]]:
    """One code block with its language."""
    return None, [_block("CodeFence", text, text, 0, len(text), [], {"language": language})] if text else []


def pdf_paragraphs(text: str) -> tuple[str | None, list[dict]]:
    """Paragraphs of the text of a PDF: lines without trailing space, grouped by empty ones, joined by empty lines; no text is an error."""
    groups = [g.strip("\n") for g in re.split(r"\n(?:[ \t]*\n)+", "\n".join(x.rstrip() for x in text.replace("\r\n", "\n").split("\n")))]
    out, at = [], 0
    for g in (g for g in groups if g.strip()):
        n = len(g.encode())
        out.append({"kind": "Paragraph", "text": g, "offset": at, "length": n, "heading_path": [], "attrs": {}})
        at += n + 2
    if not out:
        raise ValueError("the PDF has no text")
    return None, out


_OBJECT = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_SHOW = re.compile(rb"(\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^()\\])*\)|[^\]])*\])\s*(TJ|Tj|'|\")|(T\*|\bT[dD]\b|\bTm\b|\bET\b)", re.DOTALL)
_PART = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_text(content: bytes) -> str:
    """Text that the content streams of a PDF show, in their order: plain and deflated streams with single-byte encodings."""
    pages = []
    for head, body in _OBJECT.findall(content):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        out: list[str] = []
        for shown, how, move in _SHOW.findall(body):
            if move or how in (b"'", b'"'):
                out.append("\n")
            for part in _PART.findall(shown):
                if part[:1] in b"(<":
                    out.append(_pdf_string(part))
                elif float(part) < -200:  # a wide step back between shown parts is a space
                    out.append(" ")
        pages.append(re.sub(r"\n{3,}", "\n\n", "".join(out)).strip("\n"))
    return "\n\n".join(p for p in pages if p.strip())


def pdf_blocks(content: bytes) -> tuple[str | None, list[dict]]:
    """Paragraphs of a PDF; with the optional package pypdf also of those with other encodings. No text is an error."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return pdf_paragraphs(pdf_text(content))
    import io

    return pdf_paragraphs("\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages))


_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_TABLE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def markdown_blocks(text: str) -> tuple[str | None, list[dict]]:
    """Headings (ATX and underlined), paragraphs, list items, quotes, fences, tables and HTML blocks; title: the first heading.

    A list item's nested items are blocks of their own and no part of its text; paragraphs inside items and quotes
    belong to these.
    """
    lines, at, places = text.split("\n"), 0, []
    for line in lines:
        places.append(at)
        at += len(line) + 1
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    title = None
    i = 0

    def path() -> list[str]:
        return [t for _, t in stack]

    def add(kind: str, first: int, last: int, body: str, attrs: dict | None = None) -> None:
        if body.strip():
            out.append(_block(kind, body, text, places[first], min(len(text), places[last] + len(lines[last])), path(), attrs))

    def heading(level: int, label: str, first: int, last: int) -> None:
        nonlocal title
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, label))
        title = title or label or None
        add("Heading", first, last, "\n".join(lines[first : last + 1]))

    while i < len(lines):
        line = lines[i]
        fence, atx = _FENCE.match(line), _ATX.match(line)
        if not line.strip() or _RULE.match(line):
            i += 1
        elif fence:
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[j]):
                j += 1
            add("CodeFence", i, min(j, len(lines) - 1), "\n".join(lines[i + 1 : j]), {"language": fence[2]} if fence[2] else {})
            i = j + 1
        elif atx:
            heading(len(atx[1]), (atx[2] or "").strip(), i, i)
            i += 1
        elif re.match(r"^ {0,3}>", line):
            j = i
            while j < len(lines) and lines[j].strip() and (re.match(r"^ {0,3}>", lines[j]) or j > i):
                j += 1
            add("BlockQuote", i, j - 1, "\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:j]))
            i = j
        elif _ITEM.match(line):
            j = i + 1
            while j < len(lines) and lines[j].strip() and not _ITEM.match(lines[j]) and not _ATX.match(lines[j]) and not _FENCE.match(lines[j]):
                j += 1
            add("ListItem", i, j - 1, "\n".join([_ITEM.sub("", line), *[x.strip() for x in lines[i + 1 : j]]]))
            i = j
        elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and _TABLE.match(lines[i + 1]):
            add("TableHeader", i, i, line.strip())
            i += 2
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                add("TableRow", i, i, lines[i].strip())
                i += 1
        elif re.match(r"^ {0,3}<(?:[A-Za-z/!?])", line):
            j = i
            while j < len(lines) and lines[j].strip():
                j += 1
            add("HtmlBlock", i, j - 1, "\n".join(lines[i:j]))
            i = j
        elif re.match(r"^(?: {4}|\t)", line):
            j = i
            while j < len(lines) and (re.match(r"^(?: {4}|\t)", lines[j]) or not lines[j].strip()):
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            add("CodeFence", i, j - 1, "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[i:j]))
            i = j
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not any(p.match(lines[j]) for p in (_ATX, _FENCE, _ITEM)) and not re.match(r"^ {0,3}(?:>|=+[ \t]*$|-+[ \t]*$)", lines[j]):
                j += 1
            under = re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[j]) if j < len(lines) else None
            if under:
                heading(1 if under[1][0] == "=" else 2, " ".join(x.strip() for x in lines[i:j]), i, j)
                i = j + 1
            else:
                add("Paragraph", i, j - 1, "\n".join(x.strip() for x in lines[i:j]))
                i = j
    return title, out


#: Elements left out, and elements that only hold others.
_SKIPPED = frozenset("head script style template noscript svg canvas math".split())
_HOLDERS = frozenset("html body main article section div header footer nav aside ul ol menu dl table thead tbody tfoot tr td th caption figure figcaption".split())
_KINDS = {**{f"h{n}": "Heading" for n in range(1, 7)}, "p": "Paragraph", "li": "ListItem", "dt": "Paragraph", "dd": "Paragraph", "blockquote": "BlockQuote", "pre": "CodeFence"}
_EMPTY = frozenset("br hr img input meta link area base col embed source track wbr param".split())


def _hidden(attrs: dict[str, str | None]) -> bool:
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true":
        return True
    winners: dict[str, tuple[bool, str]] = {}
    for rule in (attrs.get("style") or "").split(";"):
        name, _, value = rule.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("!important")
        value = value.removesuffix("!important").strip()
        if name in ("display", "visibility") and value and (important or not winners.get(name, (False, ""))[0]):
            winners[name] = (important, value)
    return winners.get("display", (0, ""))[1] == "none" or winners.get("visibility", (0, ""))[1] in ("hidden", "collapse")


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.skip = 0
        self.skipping: list[bool] = []
        self.blocks: list[tuple[str, str, list[str]]] = []
        self.text: list[list[str]] = [[]]
        self.kinds: list[str | None] = [None]
        self.title, self.in_title, self.heading = "", False, []

    def _flush(self) -> None:
        raw = "".join(self.text[-1])
        kind = self.kinds[-1]
        body = raw.strip("\r\n").rstrip() if kind == "CodeFence" else re.sub(r"\s+", " ", raw).strip()
        self.text[-1] = []
        if body:
            if kind == "Heading":
                level = int(next(t for t in reversed(self.open) if t in _KINDS and _KINDS[t] == "Heading")[1:])
                self.heading = [h for h in self.heading if h[0] < level] + [(level, body)]
            self.blocks.append((kind or "Paragraph", body, [h for _, h in self.heading]))

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in _EMPTY:
            if tag == "br":
                self.text[-1].append("\n" if "CodeFence" in self.kinds else " ")
            return
        if tag in _KINDS and tag not in ("blockquote",) and self.open and any(t == tag or (t == "p" and tag != "p") for t in self.open[-1:]):
            self.handle_endtag(self.open[-1])
        self.open.append(tag)
        hide = tag in _SKIPPED or _hidden(dict(attrs))
        self.skipping.append(hide)
        self.skip += hide
        if self.skip:
            return
        if tag in _KINDS or tag in _HOLDERS:
            self._flush()
            self.text.append([])
            self.kinds.append(_KINDS.get(tag))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag not in self.open:
            return
        while self.open:
            name, hide = self.open[-1], self.skipping[-1]
            if not self.skip and (name in _KINDS or name in _HOLDERS):
                self._flush()
                self.text.pop()
                self.kinds.pop()
            self.open.pop()
            self.skipping.pop()
            self.skip -= hide
            if name == tag:
                return

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skip:
            self.text[-1].append(data)


def html_blocks(text: str) -> tuple[str | None, list[dict]]:
    """Blocks of headings, paragraphs, items, quotes and preformatted text, and of what is left in containers; hidden elements
    are left out. The title is that of the page alone. Offsets are those of the joined text."""
    page = _Blocks()
    page.feed(text)
    page.close()
    while page.open:
        page.handle_endtag(page.open[-1])
    page._flush()
    out, at = [], 0
    for kind, body, path in page.blocks:
        n = len(body.encode())
        out.append({"kind": kind, "text": body, "offset": at, "length": n, "heading_path": path, "attrs": {}})
        at += n + 2
    return re.sub(r"\s+", " ", page.title).strip() or None, out


EXTRACTORS: dict[str, Callable[[str], tuple[str | None, list[dict]]]] = {"txt": plaintext_blocks, "md": markdown_blocks, "html": html_blocks, "code": code_blocks, "pdf": pdf_paragraphs}


def canonical(blocks: list[dict]) -> tuple[str, list[dict]]:
    """Canonical text and its blocks: texts joined by empty lines with offsets into the result; rows of a table carry its header."""
    out, at, header = [], 0, ""
    for b in blocks:
        text = b["text"]
        if b["kind"] == "TableHeader":
            header = text
        elif b["kind"] == "TableRow":
            text = f"{header}\n{text}" if header.strip() else text
        else:
            header = ""
        n = len(text.encode())
        out.append({**b, "text": text, "offset": at, "length": n})
        at += n + 2
    return "\n\n".join(b["text"] for b in out), out


def extract_documents(files: DataFrame, extractors: dict[str, Callable[[str], tuple[str | None, list[dict]]]] | None = None) -> DataFrame:
    """(doc_id, title, text, blocks, error) of files (doc_id, extractor_key, text, and optionally content and path): canonical documents.

    ``extractors`` add to or replace the registered ones. PDF files are read from ``content`` where there is any, else their ``text`` is
    taken as extracted already; code gets the extension of ``path`` as its language. Null texts without content and unknown extractors give
    none; a file whose extractor fails gives a row with an error and no text. Extra columns are left out.
    """
    known = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    if r.extractor_key == "pdf" and r.content is not None:
                        title, blocks = pdf_blocks(bytes(r.content))
                    elif r.extractor_key == "code" and r.path and "code" not in (extractors or {}):
                        title, blocks = code_blocks(r.text, r.path.rsplit(".", 1)[-1].lower() if "." in r.path.rsplit("/", 1)[-1] else "")
                    else:
                        title, blocks = known[r.extractor_key](r.text)
                    text, blocks = canonical(blocks)
                    rows.append((r.doc_id, title, text, blocks, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.doc_id, None, None, None, str(e)[:500] or type(e).__name__))
            yield pd.DataFrame(rows, columns=["doc_id", "title", "text", "blocks", "error"])

    have = [F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("content", "binary"), ("path", "string"))]
    wanted = files.where((F.col("text").isNotNull() | ((F.col("extractor_key") == "pdf") & have[0].isNotNull())) & F.col("extractor_key").isin(list(known))).select("doc_id", "extractor_key", "text", *have)
    return wanted.mapInPandas(run, f"doc_id bigint, title string, text string, blocks array<{BLOCK}>, error string")
