"""Markup residue in text documents (problem 6): detection, consensus host paths and conversion to clean text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweir.session import materialize

#: Element names of HTML and of tags in wiki text.
TAGS = (
    "a abbr address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em fieldset figcaption figure font footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math meta nav nobr noscript nowiki ol optgroup option p param picture pre q ref "
    "s samp script section select small span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead title tr tt u ul var video gallery references includeonly onlyinclude"
)
#: Names of special methods, which are no emphasis.
DUNDERS = (
    "init new del repr str bytes format lt le eq ne gt ge hash bool getattr getattribute setattr delattr dir get set delete slots call len getitem setitem delitem missing iter next reversed contains add sub mul matmul "
    "truediv floordiv mod divmod pow lshift rshift and xor or radd iadd neg pos abs invert complex int float index round trunc floor ceil enter exit await aiter anext aenter aexit name main file doc all dict class "
    "module qualname version author annotations future import path package spec loader builtins debug post_init init_subclass copy deepcopy reduce getstate setstate sizeof"
)
_NAMES = "|".join(sorted(TAGS.split(), key=len, reverse=True))
_TAG = rf"(?:{_NAMES}|{_NAMES.upper()})"
_ATTR = r"(?:\s+[\w:.@-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*"
_DUNDER = "|".join(DUNDERS.split())
#: LaTeX commands that occur without an argument.
_BARE = "item|noindent|centering|maketitle|newpage|newline|linebreak|hline|bigskip|medskip|smallskip|par|indent|tableofcontents|alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|theta|omega|phi|leq|geq|neq|le|ge|times|cdot|infty|sum|prod|int|partial|nabla|ldots|dots|quad|qquad|left|right|rightarrow|leftarrow|Rightarrow|approx|pm|in|forall|exists|sqrt|frac|LaTeX|TeX"
_ENTITY_BARE = "nbsp|amp|lt|gt|quot|apos|mdash|ndash|hellip|shy|copy|reg|times|middot|laquo|raquo|[aouAOU]uml|szlig|[aeiouAEIOU]acute|[aeEA]grave|ccedil|ntilde"
#: One alternative for each kind of piece; the names tell the family.
PIECES = re.compile(
    "|".join(
        (
            rf"(?P<html><(?:/{_TAG}\s*|{_TAG}{_ATTR}\s*/?)>|<(?:!--|!DOCTYPE\b|!\[CDATA\[)|-->|<{_TAG}(?:\s+[\w:-]*(?:=[^<>\n]*)?)?$|</[A-Za-z]*$|\b(?:class|id|style|href|src|align|width)\s*=\s*(?:\"[^\"\n<>]*\"|'[^'\n<>]*')\s*/?>)",
            rf"(?P<entity>&\#\d{{1,7}};?|&\#[xX][0-9a-fA-F]{{1,6}};?|&(?P<named>[A-Za-z][A-Za-z0-9]{{1,30}};)|&(?:{_ENTITY_BARE})(?![A-Za-z=;]))",
            rf"(?P<wiki>\[\[(?=[\w:#/])|\{{\{{(?=[\w#:!])|^\{{\||^\|\}}|^\|-|(?<![\w'])'{{2,5}}(?=[^\s'])[^'\n]*(?:'[^'\n]+)*'{{2,5}}|^={{2,6}}[^=\n].*?[^=\n]={{2,6}}[ \t]*$|\#REDIRECT\b|__[A-Z]{{3,}}__|\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]+)?\]|~{{3,5}}|^[:;*\#]{{2,}}[ ])",
            r"(?P<bbcode>(?<!\w)\[(?:b|i|u|s|url|img|quote|code|color|size|list|center|spoiler)(?:=[^\]\n]*)?\]|\[/(?:b|i|u|s|url|img|quote|code|color|size|list|center|spoiler)\])",
            r"(?P<markdown>^[ ]{0,3}\#{1,6}[ \t]+\S|^[ ]{0,3}(?:=+|-{2,})[ \t]*$(?<=(?:==|--))|^[ ]{0,3}(?:\*[ \t]*){3,}$|^[ ]{0,3}(?:_[ \t]*){3,}$|(?:(?<=^)|(?<=[\s(\"'>]))\*\*(?=[^\W\d])|(?<![\w*])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*|(?<![\w*/.\\])\*(?=[\w\"'(])[^*\n]*[^\s*(]\*(?![\w*])"
            rf"|(?<![\w])__(?!(?:{_DUNDER})__)(?=[^\s_])[^\n]*?[^\s_]__(?!\w)|(?<![\w/\\.])_(?=[^\s_])[^_\n]+[^\s_]_(?![\w/.])|~~(?=[^\s~])[^~\n]+~~|`[^`\n]+`|```|!?\[[^\]\n]*\]\([^)\s]*|(?<![\w\]])\[[^\]\n]+\]\[[^\]\n]*\]|\[\^[\w-]+\]|<(?:https?|ftp|mailto):[^>\s]+>|^\[[^\]\n]+\]:[ \t]+\S"
            r"|^[ ]{0,3}(?:[-*+]|\d+[.)])[ \t]+\[[ xX]\][ \t]|^[ ]{0,3}[*+][ \t]+\S|^[ ]{0,3}>[ \t]?\S|^[ ]{0,3}\|.*\|[ \t]*$|^[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)",
            rf"(?P<latex>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|(?<![\w:\\])\\(?:{_BARE})(?![A-Za-z\\])|\\[\[\]()](?=[\s\S])|(?<=\w)\\[%&\#$]|(?<=\w)\\\\(?=\s|$)|\$\$[^$]+\$\$|\$(?=[^\s$\d])[^$\n]*?[^\s$]\$(?![\w])|[A-Za-z]{{2,}}\.~\d|~\\[a-z]+)",
        )
    ),
    re.MULTILINE,
)
#: Java expression for texts that may hold a piece at all; all others are passed over in the JVM.
SUSPECT = r"[<&*`\[{\\$~#|]|__|''|-->|(?:^|\n) {0,3}(?:=|>|-{2,}[ \t]*(?:\n|$)|[+:;_])|(?:^|[^\w/\\.])_[^\s_]|(?:class|id|style|href|src|align|width)[\s\p{Z}]*="
_SAMPLE = re.compile(r"^(?: {4}|\t).*$", re.MULTILINE)
FAMILIES = ("html", "entity", "wiki", "bbcode", "markdown", "latex")


def pieces(text: str) -> dict[str, int]:
    """Number of markup pieces per family; lines indented by four or more spaces are samples and not looked at."""
    found = dict.fromkeys(FAMILIES, 0)
    for m in PIECES.finditer(_SAMPLE.sub("", text)):
        family = m.lastgroup if m.lastgroup != "named" else "entity"
        if m["named"] and m["named"] not in html5:
            continue
        found[family] += 1
    return {k: n for k, n in found.items() if n}


_CONTAINERS = frozenset("div p section article main td th li ul ol nav header footer aside table blockquote body form pre center".split())
_VOID = frozenset("br hr img input meta link col param".split())
_CHROME = frozenset("nav footer aside form".split())
_BLOCKS = frozenset("p div section article main ul ol table tr blockquote header footer aside nav pre dl dd dt figure form center h1 h2 h3 h4 h5 h6 hr title body".split())


def path_step(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """Generalised step of a path: the tag and its class, numbers as '#'."""
    cls = next((v for k, v in attrs if k == "class" and v), "")
    return tag + ("." + ".".join(sorted(re.sub(r"\d+", "#", cls.lower()).split())) if cls else "")


class _Page(HTMLParser):
    """Text of a page by container; with ``losing`` paths, what they hold is left out."""

    def __init__(self, losing: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.losing, self.stack, self.scores, self.out = losing, [], {}, []
        self.links = self.pre = self.hidden = 0
        self.lists: list[str] = []
        self.skipped: list[str] = []

    def path(self) -> str:
        return "/".join(s for s, t in self.stack if t in _CONTAINERS) or "(text)"

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag in ("br", "hr"):
                self.out.append("\n")
            elif tag == "img":
                self.out.append(dict(attrs).get("alt") or "")
            return
        if tag in ("p", "li", "tr", "td", "th") and self.stack and self.stack[-1][1] == tag:
            self.handle_endtag(tag)
        self.stack.append((path_step(tag, attrs), tag))
        if tag in ("script", "style", "template") or self.path() in self.losing:
            self.hidden += 1
            self.skipped.append(tag)
            self.stack[-1] = (self.stack[-1][0], tag + "!")
            return
        self.links += tag == "a"
        self.pre += tag == "pre"
        if tag in _BLOCKS:
            self.out.append("\n\n" if tag[0] == "h" and tag[1:].isdigit() else "\n")
        if tag in ("ul", "ol"):
            self.lists.append(tag)
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("td", "th") and self.out and not self.out[-1].endswith("\n"):
            self.out.append("  ")

    def handle_endtag(self, tag):
        names = [t.rstrip("!") for _, t in self.stack]
        if tag not in names:
            return
        while self.stack:
            _, name = self.stack.pop()
            if name.endswith("!"):
                self.hidden -= 1
            else:
                self.links -= name == "a"
                self.pre -= name == "pre"
                if name in ("ul", "ol") and self.lists:
                    self.lists.pop()
                if name in _BLOCKS:
                    self.out.append("\n\n" if name[0] == "h" and name[1:].isdigit() else "\n")
            if name.rstrip("!") == tag:
                return

    def handle_data(self, data):
        if self.hidden:
            return
        words = len(data.split())
        chrome = any(t in _CHROME for _, t in self.stack)
        path = self.path()
        if path != "(text)":
            self.scores[path] = self.scores.get(path, 0) + (-2 * words if self.links or chrome else words)
        if self.pre:
            data = "".join("    " + line + "\n" for line in data.strip("\n").split("\n"))
        self.out.append(data)


def container_scores(text: str) -> dict[str, int]:
    """Score of each container path of a text: its words, less twice those in links and page furniture."""
    page = _Page()
    page.feed(text)
    page.close()
    return page.scores


#: Symbols of LaTeX commands.
_SYMBOLS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "theta": "θ", "omega": "ω", "phi": "φ", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "times": "×", "cdot": "·", "infty": "∞", "sum": "Σ", "prod": "Π", "int": "∫", "pm": "±", "in": "∈", "approx": "≈", "ldots": "...", "dots": "...", "rightarrow": "→", "leftarrow": "←"}


def _formula(f: str) -> str:
    for _ in range(3):
        f = re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", f)
        f = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", f)
    f = re.sub(r"\\([A-Za-z]+) ?", lambda m: _SYMBOLS.get(m[1], m[1] + " "), f)
    f = re.sub(r"([_^])\{([^{}]*)\}", lambda m: m[1] + (m[2] if len(m[2]) == 1 else f"({m[2]})"), f)
    return re.sub(r"[{}]", "", f.replace("\\", "")).strip()


def clean(text: str, losing: frozenset[str] = frozenset()) -> str:
    """Plain text of marked-up text: headings on their own lines, lists with dashes, code lines indented, formulas kept.

    Sample lines (indented by four spaces) stay as they are. ``losing`` are container paths to leave out.
    """
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    t = text.replace("\x00", "")
    t = re.sub(r"^[ ]{0,3}(```|~~~)[^\n]*\n(.*?)(?:^[ ]{0,3}\1[ \t]*$|\Z)", lambda m: "\n" + keep("\n".join("    " + x for x in m[2].rstrip("\n").split("\n"))) + "\n", t, flags=re.MULTILINE | re.DOTALL)
    t = _SAMPLE.sub(lambda m: keep(m[0]), t)
    t = re.sub(r"\\begin\{(?:verbatim|lstlisting)\}\n?(.*?)\\end\{(?:verbatim|lstlisting)\}", lambda m: keep("\n".join("    " + x for x in m[1].rstrip("\n").split("\n"))), t, flags=re.DOTALL)
    t = re.sub(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", lambda m: keep(_formula(m[1] or m[2])), t, flags=re.DOTALL)
    t = re.sub(r"\\\((.+?)\\\)|\$(?=[^\s$\d])([^$\n]*?[^\s$])\$(?!\w)", lambda m: keep(_formula(m[1] or m[2])), t)
    t = re.sub(r"<((?:https?|ftp|mailto):[^>\s]+)>", lambda m: keep(m[1]), t)
    t = re.sub(rf"<(?!(?:/?{_TAG}\b|!))", lambda m: keep("<"), t)  # signs of the prose
    if re.search(rf"</?{_TAG}\b|<!", t):
        t = re.sub(rf"<({_TAG}(?:\s+[\w:-]*(?:=[^<>\n]*)?)?)$", "", t, flags=re.MULTILINE)
        t = re.sub(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<!DOCTYPE[^>]*>", "", t, flags=re.DOTALL)
        page = _Page(losing)
        page.feed(t)
        page.close()
        t = "".join(page.out)
    t = re.sub(r"</[A-Za-z]*$|-->", "", t, flags=re.MULTILINE)
    t = re.sub(r"(?:\s*\b(?:class|id|style|href|src|align|width)\s*=\s*(?:\"[^\"\n<>]*\"|'[^'\n<>]*'))+\s*/?>", " ", t)
    for _ in range(2):
        t = html.unescape(re.sub(rf"&({_ENTITY_BARE})(?![A-Za-z=;])", r"&\1;", t)) if "&" in t else t
    t = re.sub(rf"</?{_TAG}(?:\s[^<>]*)?/?>", "", t) if "<" in t else t  # tags that were written as entities
    t = t.replace("\xa0", " ")
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}\n]*)\}?", lambda m: "\n" + m[1] + "\n", t)
    t = re.sub(r"\\item\b[ ]?", "- ", t)
    t = re.sub(r"^%.*\n?", "", t, flags=re.MULTILINE) if "\\" in t else t
    t = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}\n?|\\(?:noindent|centering|maketitle|newpage|bigskip|medskip|smallskip|label\{[^{}]*\})[ ]?", "", t)
    t = re.sub(r"\\(?:cite|ref|eqref|pageref)\{([^{}\n]*)\}?", r"[\1]", t)
    for _ in range(3):
        t = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}?", r"\1", t)
    t = re.sub(r"(?<=\w)\\([%&#$])", r"\1", t)
    t = re.sub(r"(?<=\w)\\\\(?=\s|$)", "", t)
    t = re.sub(rf"(?<![\w:\\])\\({_BARE})(?![A-Za-z\\])", lambda m: _SYMBOLS.get(m[1], ""), t)
    t = re.sub(r"([A-Za-z]{2,}\.?)~(?=[\d\[])", r"\1 ", t)
    t = re.sub(r"^[ ]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?", "", t, flags=re.MULTILINE)
    t = re.sub(r"^\{\|.*$|^\|\}.*$|^\|-.*$", "", t, flags=re.MULTILINE)
    t = re.sub(r"^[|!] ?(.*\|\|.*|.*)$", lambda m: re.sub(r"\s*\|+\s*", "  ", m[1]).strip(), t, flags=re.MULTILINE)
    t = re.sub(r"\{\{([^{}]*)\}\}", lambda m: re.sub(r"\s*\|\s*", ", ", m[1]), t).replace("{{", "")
    t = re.sub(r"#REDIRECT[ ]*|__[A-Z]{3,}__\n?|~{3,5}", "", t)
    t = re.sub(r"\[\[(?:[^\]\n|]*\|)?([^\]\n]*)\]\]", r"\1", t).replace("[[", "")
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+(?:\s([^\]\n]+))?\]", lambda m: m[1] or "", t)
    t = re.sub(r"(?<![\w'])'{2,5}(?=[^\s'])([^\n]*?)'{2,5}", r"\1", t)
    t = re.sub(r"^={2,6}\s*(.*?)\s*={2,6}[ \t]*$", r"\n\1\n", t, flags=re.MULTILINE)
    t = re.sub(r"^[:;]+[ ]", "", t, flags=re.MULTILINE)
    t = re.sub(r"(?<!\w)\[/?(?:b|i|u|s|url|img|quote|code|color|size|list|center|spoiler)(?:=[^\]\n]*)?\]|\[/(?:b|i|u|s|url|img|quote|code|color|size|list|center|spoiler)\]", "", t)
    t = re.sub(r"^[ ]{0,3}#{1,6}[ \t]+(.*?)[ \t]*#*$", r"\n\1\n", t, flags=re.MULTILINE)
    t = re.sub(r"^(.+)\n[ ]{0,3}(?:={2,}|-{2,})[ \t]*$", r"\1\n", t, flags=re.MULTILINE)
    t = re.sub(r"^[ ]{0,3}(?:={2,}|-{2,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})[ \t]*$", "", t, flags=re.MULTILINE)
    t = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)?", r"\1", t)
    t = re.sub(r"\[([^\]\n]*)\]\([^)\n]*\)?", r"\1", t)
    t = re.sub(r"(?<![\w\]])\[([^\]\n]+)\]\[[^\]\n]*\]", r"\1", t)
    t = re.sub(r"\[\^([\w-]+)\]:?", r"(\1)", t)
    t = re.sub(r"^\[[^\]\n]+\]:[ \t]+\S.*$", "", t, flags=re.MULTILINE)
    t = re.sub(r"^([ ]{0,3}(?:[-*+]|\d+[.)]))[ \t]+\[([ xX])\][ \t]", lambda m: f"{m[1]} {'done' if m[2] in 'xX' else 'open'}: ", t, flags=re.MULTILINE)
    t = re.sub(r"^[ ]{0,3}[*+]+[ \t]+(?=\S)", "- ", t, flags=re.MULTILINE)
    t = re.sub(r"^(?:[ ]{0,3}>[ \t]?)+", "", t, flags=re.MULTILINE)
    t = re.sub(r"`([^`\n]+)`", lambda m: keep(m[1]), t).replace("```", "")
    for _ in range(2):
        t = re.sub(r"(?<![\w*])\*\*(?=[^\s*])([^*\n]*?[^\s*])\*\*", r"\1", t)
        t = re.sub(r"(?<![\w*/.\\])\*(?=[\w\"'(])([^*\n]*?[^\s*(])\*(?![\w*])", r"\1", t)
        t = re.sub(rf"(?<![\w])__(?!(?:{_DUNDER})__)(?=[^\s_])([^\n]*?[^\s_])__(?!\w)", r"\1", t)
        t = re.sub(r"(?<![\w/\\.])_(?=[^\s_])([^_\n]+[^\s_])_(?![\w/.])", r"\1", t)
        t = re.sub(r"~~(?=[^\s~])([^~\n]+)~~", r"\1", t)
    t = re.sub(r"(?:(?<=^)|(?<=[\s(\"'>]))\*\*(?=[^\W\d])", "", t, flags=re.MULTILINE)
    t = re.sub(r"[ \t]+$", "", t, flags=re.MULTILINE)
    t = re.sub(r"\n[ \t]+(?=\n)", "\n", re.sub(r"\n{3,}", "\n\n", t)).strip("\n")
    for _ in range(3):
        t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)
    return t


_MARKED = "src_table string, record_id bigint, host string, text string, families array<string>, pieces int, paths array<struct<path string, score int>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            found = pieces(r.text)
            if found:
                paths = [{"path": p, "score": s} for p, s in container_scores(_SAMPLE.sub("", r.text)).items()] if "html" in found else []
                rows.append((r.src_table, r.record_id, r.host, r.text, sorted(found), sum(found.values()), paths))
        yield pd.DataFrame(rows, columns=["src_table", "record_id", "host", "text", "families", "pieces", "paths"])


def _convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.copy()
        pdf["clean_text"] = [clean(t, frozenset(x) if x is not None else frozenset()) for t, x in zip(pdf["text"], pdf["losing"], strict=True)]
        yield pdf[["src_table", "record_id", "families", "pieces", "clean_text"]]


def records(document_texts: DataFrame, document_responses: DataFrame) -> DataFrame:
    """(src_table, record_id, host, text) of both tables; code and null texts are left out. The host of a response is its
    space and collection, that of a document is not known yet (null)."""
    texts = document_texts.where("doc_id is not null and text is not null and coalesce(extractor_key, '') <> 'code'").select(F.lit("document_texts").alias("src_table"), F.col("doc_id").alias("record_id"), F.lit(None).cast("string").alias("host"), "text")
    responses = document_responses.where("response_id is not null and content is not null").select(
        F.lit("document_responses").alias("src_table"), F.col("response_id").alias("record_id"), F.concat_ws("/", F.coalesce("space_name", F.lit("")), F.coalesce("collection_name", F.lit(""))).alias("host"), F.col("content").alias("text")
    )
    return texts.unionByName(responses)


def clean_records(document_texts: DataFrame, document_responses: DataFrame, document_rows: DataFrame) -> DataFrame:
    """(src_table, record_id, families, pieces, clean_text) of the records that carry markup, each record once.

    A record is marked if it holds a piece of HTML, an entity, Markdown, wiki, BBCode or LaTeX, whole or broken;
    see PIECES. Texts without any sign that could belong to a piece never leave the JVM. For pages with HTML, the
    containers are scored by their words and links, the generalised tag-class paths are voted on by all pages of a host
    (a collection), and text is re-extracted without the paths that lose: those of at least two pages whose scores
    sum up to nothing or less. Of repeated rows one counts; empty texts carry no markup.
    """
    marked = records(document_texts, document_responses).where(F.col("text").rlike(SUSPECT)).mapInPandas(_scan, _MARKED)
    marked = materialize(marked, "marked")
    paged = marked.where("size(paths) > 0").select("src_table", "record_id", "host", F.explode("paths").alias("p"))
    rows = document_rows.where("doc_id is not null").select("doc_id", "collection_id", "recorded_at").join(paged.where("host is null").select(F.col("record_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    home = rows.groupBy("doc_id").agg(F.max_by("collection_id", "recorded_at").alias("home"))
    paged = paged.join(home, (F.col("src_table") == "document_texts") & (F.col("record_id") == home["doc_id"]), "left").select("src_table", "record_id", F.coalesce("host", F.concat(F.lit("collection "), F.col("home").cast("string")), F.lit("?")).alias("host"), "p.path", "p.score")
    votes = paged.groupBy("host", "path").agg(F.sum("score").alias("votes"), F.count_distinct("src_table", "record_id").alias("pages")).where("pages >= 2 and votes <= 0")
    losing = paged.join(votes, ["host", "path"]).groupBy("src_table", "record_id").agg(F.collect_set("path").alias("losing"))
    once = marked.select("src_table", "record_id", "text", "families", "pieces").dropDuplicates(["src_table", "record_id"]).join(losing, ["src_table", "record_id"], "left")
    return once.mapInPandas(_convert, "src_table string, record_id bigint, families array<string>, pieces int, clean_text string")
