"""Markup residue: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A text is lexed into markup tokens and text slots. Each token belongs to one dialect and role; the renderer turns the token
stream into plain text in which headings, lists, code blocks, tables and formulas stay recognisable:

    heading   its own line that starts with "■ "         list item  "• ", nested "  • ", tasks "☑ " and "☐ "
    code      lines indented by four spaces               table row  cells joined by " │ "
    formula   ⟦source of the formula⟧                     link       label (address); image: (image: label)

The project's own tags ([Page Number: n], [Image:path] and their kin) pass through untouched. Plain punctuation,
comparisons, prices, paths, plain numbering and notes in brackets are text.

Defined cases: null text has no tokens and stays null; empty text stays empty; texts of any length are lexed whole in
one pass; unclosed tags, fences and environments end with the text; repeated rows are listed once a key; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from textloom.functions.checkpoints import checkpointed
from textloom.functions.once import once

# fixed values: element names that are markup wherever they stand between angle brackets
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em figcaption figure "
    "font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav noscript nowiki ol option p pre q "
    "ref references s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var"
).split()
ENTITIES = {k.rstrip(";") for k in html5 if k.endswith(";")}
OWN_TAG = r"\[(?:Page Number|Slide Number|Sheet|Image|Table Chunk|Table|Figure|Diagram|Data Analysis|chart|textbox|Slide Notes|Empty Slide|Textbox)\b[^\[\]\n]*\]|\[/(?:chart|textbox|Data Analysis)\]|</?Document-Metadata>"

# order matters: the first alternative that fits at a position is the token
TOKENS = [
    ("own", OWN_TAG),
    ("comment", r"<!--.*?(?:-->|\Z)"),
    ("fence", r"^[ \t]*(?:```|~~~)[^\n`]*$"),
    ("environment", r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\[[^\]\n]*\])?"),
    ("display", r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)"),
    ("formula", r"\$(?=[^$\n]*[\\^_=])[^$\s](?:[^$\n]*[^$\s])?\$"),
    ("item", r"\\item\b[ \t]*"),
    ("section", r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|title)\*?\{[^{}\n]*\}"),
    ("reference", r"~?\\(?:cite|citep|citet|ref|eqref|pageref|label)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"),
    ("command", r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{(?:[^{}\n]|\{[^{}\n]*\})*\}"),
    ("tag", r"</?(?:" + "|".join(sorted(ELEMENTS, key=len, reverse=True)) + r")(?:\s[^<>]*)?/?>"),
    ("entity", r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("tableline", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$"),
    ("wikitable", r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*)$"),
    ("template", r"\{\{[^{}]*(?:\}\}|\Z)"),
    ("wikilink", r"\[\[[^\[\]\n]+\]\]"),
    ("extlink", r"\[(?:https?|ftp)://[^\s\]]+ [^\]\n]+\]"),
    ("image", r"!\[[^\[\]\n]*\]\([^()\n]*\)"),
    ("link", r"\[[^\[\]\n]+\]\((?:[^()\s]+)(?: \"[^\"\n]*\")?\)"),
    ("footnote", r"\[\^[^\[\]\s]{1,20}\]:?"),
    ("task", r"^[ \t]*[-*+] \[[ xX]\] "),
    ("hashes", r"^#{1,6}[ \t]+(?=\S)"),
    ("equals", r"^={2,6}[ \t]*[^=\n][^\n]*?[ \t]*={2,6}[ \t]*$"),
    ("underline", r"(?<=[^\n]\n)(?:={3,}|-{3,})[ \t]*$"),
    ("bullet", r"^[ \t]*(?:[*]{1,3}|[#]{2,3}|[:;]{2,3})[ \t]+(?=\S)"),
    ("quotes", r"'{2,5}"),
    ("strong", r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)"),
    ("strike", r"~~(?=\S)[^~\n]+?(?<=\S)~~"),
    ("code", r"`[^`\n]+`"),
]
# every token begins with one of these characters, or at a line's start; the guard spares the alternatives everywhere else
_GUARD = r"(?=[<&\\$\[{!*#=`~_|]|''|^[ \t:;+-])"
_LEXER = re.compile(_GUARD + "(?:" + "|".join(f"(?P<{n}>{p})" for n, p in TOKENS) + ")", re.MULTILINE | re.DOTALL | re.IGNORECASE)
# none of these characters: no token
_MAY = re.compile(r"[<&\\$|{\[`*#='~_]|^-", re.MULTILINE)
_PIPE_ROW = re.compile(r"^[ \t]*\|?[^|\n]+(?:\|[^|\n]*)+$")


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each markup token, in order. An entity counts if its name is known, a heading line of
    equals signs if both sides agree, quotes if they close on the line."""
    if not _MAY.search(text):
        return
    quoted = -1
    for m in _LEXER.finditer(text):
        kind = m.lastgroup
        if kind == "own":
            continue
        if kind == "entity":
            name = m[0][1:-1]
            if name[0] != "#" and name not in ENTITIES:
                continue
        elif kind == "equals":
            line = m[0].strip()
            left, right = len(line) - len(line.lstrip("=")), len(line) - len(line.rstrip("="))
            if left != right or not line.strip("= \t"):
                continue
        elif kind == "quotes" and m.start() != quoted:
            end = text.find("\n", m.end())
            close = text.find(m[0], m.end(), end if end >= 0 else len(text))
            if close < 0 or close == m.end():
                continue
            quoted = close
        yield kind, m.start(), m.end()


def has_markup(text: str | None) -> bool:
    return text is not None and next(tokens(text), None) is not None


_LETTER = re.compile(r"^\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(.*)\}$", re.DOTALL)
_BLOCK_TAGS = {"p", "div", "br", "tr", "table", "ul", "ol", "blockquote", "section", "article", "header", "footer", "hr", "html", "body", "head", "dl", "dd", "dt"}
_MATH = {"equation", "equation*", "align", "align*", "gather", "displaymath", "eqnarray", "math"}


def _template(source: str) -> str:
    """{{Name|key = value|...}}: one line a field; a citation is a note."""
    parts = [p.strip() for p in source.strip("{}").split("|")]
    if len(parts) <= 2 and "\n" not in source:
        return f"({' '.join(parts)})" if len(parts) > 1 else f"({parts[0]})"
    return "\n".join([parts[0], *(" │ ".join(x.strip() for x in p.split("=", 1)) for p in parts[1:])])


def clean_text(text: str | None) -> str | None:
    """The text without markup, its structure kept."""
    if text is None:
        return None
    out: list[str] = []
    at, fenced, verbatim, math, hidden, depth, wiki = 0, "", False, False, "", 0, False  # fenced: what ends the code block

    def plain(s: str) -> str:
        if fenced or verbatim:
            return re.sub(r"^(?=[^\n])", "    ", s, flags=re.MULTILINE) if not out or out[-1].endswith("\n") else s.replace("\n", "\n    ")
        if math or "|" not in s:
            return s
        lines = []
        for line in s.split("\n"):
            cell = line.strip()
            if wiki and cell[:1] in "|!" and cell:
                line = " │ ".join(c.strip() for c in re.split(r"\|\||!!", cell.lstrip("|!")))
            elif table_near and _PIPE_ROW.match(line):
                line = " │ ".join(c.strip() for c in cell.strip("|").split("|"))
            lines.append(line)
        return "\n".join(lines)

    table_near = any(k == "tableline" for k, _, _ in tokens(text)) if "|" in text else False
    for kind, start, end in tokens(text):
        if start < at:
            continue
        between, token = text[at:start], text[start:end]
        if fenced and not (kind == fenced and (kind == "fence" or "\\end" in text[start:end])):
            continue
        if verbatim and not (kind in ("tag", "entity") and (kind == "entity" or token.lower().strip("</> ") in ("pre", "code"))):
            continue
        if math and kind not in ("environment", "reference"):
            continue
        if not hidden:
            out.append(plain(between))
        at = end
        if kind == "tag":
            closing = token.startswith("</")
            name = re.match(r"</?([A-Za-z0-9]+)", token)[1].lower()
            if name in ("script", "style"):
                hidden = "" if closing else name
            elif name in ("pre",):
                verbatim = not closing
                out.append("\n")
                if verbatim:
                    out.append("    ")
            elif re.fullmatch("h[1-6]", name):
                out.append("\n" if closing else "\n■ ")
            elif name == "li":
                out.append("" if closing else "\n" + "  " * max(0, depth - 1) + "• ")
            elif name in ("ul", "ol"):
                depth = max(0, depth + (-1 if closing else 1))
                out.append("\n" if closing else "")
            elif name in ("td", "th"):
                out.append(" │ " if closing else "")
            elif name == "img":
                m = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", token)
                out.append(f"(image: {(m[1] or m[2] or '').strip()})" if m else "(image)")
            elif name == "ref":
                out.append(")" if closing else "" if token.endswith("/>") else " (")
            elif name in _BLOCK_TAGS:
                out.append("\n")
        elif kind == "entity":
            out.append(html.unescape(token).replace("\xa0", " "))
        elif kind == "fence":
            fenced = "" if fenced else "fence"
        elif kind == "environment":
            name = re.search(r"\{([A-Za-z*]+)\}", token)[1]
            begin = token.startswith("\\begin")
            if name in _MATH:
                math = begin
                out.append("⟦" if begin else "⟧")
            elif name in ("verbatim", "lstlisting"):
                fenced = "environment" if begin else ""
            else:
                depth = max(0, depth + (1 if begin else -1)) if name in ("itemize", "enumerate", "description") else depth
        elif kind in ("display", "formula"):
            out.append("⟦" + re.sub(r"^(?:\$\$?|\\\[|\\\()|(?:\$\$?|\\\]|\\\))$", "", token).strip() + "⟧")
        elif kind == "item":
            out.append("  " * max(0, depth - 1) + "• ")
        elif kind == "section":
            out.append("■ " + _LETTER.match(token)[1] + "\n")
        elif kind == "reference":
            inner = re.search(r"\{([^{}]*)\}", token)[1]
            out.append("" if "\\label" in token else f" ({inner})")
        elif kind == "command":
            inner = _LETTER.match(token)[1]
            out.append(f" ({inner})" if token.startswith("\\footnote") else inner)
        elif kind == "wikitable":
            wiki = not token.strip().startswith("|}")
        elif kind == "template":
            out.append(_template(token))
        elif kind == "wikilink":
            inner = token[2:-2]
            first, _, label = inner.partition("|")
            if first.lower().startswith(("file:", "image:")):
                out.append(f"(image: {inner.rsplit('|', 1)[-1]})")
            elif not first.lower().startswith("category:"):
                out.append(label or first)
        elif kind == "extlink":
            address, _, label = token[1:-1].partition(" ")
            out.append(f"{label} ({address})")
        elif kind == "image":
            out.append(f"(image: {token[2 : token.index(']')]})")
        elif kind == "link":
            label, _, address = token[1:-1].partition("](")
            out.append(f"{label} ({address.split(' ')[0]})")
        elif kind == "footnote":
            number = token.strip("[]^:")
            out.append(f"({number})" if token.endswith(":") else f" ({number})")
        elif kind == "task":
            out.append("☑ " if "[x]" in token.lower() else "☐ ")
        elif kind == "hashes":
            out.append("■ ")
        elif kind == "equals":
            out.append("■ " + token.strip("= \t"))
        elif kind == "underline":
            last = out.pop() if out else ""
            head, _, line = last.rstrip("\n").rpartition("\n")
            out.append((head + "\n" if head else "") + "■ " + line)
        elif kind == "bullet":
            out.append("  " * (len(token.strip()) - 1) + "• ")
        elif kind in ("strong", "strike"):
            out.append(token[2:-2])
        elif kind == "code":
            out.append(token[1:-1])
    if not hidden:
        out.append(plain(text[at:]))
    joined = re.sub(r"[ \t]+$", "", "".join(out), flags=re.MULTILINE)
    joined = re.sub(r" │ *$", "", joined, flags=re.MULTILINE)
    return re.sub(r"\n{3,}", "\n\n", joined).strip("\n") if joined != text else text


@F.pandas_udf(IntegerType())
def _count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([0 if t is None else sum(1 for _ in tokens(t)) for t in texts], dtype="int32")


@F.pandas_udf(StringType())
def _clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([clean_text(t) for t in texts], dtype=object)


def markup_tokens(text: Column) -> Column:
    """Number of markup tokens of a text."""
    return _count(text)


def cleaned(text: Column) -> Column:
    return _clean(text)


def items(converted: DataFrame, elements: DataFrame) -> DataFrame:
    """(item_table, item_id, host, text) of everything that can hold markup. The host is where a text comes from: the profile
    of a converted record, the kind of a document's element."""
    a = converted.select(F.lit("rtf_converted_data").alias("item_table"), F.col("convert_id").alias("item_id"), F.concat(F.lit("converted/"), F.coalesce("profile", F.lit(""))).alias("host"), F.col("content").alias("text"))
    b = elements.filter(F.col("element_type") == "text").select(F.lit("docx_elements").alias("item_table"), F.col("element_id").alias("item_id"), F.lit("elements/text").alias("host"), F.col("content").alias("text"))
    return a.unionByName(b).filter(F.col("text").isNotNull())


def with_markup(converted: DataFrame, elements: DataFrame) -> DataFrame:
    """(item_table, item_id) of every item that holds markup, each once: the neutral token streams of its blocks are aligned with
    those of its host, and an item is one with a block that fills a place of its wrapper that is markup (`wrappers.assigned`).
    The grammar above reads wrappers only; no text is lexed."""
    from textloom.llm.wrappers import infer_wrappers, with_streams

    streams = checkpointed(with_streams(items(converted, elements)))
    wrappers = infer_wrappers(streams).filter("is_markup").select("host", "stream")
    return streams.join(wrappers, ["host", "stream"], "left_semi").select("item_table", "item_id").distinct()


def clean_items(converted: DataFrame, elements: DataFrame) -> DataFrame:
    """(item_table, item_id, text) of every item, as clean text."""
    single = once(converted.select("convert_id", "content", "profile"), ["convert_id"]), once(elements.select("element_id", "element_type", "content"), ["element_id"])
    return items(*single).select("item_table", "item_id", _clean("text").alias("text"))
