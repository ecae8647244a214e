"""Markup residue in text: finding the kinds of markup, inferring wrappers and converting to clean text (problem 2).

Each text becomes a stream of markup tokens and text slots; code blocks are set aside first, as what stands in them is content.
The stream is folded into a union-free regular expression: repeated blocks of any length become repeated groups, everything between
markup a text slot. Streams of the same host (the host of a browser piece, the directory of a file) that are made of the same constructs are
aligned with each other iteratively: what all have stays, what only some have becomes optional, slots match any text. Equal streams
count once, and the others are merged as a tree in an order fixed by their hashes, WAYS at a time, so a host with a third of all rows is
never brought to one task and the wrapper doesn't depend on how the table is split.

A row has the kinds of the constructs in its expression. Constructs that a row alone can't tell from text (a tag of no known name, a quote
sign or number sign that stands without other Markdown) are left open in it, and the wrappers of its host decide: an open tag is HTML if a wrapper with
HTML holds both it and its end, an open sign is Markdown if a wrapper with Markdown holds it. Only the rows with open constructs are joined to what
the wrappers tell. The conversion takes the same decisions; it keeps headings, lists, tables, code blocks and formulas.

Defined results: null, empty and blank content is no case and is returned as it is; file_type is not trusted; rows are judged each;
texts are read whole; a row without path or host belongs to the wrappers of the empty host.
"""

from __future__ import annotations

import html
import html.entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import settle

KINDS = ("html", "markdown", "wiki", "latex")
#: What can hold markup at all; other texts never reach Python.
SUSPECT = r"(?m)</?[A-Za-z!]|[\"']>|&#?\w{2,8};|\*\*|__|~~|`|\][(:]|\]\[[^\]]|\[\^|\[\[|\]\]|\{\{|\{\||^\|[}-]|''|={2,}|^#|^> |(?<!\w)[_*][^\s_*]|^[-*+] \[|---|\\[A-Za-z(\[]|\$|\[https?:"
#: Expressions that one task aligns at a time.
WAYS = 32

TAG_NAMES = "a|abbr|address|article|aside|b|base|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|dd|del|details|dfn|div|dl|dt|em|fieldset|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|mark|meta|nav|noscript|ol|optgroup|option|p|picture|pre|q|s|samp|script|section|select|small|span|strike|strong|style|sub|summary|sup|svg|table|tbody|td|textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video"
ENTITY = "&(?:" + "|".join(sorted({n for n in html.entities.name2codepoint}, key=len, reverse=True)) + r"|apos|#\d{2,7}|#[xX][0-9a-fA-F]{2,6});"
COMMANDS = "documentclass|usepackage|begin|end|part|chapter|(?:sub){0,2}section\\*?|(?:sub)?paragraph|title|author|date|maketitle|tableofcontents|emph|text(?:bf|it|tt|sc|rm|sf)|underline|item|label|(?:eq|page)?ref|cite[tp]?|footnote|caption|includegraphics|input|include|d?frac|sqrt|sum|int|hline|toprule|midrule|bottomrule|centering|url|href|newcommand|bibliography(?:style)?|left|right|alpha|beta|gamma|delta|le|ge|cdot|times|ldots|quad|mathbb|mathbf|mathrm|noindent|vspace|hspace|large|small|newpage|par"

CODE_BLOCK = re.compile(
    r"(?P<fence>^[ \t]*(?:```|~~~)[^\n`]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z))"
    r"|(?P<pre><pre\b[^>]*>.*?(?:</pre\s*>|\Z))|(?P<code><code\b[^>]*>.*?(?:</code\s*>|\Z))"
    r"|(?P<raw><(?P<rawtag>script|style|nowiki|syntaxhighlight|source)\b[^>]*>.*?(?:</(?P=rawtag)\s*>|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim|lstlisting|minted)\}.*?(?:\\end\{(?P=env)\}|\Z))|(?P<inline>(?<![`\\])`[^`\n]+`(?!`))",
    re.S | re.M | re.I,
)
TOKEN = re.compile(
    rf"(?P<html><!--.*?(?:-->|\Z)|<!doctype[^>]*>|(?<![\"'\w])</?(?:{TAG_NAMES})(?:\s[^<>]*)?/?>(?![\"'][,);]|%[sd])|(?<=>)</?(?:{TAG_NAMES})(?:\s[^<>]*)?/?>(?![\"'][,);])|(?<=\w)</?(?:{TAG_NAMES})(?:\s[^<>]*)?/?>(?!\w*[;\])]|[\"'][,);])|{ENTITY}|<(?:{TAG_NAMES})(?:\s[^<>]*)?\Z|\A[^<>\n]*[\w%]\"\s*/?>)"
    rf"|(?P<latex>(?<![\w\\])\\(?:{COMMANDS})(?![A-Za-z])(?=[\s{{\[$_^,.;:)&]|\\(?![A-Za-z])|\Z)|(?<=\w)\\(?:{COMMANDS})(?=\{{)|\\\[(?:(?!\\\[|\n\s*\n).)*?\\\]|\\\((?=\S)(?:(?!\\\(|\n\s*\n).)*?\\\)|(?<![\w$\\])\$(?![\s{{(])[^$\n]*(?:\\[a-zA-Z]|[\^_]\{{?\w)[^$\n]*\$(?!\w))"
    r"|(?P<wiki>^={2,6}[ \t]?[^=\n]+?[ \t]?={2,6}[ \t]*$|\A=?[^=\n]+={2,6}[ \t]*$|\[\[(?=[^\W\d_]|:)[^\[\]\n]+(?:\]\]|\Z)|\A[^\[\]\n]*[^\[\]\s]\]\](?!\])|\{\{(?=[^\W\d_a-z]|[a-z][\w ]*\|)[^{}]+(?:\}\}|\Z)|^\{\|[^\n]*|^\|\}[^\n]*|^\|-(?!-)[^\n|]*$|^!(?=[^\n]*!!)[^\n]*|(?<!')'{2,3}(?=[^\s'])[^'\n]+?(?:'[^'\n]+?)*(?<=[^\s'])'{2,3}(?!')|\[https?://[^\s\]]+ [^\]\n]+\]|^#+[:*]? ?(?=\[\[)|^#: |^\{\{[a-z][a-z -]+\}\}[ \t]*$|__(?:NO)?TOC__)"
    r"|(?P<markdown>^\[[^\]\n]+\]:[ \t]+<?(?:https?:|[./#])\S*|^\[\^\w+\]:[ \t]|(?<=[\w.,;)])\[\^\w+\](?=[\s.,;:]|\Z)|(?<![\w\])])\[[^\]\[\n]+\]\[[^\]\[\n]*\](?![\[(])|^#{2,6}[ \t]+\S[^\n]*|^[^\n|>#=\s][^\n|]*\n(?:={3,}|-{3,})[ \t]*$|^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|!\[[^\]\n]*\]\([^)\n]*\)?|(?<![\w\])])\[[^\]\[\n]+\]\((?=[^)\s]*[/.#])[^)\s]*(?:\)|\Z)|\A[^\[\]\n]*\]\([^)\s]*[/.][^)\s]*\)|(?<![\w*])\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*(?![\w*])|(?<!\w)__(?=[^\s_])(?:[^_\n]+[ \t][^_\n]*|[^_\n]*[^\x00-\x7f][^_\n]*)(?<=[^\s_])__(?!\w)|~~(?=\S)[^~\n]+(?<=\S)~~|^[ \t]*[-*+] \[[ xX]\] \S|^[ \t]*(?:```|~~~)[^\n`]*$|\A[^~\n]+\w~~|\A[^*\n]+\w\*\*(?=[:\s]|\Z)|(?<![\w*])\*\*(?=[^\W\d_])[^*\n]*\Z|~~(?=[^\W\d_])[^~\n]*\Z)"
    r"|(?P<weak>^# [^\n]+|^> \S|(?<![\w_*/\\])_(?=[^\s_])[^_\n]+ [^_\n]+(?<=[^\s_])_(?![\w_])|(?<![\w*/\\\])])\*(?=[^\W\d_])[^*\n]+(?<=[^\s*])\*(?![\w*]))"
    rf"|(?P<tag></?(?!(?:{TAG_NAMES})[\s/>])[a-z][\w:-]*(?:\s[^<>]*)?/?>)",
    re.S | re.M | re.I,
)
KNOWN_TAG = re.compile(f"h</?(?:{TAG_NAMES})")
#: Markup in a quoted string of source code is the string's content.
QUOTED = re.compile(r"([\"'])<[a-zA-Z/][^\"'\n]*>\1")
CODE_LINE = re.compile(
    r"(?m)^\s*(?:def \w+\(|class \w+|import \w|from \w+ import|return\b|func \w|type \w+ struct|package \w|for \w+.*:=|if .*\{\s*$|if .+:(?:\s*$| raise| return)|\w+ := |ch <- |\}\s*$|SELECT\b|INSERT INTO|CREATE TABLE|UPDATE \w|--\s|\"[^\"]+\": |[\w-]+: (?:true|false|\d|\"|\[|\$)|\d{4}-\d\d-\d\dT\d\d:|[^\n;]*;[^\n;]*;[^\n;]*;|\w+ = [\[{(\"'\d])"
)


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, token, start, end) of the markup in `text`; code blocks give their own tokens only."""
    out: list[tuple[str, str, int, int]] = []
    hidden = QUOTED.sub(lambda m: " " * len(m.group(0)), text)
    for m in CODE_BLOCK.finditer(text):
        name = m.lastgroup if m.lastgroup not in ("rawtag", "env") else ("raw" if m.group("raw") else "verb")
        if name == "inline":
            kind = "weak"
        elif name == "fence":
            kind = "markdown"
        elif name == "verb":
            kind = "latex"
        else:
            kind = "wiki" if name == "raw" and m.group("rawtag").lower() == "nowiki" else "html"
        if m.start() and text[m.start() - 1] in "\"'" and kind == "html":
            continue
        out.append((kind, f"{name}-block", m.start(), m.end()))
        hidden = hidden[: m.start()] + re.sub(r"[^\n]", "\x00", hidden[m.start() : m.end()]) + hidden[m.end() :]
    for m in TOKEN.finditer(hidden):
        t = m.group(0)
        if "\x00" in t and m.lastgroup in ("weak", "markdown") and not t.strip("\x00 \n"):
            continue
        out.append((m.lastgroup, t, m.start(), m.end()))
    out.sort(key=lambda x: x[2])
    strong = {k for k, *_ in out} - {"weak", "tag"}
    # A single star, hash, quote mark or backtick is Markdown in a text that is neither code nor another kind of markup.
    if weak := [i for i, x in enumerate(out) if x[0] == "weak"]:
        code = bool(CODE_LINE.search(hidden))
        for i in weak:
            t, start, end = out[i][1:]
            if "markdown" in strong:
                kind = "markdown"
            elif code or strong - {"html"}:
                kind = ""
            elif t.startswith(">"):
                kind = "?markdown"
            elif t.startswith("# "):
                before, after = text[:start].rstrip(" \t"), text[end:]
                apart = t[-1] not in ".!?。！？" and (not before or before.endswith("\n\n")) and (not after.strip() or after.startswith("\n\n"))
                kind = "markdown" if apart else "?markdown"
            else:
                kind = "markdown"
            out[i] = (kind, t, start, end)
    out = [("?html" if x[0] == "tag" else x[0], *x[1:]) for x in out]
    return [x for x in out if x[0]]


def shape(kind: str, token: str) -> str:
    """A markup token without its text: the letter of its kind and its construct; open constructs have the same as settled ones."""
    kind = kind.lstrip("?")
    if kind == "html":
        m = re.match(r"</?[a-zA-Z!][\w:-]*", token)
        return "h" + (m.group(0).lower() if m else "&" if token[0] == "&" else token if token.endswith("-block") else "<>")
    m = re.match(r"\\[A-Za-z]+|[^\w\s]{1,3}", token.lstrip())
    return kind[0] + (token if token.endswith("-block") else m.group(0) if m else "^")


def expression(text: str, found: list[tuple[str, str, int, int]]) -> tuple:
    """The union-free expression of a stream: shapes and "#" slots, tandem repeats folded into ("+", ...) groups."""
    seq: list = []
    at = 0
    for kind, token, start, end in found:
        if text[at:start].strip():
            seq.append("#")
        seq.append(shape(kind, token))
        at = max(at, end)
    if text[at:].strip():
        seq.append("#")
    return fold(tuple(seq))


def fold(seq: tuple) -> tuple:
    """Tandem repeats of blocks of any length become repeated groups, short blocks before long ones, until none is left."""
    longest = 1
    while True:
        new = fold_once(seq, longest)
        if len(new) < len(seq):
            seq = new
        elif 2 * longest >= len(seq):
            return seq
        else:
            longest *= 2


def fold_once(seq: tuple, longest: int) -> tuple:
    """Tandem repeats of blocks of up to `longest` elements as repeated groups."""
    where: dict = {}
    for i, x in enumerate(seq):
        where.setdefault(x, []).append(i)
    if len(where) == len(seq):
        return seq
    rank = dict.fromkeys(where, 0)
    out: list = []
    i = 0
    while i < len(seq):
        x = seq[i]
        same = where[x]
        while same[rank[x]] < i:
            rank[x] += 1
        n = width = 0
        for k in range(rank[x] + 1, len(same)):  # a repeat begins where the element comes again
            width = same[k] - i
            if width > longest or i + 2 * width > len(seq):
                break
            if seq[i : i + width] == seq[i + width : i + 2 * width]:
                n = 2
                while seq[i + n * width : i + (n + 1) * width] == seq[i : i + width]:
                    n += 1
                break
        if n and seq[i : i + width] != ("#",):
            out.append(x if width == 1 and isinstance(x, tuple) and x[0] == "+" else ("+", *seq[i : i + width]))
            i += n * width
        else:
            out.append(x)
            i += 1
    return tuple(out)


def align(a: tuple, b: tuple) -> tuple:
    """The wrapper of two expressions: what only one has becomes optional; text slots match any text."""
    bare = lambda e: tuple(x[1] if isinstance(x, tuple) and x[0] == "?" else x for x in e)
    out: list = []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, bare(a), bare(b), autojunk=False).get_opcodes():
        if op == "equal":
            out += [x if x == y else ("?", x[1] if isinstance(x, tuple) and x[0] == "?" else x) for x, y in zip(a[i1:i2], b[j1:j2])]
        else:
            out += [x if isinstance(x, tuple) and x[0] == "?" else ("?", x) for x in (*a[i1:i2], *b[j1:j2])]
    return fold(tuple(out))


def written(e) -> str:
    """A wrapper as text: groups in parentheses with + or ?, slots as #PCDATA."""
    if isinstance(e, str):
        return "#PCDATA" if e == "#" else e
    if e and e[0] in ("+", "?"):
        return "(" + " ".join(map(written, e[1:])) + ")" + e[0]
    return " ".join(map(written, e))


def flat(e) -> Iterator[str]:
    """The shapes of an expression in order."""
    if isinstance(e, str):
        if e not in ("#", "+", "?"):
            yield e
    else:
        for x in e:
            yield from flat(x)


def stream(text: str | None) -> tuple[tuple, list[str], list[str]]:
    """(expression, kinds, open shapes) of a text."""
    found = tokens(text) if text and text.strip() else []
    open_ = {shape(k, t) for k, t, *_ in found if k[0] == "?"}
    e = expression(text, found) if found else ()
    own = set(flat(e)) - {o for o in open_ if not any(shape(k, t) == o for k, t, *_ in found if k[0] != "?")}
    return e, [k for k in KINDS if any(x[0] == k[0] for x in own)], sorted(open_)


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup that the text's own expression shows."""
    return stream(text)[1]


def told(wrapper: tuple) -> set[str]:
    """The shapes that a wrapper shows to be markup where a row leaves them open."""
    shapes = list(flat(wrapper))
    strong = {x for x in shapes if x[0] == "h" and (KNOWN_TAG.fullmatch(x) or x[1] != "<")}
    out = set()
    if strong:
        first, last = {}, {}
        for i, x in enumerate(shapes):
            first.setdefault(x, i)
            last[x] = i
        for x in first:
            if x.startswith("h<") and not x.startswith("h</") and first[x] < last.get("h</" + x[2:], -1):
                out |= {x, "h</" + x[2:]}
    if any(x[0] == "m" and x not in ("m>", "m#") for x in shapes):
        out |= {x for x in shapes if x in ("m>", "m#")}
    return out


def clean(text: str, decided: list[str] | None = None) -> str:
    """Plain text that keeps headings (#), lists (-), tables (a | b), code blocks (fenced) and formulas ($ or \\[ \\]); `decided` are open shapes that the wrappers settled."""
    kinds = set(kinds_of(text)) | {k for k in KINDS for d in decided or () if d[0] == k[0]}
    names = "|".join(sorted({re.escape(d.lstrip("h</")) for d in decided or () if d.startswith("h<")} | {TAG_NAMES}))
    if not kinds:
        return text
    blocks: list[str] = []

    def keep(body: str) -> str:
        blocks.append(body.strip("\n"))
        return f"\n\x00{len(blocks) - 1}\x00\n"

    def block(m: re.Match) -> str:
        t = m.group(0)
        if m.group("inline"):
            return t[1:-1] if "markdown" in kinds else t
        if m.group("raw") and m.group("rawtag").lower() in ("script", "style"):
            return ""
        if m.group("fence"):
            return keep("\n".join(x for x in t.split("\n") if not re.match(r"\s*(```|~~~)", x)))
        if m.group("verb"):
            return keep(re.sub(r"\\(?:begin|end)\{[^}]*\}", "", t))
        inner = html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", t))
        return keep(inner) if "\n" in inner or m.group("pre") else inner

    t = CODE_BLOCK.sub(block, text)
    if "latex" in kinds:
        t = re.sub(r"\\(?:documentclass|usepackage|label|input|include|bibliography\w*)(?:\[[^\]]*\])?\{[^}]*\}[ \t]*\n?|\\(?:maketitle|tableofcontents|centering|hline|newpage|noindent)\b[ \t]*\n?", "", t)
        t = re.sub(r"\\begin\{(?:equation|align|displaymath)\*?\}(.*?)\\end\{(?:equation|align|displaymath)\*?\}", lambda m: "\\[" + m.group(1).strip() + "\\]", t, flags=re.S)
        t = re.sub(r"\\(part|chapter|(?:sub)*section|paragraph)\*?\{([^}]*)\}", lambda m: "\n" + "#" * (1 + m.group(1).count("sub") + (m.group(1) == "paragraph") * 3) + " " + m.group(2) + "\n", t)
        t = re.sub(r"\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m.group(1) + ": " if m.group(1) else ""), t)
        t = re.sub(r"\\begin\{tabular\}(?:\{[^}]*\})?(.*?)(?:\\end\{tabular\}|\Z)", lambda m: re.sub(r"[ \t]*\\\\[ \t]*", "", re.sub(r"(?<!\\)[ \t]*&[ \t]*", " | ", m.group(1))), t, flags=re.S)
        t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?[ \t]*\n?", "", t)
        for _ in range(3):
            t = re.sub(r"\\(?:emph|text(?:bf|it|tt|sc|rm|sf)|underline|title|author|date|footnote|caption|url|ref|cite)\{([^{}]*)\}", r"\1", t)
    if "wiki" in kinds:
        t = re.sub(r"(?m)^(={2,6})[ \t]*([^=\n]+?)[ \t]*={2,6}[ \t]*$", lambda m: "#" * (len(m.group(1)) - 1) + " " + m.group(2), t)
        t = re.sub(r"\[\[(?:File|Image|Datei|Fichier|Archivo):[^\[\]|]*(?:\|[^\[\]|]*)*?\|?([^\[\]|]*)\]\]", r"\1", t)
        t = re.sub(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Категория|分类):[^\[\]]*\]\][ \t]*", "", t)
        t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", t)
        t = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]+)\]", r"\1", t)
        t = re.sub(r"(?s)\{\{([^{}|]*)((?:\|[^{}]*)?)\}\}", lambda m: m.group(1).strip() + "".join(f"\n{p.strip().replace(' = ', ': ')}" for p in m.group(2).split("|")[1:]), t)
        t = re.sub(r"(?m)^\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[^\n]*\n?", "", t)
        t = re.sub(r"(?m)^[!|][ \t]*(.*)$", lambda m: re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m.group(1)), t)
        t = re.sub(r"'{2,5}", "", t)
        t = re.sub(r"(?m)^[*#]+:? ?", "- ", re.sub(r"(?m)^(#+) (?!\[)(?=\S)", r"\1 ", t)) if re.search(r"(?m)^[*#]+:? ?\[\[", text) else t
    if "markdown" in kinds:
        t = re.sub(r"(?m)^([^\n|]+)\n(=+|-{3,})[ \t]*$", lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1), t)
        t = re.sub(r"(?m)^\[[^\]^\n][^\]\n]*\]:[ \t]+<?(?:https?:|[./#])\S*[^\n]*\n?", "", t)
        t = re.sub(r"!?\[([^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])", r"\1", t)
        t = re.sub(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", t)
        t = re.sub(r"(?<!\w)([_*])(?=[^\s_*])([^_*\n]+?)(?<=\S)\1(?!\w)", r"\2", t)
        t = re.sub(r"(?m)^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", "", t)
        t = re.sub(r"(?m)^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", lambda m: re.sub(r"\s*\|\s*", " | ", m.group(1)), t)
        t = re.sub(r"(?m)^([ \t]*)[-*+] (?:\[[ xX]\] )?", r"\1- ", t)
        t = re.sub(r"(?m)^> ?", "", t)
    if "html" in kinds:
        t = re.sub(r"(?s)<!--.*?(?:-->|\Z)|<!doctype[^>]*>", "", t, flags=re.I)
        t = re.sub(r"(?i)<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m.group(1)) + " ", t)
        t = re.sub(r"(?i)[ \t]*<li\b[^>]*>[ \t]*", "\n- ", t)
        t = re.sub(r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ", t)
        t = re.sub(r"(?i)</?(?:p|div|br|tr|table|ul|ol|section|article|h[1-6]|hr|title|head|body|blockquote|pre)\b[^<>]*>", "\n", t)
        t = re.sub(rf"(?i)</?(?:{names})(?:\s[^<>]*)?/?>|<(?:{names})(?:\s[^<>]*)?\Z", "", t)
        t = html.unescape(t)
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip()
    return re.sub("\x00(\\d+)\x00", lambda m: f"```\n{blocks[int(m.group(1))]}\n```", t)


def suspects(chunks: DataFrame, *more: Column) -> DataFrame:
    return chunks.select(chunks["row_id"], *more, chunks["content"]).where(F.col("content").rlike(SUSPECT))


def host_of(chunks: DataFrame) -> Column:
    """The host of a browser piece, the directory of a file."""
    url = F.regexp_extract(F.coalesce(chunks["content"], F.lit("")), r"https?://([^/\s]+)", 1)
    folder = F.regexp_replace(F.replace(chunks["path"], F.lit("\\"), F.lit("/")), "/[^/]*$", "")
    return F.coalesce(F.when(chunks["source"] != "file", F.nullif(url, F.lit(""))), folder, F.lit(""))


def streams(chunks: DataFrame, with_text: bool = False) -> DataFrame:
    """(row_id, host, class, expression, kinds, open) of the rows with any construct; `class` names the set of constructs. With `clean` and, where anything is open, `content`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], [[] for _ in range(6 if with_text else 4)]
            for i, t in enumerate(b.column(2).to_pylist()):
                e, kinds, open_ = stream(t)
                if not e or not (kinds or open_):
                    continue
                at.append(i)
                values = ["\n".join(sorted(set(flat(e)))), json.dumps(e), kinds, open_]
                if with_text:
                    values += [clean(t) if kinds else None, t if open_ else None]
                for c, v in zip(cols, values):
                    c.append(v)
            part = b.take(pa.array(at, pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(cols, TYPES)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=NAMES[: len(arrays) + 2])

    kind = chunks.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, host string, class string, expression string, kinds array<string>, open array<string>" + (", clean string, content string" if with_text else "")
    return suspects(chunks, host_of(chunks).alias("host")).mapInArrow(run, schema)


NAMES = ["row_id", "host", "class", "expression", "kinds", "open", "clean", "content"]
TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]


def tupled(e):
    return tuple(map(tupled, e)) if isinstance(e, list) else e


def merged(rows: DataFrame) -> DataFrame:
    """(host, class, rows, wrapper): the wrapper of each host's streams of the same constructs."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper: tuple | None = None
        for e in sorted(set(pdf["wrapper"]), key=lambda w: (-len(w), w)):
            wrapper = tupled(json.loads(e)) if wrapper is None else align(wrapper, tupled(json.loads(e)))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "class": [pdf["class"].iloc[0]], "rows": [int(pdf["rows"].sum())], "wrapper": [json.dumps(wrapper)]})

    level = rows.groupBy("host", "class", F.col("expression").alias("wrapper")).agg(F.count(F.lit(1)).alias("rows")).select("host", "class", "rows", "wrapper")
    level = settle(level)
    while True:
        most = level.groupBy("host", "class").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return level
        # The order by hash is that of the texts alone, so the tree is the same at any number of tasks.
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // WAYS)))
        several = F.count(F.lit(1)).over(Window.partitionBy("host", "class")) if most <= WAYS else None
        if several is not None:  # a single expression needs no alignment
            level = level.withColumn("__n", several)
            alone = level.where("__n = 1").drop("__n")
            level = settle(level.where("__n > 1").drop("__n").groupBy("host", "class").applyInPandas(step, level.drop("__n").schema).unionByName(alone))
        else:
            level = settle(level.groupBy("host", "class", salt.alias("salt")).applyInPandas(step, level.schema))


def decisions(rows: DataFrame) -> DataFrame:
    """(row_id, decided array<string>) of the rows with open constructs that the wrappers of their host settle."""

    @F.pandas_udf("array<string>")
    def shown(w: pd.Series) -> pd.Series:
        return w.map(lambda x: sorted(told(tupled(json.loads(x)))))

    open_ = settle(rows.where(F.size("open") > 0).select("row_id", "host", F.explode("open").alias("shape")))
    # Only hosts with open constructs need wrappers.
    near = rows.join(open_.select("host").distinct(), "host", "left_semi")
    tell = merged(near).select("host", F.explode(shown("wrapper")).alias("shape")).distinct()
    return open_.join(tell, ["host", "shape"]).groupBy("row_id").agg(F.sort_array(F.collect_set("shape")).alias("decided"))


def kinds_told(shapes: Column) -> Column:
    return F.transform(shapes, lambda x: F.when(x.startswith("h"), "html").when(x.startswith("m"), "markdown").when(x.startswith("w"), "wiki").otherwise("latex"))


def found_rows(chunks: DataFrame, decide: bool = True) -> DataFrame:
    """Distinct (row_id, markup); `decide=False` leaves out what the wrappers decide."""
    rows = settle(streams(chunks))
    own = rows.select("row_id", F.explode("kinds").alias("markup"))
    if decide:
        own = own.union(decisions(rows).select("row_id", F.explode(kinds_told(F.col("decided")))))
    return own.distinct()


def cleaned(chunks: DataFrame) -> DataFrame:
    """(row_id, markup array<string>, clean) of the rows that hold markup; rows stored twice come out each."""
    rows = settle(streams(chunks, with_text=True))
    both = rows.where(F.size("open") > 0).join(decisions(rows), "row_id")

    @F.pandas_udf("string")
    def again(texts: pd.Series, decided: pd.Series) -> pd.Series:
        return pd.Series([clean(t, list(d)) for t, d in zip(texts, decided)])

    changed = both.select("row_id", F.array_intersect(F.array(*map(F.lit, KINDS)), F.concat("kinds", kinds_told(F.col("decided")))).alias("markup"), again("content", "decided").alias("clean"))
    own = rows.where(F.size("kinds") > 0)
    plain = own.where(F.size("open") == 0).unionByName(own.where(F.size("open") > 0).join(both.select("row_id").distinct(), "row_id", "left_anti"))
    return plain.select("row_id", F.col("kinds").alias("markup"), "clean").unionByName(changed)


def wrappers(chunks: DataFrame) -> DataFrame:
    """(host, rows, wrapper): the union-free expressions of each host's marked-up rows, one for each set of constructs."""

    @F.pandas_udf("string")
    def text(w: pd.Series) -> pd.Series:
        return w.map(lambda x: written(tupled(json.loads(x))))

    return merged(settle(streams(chunks))).select("host", "rows", text("wrapper").alias("wrapper"))
