"""Search strings: rewriting plain input and parsing the full-text grammar into a tree.

Plain input becomes prefix terms joined by AND; input with grammar signs is taken as it is. The grammar has terms, prefixes,
quoted phrases, "+" between phrases, "^" for the first position, column filters, NEAR groups and AND, OR, NOT with parentheses;
adjacent expressions are joined by AND, which binds tighter than NOT, then AND, then OR.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from corpusmill.functions import text as T

COLUMNS = ("title", "content")
NEAR_GAP = 10
_FOLD = dict(zip(T.FOLD_FROM, T.FOLD_TO))


class QuerySyntaxError(ValueError):
    """The search string is not a valid expression."""


@dataclass(frozen=True)
class Phrase:
    """Adjacent terms; the last may be a prefix; `first` demands position 0."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Near:
    """Phrases within `gap` terms of each other in one column."""

    phrases: tuple[Phrase, ...]
    gap: int = NEAR_GAP


@dataclass(frozen=True)
class Node:
    """An operator over expressions: "and", "or" or "not" (left without right)."""

    op: str
    parts: tuple = field(default=())


def fold_term(word: str) -> str:
    return "".join(_FOLD.get(c, c) for c in word.lower() if not 0x300 <= ord(c) <= 0x36F)


def split_terms(word: str) -> tuple[str, ...]:
    """Terms of a text as the index cuts them."""
    out, run = [], ""
    for c in fold_term(word):
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out.append(run)
            run = ""
    return tuple([*out, run] if run else out)


def is_advanced(query: str) -> bool:
    up = query.upper()
    return any(c in query for c in '"*()') or any(f" {w} " in up for w in ("AND", "OR", "NOT")) or "NEAR" in up


def rewrite(query: str) -> str:
    """The match expression of a search string; empty if nothing can be searched for."""
    query = query.strip()
    if not query or is_advanced(query):
        return query
    words, run = [], ""
    for c in query + " ":
        if c == "_" or ord(c) > 127 or unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            words.append(run)
            run = ""
    return " AND ".join(f"{w}*" if w.isascii() else '"' + w.replace('"', '""') + '"' for w in words)


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()*+^,:{}-])|([\w\u0080-\U0010ffff\x1a]+))')


class _Parser:
    def __init__(self, query: str):
        self.tokens: list[tuple[str, str]] = []
        at, query = 0, query.rstrip()
        while at < len(query):
            m = _TOKEN.match(query, at)
            if not m:
                raise QuerySyntaxError(f"unexpected {query[at:].strip()[:1]!r}")
            kind = "string" if m.group(1) else "sign" if m.group(2) else "word"
            self.tokens.append((kind, m.group(1) or m.group(2) or m.group(3)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if value is not None and t[1] != value or t[0] == "end":
            raise QuerySyntaxError(f"expected {value or 'an expression'} near {t[1]!r}")
        self.at += 1
        return t

    def is_word(self, word: str) -> bool:
        return self.peek() == ("word", word)

    def chain(self, word: str, op: str, inner):
        parts = [inner()]
        while self.is_word(word):
            self.take()
            parts.append(inner())
        if len(parts) == 1:
            return parts[0]
        if op != "not":
            return Node(op, tuple(parts))
        out = parts[0]
        for p in parts[1:]:
            out = Node("not", (out, p))
        return out

    def expression(self):
        return self.chain("OR", "or", lambda: self.chain("AND", "and", lambda: self.chain("NOT", "not", self.implicit)))

    def implicit(self):
        parts = [self.unit()]
        while self.peek()[0] in ("string", "word") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek()[1] in ("(", "^", "{", "-") and self.peek()[0] == "sign":
            parts.append(self.unit())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def columns(self) -> tuple[str, ...] | None:
        """The columns of a filter that starts here."""
        start, without = self.at, False
        if self.peek() == ("sign", "-"):
            without = True
            self.at += 1
        names: list[str] = []
        if self.peek() == ("sign", "{"):
            self.at += 1
            while self.peek()[0] in ("word", "string"):
                names.append(self.take()[1].strip('"').lower())
            self.take("}")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("sign", ":"):
            names.append(self.take()[1].strip('"').lower())
        if not names or self.peek() != ("sign", ":"):
            if without or names:
                raise QuerySyntaxError("a column filter needs a colon")
            self.at = start
            return None
        self.take(":")
        for n in names:
            if n not in COLUMNS:
                raise QuerySyntaxError(f"no such column: {n}")
        return tuple(c for c in COLUMNS if (c in names) != without)

    def unit(self):
        kept = self.columns()
        if kept is not None:
            return restrict(self.unit(), kept)
        if self.peek() == ("sign", "("):
            self.take()
            e = self.expression()
            self.take(")")
            return e
        if self.is_word("NEAR") and self.peek(1) == ("sign", "("):
            return self.near()
        return self.phrase()

    def near(self) -> Near:
        self.take()
        self.take("(")
        phrases, gap = [], NEAR_GAP
        while self.peek()[0] in ("string", "word") or self.peek()[1] == "^":
            phrases.append(self.phrase())
        if self.peek() == ("sign", ","):
            self.take()
            n = self.take()[1]
            if not n.isdigit():
                raise QuerySyntaxError("NEAR needs a number")
            gap = int(n)
        self.take(")")
        if not phrases:
            raise QuerySyntaxError("NEAR needs phrases")
        return Near(tuple(phrases), gap)

    def phrase(self) -> Phrase:
        first = False
        if self.peek() == ("sign", "^"):
            self.take()
            first = True
        terms, prefix = [], False
        while True:
            kind, value = self.peek()
            if kind not in ("string", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QuerySyntaxError(f"expected a term near {value!r}")
            self.take()
            terms += split_terms(value[1:-1].replace('""', '"') if kind == "string" else value)
            prefix = False
            if self.peek() == ("sign", "*"):
                self.take()
                prefix = True
            if self.peek() != ("sign", "+"):
                break
            self.take()
        return Phrase(tuple(terms), prefix, first)


def restrict(node, columns: tuple[str, ...]):
    """The expression within some columns only."""
    if isinstance(node, Phrase):
        return Phrase(node.terms, node.prefix, node.first, tuple(c for c in node.columns if c in columns))
    if isinstance(node, Near):
        return Near(tuple(restrict(p, columns) for p in node.phrases), node.gap)
    return Node(node.op, tuple(restrict(p, columns) for p in node.parts))


def parse(match: str):
    """The tree of a match expression; None if it is empty."""
    if not match.strip():
        return None
    p = _Parser(match)
    tree = p.expression()
    if p.peek()[0] != "end":
        raise QuerySyntaxError(f"unexpected {p.peek()[1]!r}")
    return tree


def cjk_query(query: str) -> list[str]:
    """Grams of the ideographs of a search string; all must occur."""
    out: list[str] = []
    for run in re.findall("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+", query):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return list(dict.fromkeys(out))
