"""Text functions as Catalyst expressions; nothing here leaves the JVM.

Character classes are spelled out as code points, so that Java's, RE2's and Unicode's ideas of white space can't differ.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, for a character class.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"\x00-\x1F\x7F-\x{9F}"
#: Ideographs that the gram index covers.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
PREVIEW, SNIPPET_LEAD, INDEXED, TAG = 220, 55, 4096, 4096


def _folding() -> tuple[str, str]:
    """Latin letters with diacritics and their plain letters, from the Unicode data."""
    pairs = []
    for lo, hi in ((0xC0, 0x24F), (0x1E00, 0x1EFF)):
        for o in range(lo, hi + 1):
            base = unicodedata.normalize("NFD", chr(o).lower())
            if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]) and chr(o).lower() == chr(o):
                pairs.append((chr(o), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def lower(c: Column) -> Column:
    """Lower case, one letter at a time: the last sigma of a word is no other letter."""
    return F.lower(F.translate(c, "\u03a3", "\u03c3"))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(c: Column) -> Column:
    """Tags become spaces, other control characters go, white space collapses, ends are trimmed."""
    c = F.regexp_replace(c, "<[^>]+>", " ")
    c = F.regexp_replace(c, r"[\n\r\t]", " ")
    c = F.regexp_replace(c, f"[{CONTROL}]", "")
    return trim_space(F.regexp_replace(c, f"[{SPACE}]+", " "))


def clean_stream(c: Column) -> Column:
    """As `clean`, as a text is read piece by piece: an empty tag is one too, and what is longer than TAG characters is text."""
    c = F.regexp_replace(c, f"<[^>]{{0,{TAG - 1}}}>", " ")
    c = F.regexp_replace(c, r"[\n\r\t]", " ")
    c = F.regexp_replace(c, f"[{CONTROL}]", "")
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def title_case(c: Column) -> Column:
    """The first character as a capital, if it is a letter of ASCII."""
    return F.concat(F.translate(F.substring(c, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(c, F.lit(2), F.length(c)))


def preview(c: Column, limit: int = PREVIEW) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(trim_space(F.substring(c, 1, limit)), F.lit("...")))


def rank_text(c: Column) -> Column:
    """Lower case, words separated by one space."""
    return trim_space(F.regexp_replace(lower(F.coalesce(c, F.lit(""))), f"[{SPACE}]+", " "))


def slashed(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def _stepped(p: Column) -> Column:
    """A slashed path with ".." steps resolved; those above a root or the beginning stay or go as they do in a shell."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        inner = (F.size(done) > 0) & ~last.isin("", "..")
        return F.when((part == "..") & inner, F.slice(done, 1, F.size(done) - 1)).when((part == "..") & (F.size(done) > 0) & (last == ""), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")


def normal_path(c: Column) -> Column:
    """Lower-cased path with slashes; doubled slashes and inner "." and ".." steps fold, a trailing slash goes."""
    p = F.regexp_replace(F.regexp_replace(slashed(F.coalesce(c, F.lit(""))), "/(?:\\./)+", "/"), "(?<=.)/+", "/")
    p = F.when(p.rlike("(?:^|/)\\.\\.(?:/|$)"), _stepped(p)).otherwise(p)
    return lower(F.regexp_replace(p, "(?<=.)/$", ""))


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(slashed(F.coalesce(c, F.lit(""))), "/+$", ""), "([^/]*)$", 1)


def extension(c: Column) -> Column:
    """Lower-case extension of the last path part without its dot; empty if there is none."""
    return lower(F.regexp_extract(base_name(c), r"\.([^.]*)$", 1))


def name_words(c: Column) -> Column:
    return rank_text(F.translate(c, ".-_", "   "))


def path_only_content(title: Column, path: Column) -> Column:
    """What a file known by its name only is found by: title, path, and the path cut at either slash."""
    return F.concat_ws(" ", title, path, F.replace(path, F.lit("\\"), F.lit(" ")), F.replace(path, F.lit("/"), F.lit(" ")))


def fold(c: Column) -> Column:
    """Case and diacritics folded for terms."""
    return F.translate(F.regexp_replace(lower(F.coalesce(c, F.lit(""))), r"[\x{300}-\x{36F}]", ""), FOLD_FROM, FOLD_TO)


def terms(c: Column) -> Column:
    """Terms of a text in order: runs of letters and numbers, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def cjk_grams(c: Column) -> Column:
    """Pairs of adjacent ideographs of each run, the ideograph itself of a run of one; each once, in order."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[{CJK}]+"), F.lit(0))

    def grams(run: Column) -> Column:
        n = F.length(run)
        return F.when(n == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))

    return F.array_distinct(F.flatten(F.transform(runs, grams)))


def gram_text(title: Column, content: Column, preview_: Column) -> Column:
    """The text whose grams are indexed: long contents by their preview."""
    return F.concat_ws(" ", title, F.when(F.length(content) <= INDEXED, content).otherwise(preview_))


def snippet(preview_: Column, query: str, limit: int = PREVIEW, lead: int = SNIPPET_LEAD) -> Column:
    """A window of the preview around the first query word that occurs in it."""
    words = [w.strip('"*()') for w in query.split()]
    text = F.coalesce(preview_, F.lit(""))
    at = F.lit(0)
    for w in reversed([w for w in words if w]):
        here = F.instr(lower(text), w.lower())
        at = F.when(here > 0, here).otherwise(at)
    start = F.greatest(at - 1 - lead, F.lit(0))
    end = F.least(start + limit, F.length(text))
    cut = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), trim_space(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))
    return F.when((at == 0) | (F.length(text) <= limit), preview(text, limit)).otherwise(cut)
