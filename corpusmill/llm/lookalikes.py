"""Visually identical text with different characters: one consistent form (problem 1).

Everything runs in SQL. A pattern takes out of each value the words that can be disguised: words that hold
characters of another width, marks apart from their letters, characters without width, foreign spaces, compatibility
twins or letters of two scripts, and whole words whose letters all have twins in the script around them. Look-alikes are mapped, and
the mapped words are grouped under the accent-sensitive Unicode collation, which counts decomposed and composed letters as
equal and ignores characters without width. Into the classes come all words of the corpus that collate with a mapped one; the
canonical member of a class is the plainest that occurs, of equally plain ones the most frequent, then the least, and it is joined back to
the words. Only where a class has no plain member that occurs, one is spelled from the Unicode data, in SQL. A value is a case if a word of it isn't its
class's canonical member; values decoded with a wrong encoding are left to that operator.

The table of look-alike letters is that of Unicode's confusables, read from the ICU library that Spark's collations come with: letters of the Cyrillic, Greek and
Armenian blocks with the skeleton of one Latin letter of the same case. Left out are small Greek letters but omicron (they are symbols) and the Cyrillic
letter whose twin only resembles its italic.

Defined results: null, empty and blank values are no case and stay as they are; equal values come out equal; repeated rows
come out each; values are scanned whole; full-width punctuation, emoji and Persian joiners, signs, superscripts, fractions and typographic quotes are proper writing.
A word of letters with twins only is judged by the nearest letters around it (up to REACH characters back), or, in a value without any other letter of its script, by the value.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import encoding
from corpusmill.session import settle

#: Characters without letters that a look-behind passes over; Java bounds it.
REACH = 1000
# A letter whose twin resembles its italic only; small letters of Greek but omicron are symbols.
ITALIC_ONLY = "г"
BLOCKS = {"cyrillic": (0x400, 0x52F), "greek": (0x370, 0x3FF), "armenian": (0x530, 0x58F)}

LATIN_C = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1E00}-\x{1EFF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FB00}-\x{FB06}"
CYR_C = r"\x{400}-\x{52F}"
GRE_C = r"\x{370}-\x{37D}\x{37F}-\x{3FF}"
ARM_C = r"\x{531}-\x{587}"
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{180B}-\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}"
SPACE = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
#: Letters and digits of other widths and compatibility twins of letters and ideographs.
TWIN = r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FF9F}\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}\x{212A}\x{212B}\x{132}\x{133}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}\x{2E80}-\x{2EF3}\x{2F00}-\x{2FD5}\x{F900}-\x{FAD9}\x{2F800}-\x{2FA1F}\x{1D400}-\x{1D7CB}\x{1D7CE}-\x{1D7FF}\x{FB50}-\x{FDFB}\x{FE70}-\x{FEFC}"
#: A look-behind sees the second half of a character beyond U+FFFF, so halves count as well.
EMOJI = r"\x{DC00}-\x{DFFF}\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}©®‼⁉™ℹ#*0-9"
JOINED = r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{900}-\x{DFF}"
#: Characters that stand in no proper word; joiners and selectors only where nothing needs them.
ODD = rf"(?:[{INVISIBLE}{TWIN}\x{{300}}-\x{{36F}}]|(?<![{JOINED}])\x{{200C}}|\x{{200C}}(?![{JOINED}])|(?<![{EMOJI}{JOINED}])\x{{200D}}|(?<![{EMOJI}])[\x{{FE00}}-\x{{FE0F}}])"
ALL = rf"{INVISIBLE}\x{{200C}}\x{{200D}}\x{{FE00}}-\x{{FE0F}}"
WORD = rf"\p{{L}}\p{{N}}\p{{M}}{ALL}\x{{2E80}}-\x{{2FD5}}"
PLAIN = rf"[\p{{L}}\p{{N}}&&[^{TWIN}]]"
MIXED = rf"(?:[{LATIN_C}][{ALL}\x{{300}}-\x{{36F}}]*[{CYR_C}{GRE_C}{ARM_C}]|[{CYR_C}{GRE_C}{ARM_C}][{ALL}\x{{300}}-\x{{36F}}]*[{LATIN_C}])"
#: A cheap first test: a character outside what most texts consist of.
UNUSUAL = r"[^\x00-\x{9F}\x{A1}-\x{AC}\x{AE}-\x{131}\x{134}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{2FF}\x{4E00}-\x{9FFF}\x{3001}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{2010}-\x{2027}]"


@lru_cache
def twins() -> dict[str, dict[str, str]]:
    """The letters of each block and the Latin letters they look like, from the confusables of Unicode in Spark's ICU."""
    checker = SparkSession.active()._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin: dict[str, list[str]] = {}
    for o in (*range(0x41, 0x5B), *range(0x61, 0x7B)):
        latin.setdefault(checker.getSkeleton(chr(o)), []).append(chr(o))
    out: dict[str, dict[str, str]] = {}
    for block, (lo, hi) in BLOCKS.items():
        pairs = out[block] = {}
        for ch in map(chr, range(lo, hi + 1)):
            base, *marks = unicodedata.normalize("NFD", ch) if ch.isalpha() else [""]
            if not base or base in ITALIC_ONLY or block == "greek" and (base.islower() and base != "ο" or marks):
                continue
            like = [x for x in latin.get(checker.getSkeleton(base), ()) if x.isupper() == base.isupper()]
            if like and len(new := unicodedata.normalize("NFC", like[0] + "".join(marks))) == 1:
                pairs[ch] = new
    return out


@lru_cache
def patterns() -> dict[str, str]:
    """The patterns that hang on the table of look-alikes."""
    out = {}
    alone = []
    for name, chars, least in (("cyrillic", CYR_C, 1), ("greek", GRE_C, 2)):
        own = "".join(sorted(twins()[name]))
        word = rf"[{own}][{own}{ALL}]" + ("*" if least == 1 else "+")
        many = rf"[{own}][{own}{ALL}]+"
        out[name] = rf"^[{own}{ALL}]+$"
        # With Latin next to it on one side and nothing else of its script on the other; the costly look-behind comes after the word itself.
        alone.append(rf"(?<![{WORD}])(?={many}(?![{WORD}]))(?:(?<=[{LATIN_C}][^\p{{L}}]{{1,{REACH}}}){many}(?![^\p{{L}}]+[{chars}])|(?<![{chars}][^\p{{L}}]{{1,{REACH}}}){many}(?=[^\p{{L}}]+[{LATIN_C}]))")
        # A word of its letters in a value that has other letters, none of them of the script but in such words.
        out[f"{name}_word"] = rf"(?<![{WORD}]){word}(?![{WORD}])"
    alone = "|".join(alone)
    out["suspect"] = rf"{ODD}|[{SPACE}]|{MIXED}|{alone}"
    out["token"] = rf"[{SPACE}]|(?<![{WORD}]){PLAIN}*+{ODD}[{WORD}]*|(?<![{WORD}])(?=[{WORD}]*?{MIXED})[{WORD}]+|{alone}"
    return out


def plain_of(ch: str) -> str:
    """What a compatibility twin stands for."""
    return unicodedata.normalize("NFKC", ch)


def twin_pairs() -> tuple[str, str]:
    """Twins that stand for one character, and those characters; made from the Unicode data, not from a list."""
    ranges = [(0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0x212A, 0x212B), (0x2E80, 0x2EF3), (0x2F00, 0x2FD5), (0xF900, 0xFAD9), (0x1D400, 0x1D7FF)]
    pairs = [(chr(o), plain_of(chr(o))) for lo, hi in ranges for o in range(lo, hi + 1)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


TWIN_FROM, TWIN_TO = twin_pairs()


@lru_cache
def spelling() -> str:
    """As JSON: letters with marks and the composed letters they are, and compatibility twins of several characters and what they stand for."""
    composed = {}
    for o in (*range(0xC0, 0x530), *range(0x1E00, 0x2000), 0x3099, *range(0x304C, 0x3100)):
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(o):
            composed[d] = chr(o)
    ranges = [(0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xFF66, 0xFF9F), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC), (0x2F800, 0x2FA1F)]
    several = {chr(o): plain_of(chr(o)) for lo, hi in ranges for o in range(lo, hi + 1) if plain_of(chr(o)) != chr(o)}
    kana = {a + m: plain_of(a + m) for a in map(chr, range(0xFF66, 0xFF9E)) for m in "\uff9e\uff9f" if len(plain_of(a + m)) == 1}
    return json.dumps(composed | several | kana)


def spelled(word: Column) -> Column:
    """The composed spelling of a word without characters of no width, for classes in which no plain member occurs."""
    table = F.from_json(F.lit(spelling()), "map<string,string>")
    drop = rf"[{INVISIBLE}\x{{FE00}}-\x{{FE0F}}]|(?<![{JOINED}])[\x{{200C}}\x{{200D}}]|[\x{{200C}}\x{{200D}}](?![{JOINED}])"
    marks = r"\x{300}-\x{36F}\x{FF9E}\x{FF9F}\x{3099}\x{309A}"
    clusters = F.regexp_extract_all(F.regexp_replace(word, drop, ""), F.lit(rf"(?s).[{marks}]*"), F.lit(0))
    # A cluster that isn't in the table may begin with one that is: marks in another order, or more of them.
    known = F.transform(clusters, lambda c: F.coalesce(F.element_at(table, c), F.concat(F.coalesce(F.element_at(table, F.substring(c, 1, 2)), F.substring(c, 1, 2)), F.substring(c, F.lit(3), F.length(c)))))
    return F.array_join(known, "")


def mapped(token: Column) -> Column:
    """The word with look-alikes mapped: widths and twins, then letters of another script toward the script of the word."""
    t = F.translate(token, TWIN_FROM, TWIN_TO)
    t = F.regexp_replace(t, f"^[{SPACE}]$", " ")
    table = twins()
    every = {k: v for pairs in table.values() for k, v in pairs.items()}
    latin, cyrillic, greek, armenian = (t.rlike(f"[{c}]") for c in (LATIN_C, CYR_C, GRE_C, ARM_C))
    to_latin = F.translate(t, "".join(every), "".join(every.values()))
    # Latin letters that stand for letters of the Russian alphabet.
    russian = {v: k for k, v in table["cyrillic"].items() if 0x410 <= ord(k) <= 0x451 or k == "Ё"}
    to_russian = F.translate(t, "".join(russian), "".join(russian.values()))
    left = lambda c, s: c.rlike(f"[{s}]")
    russian_word = latin & cyrillic & left(to_latin, CYR_C)  # it has letters only Cyrillic has
    p = patterns()
    whole = (cyrillic & token.rlike(p["cyrillic"])) | (greek & token.rlike(p["greek"]))
    return (
        F.when(russian_word & ~left(to_russian, LATIN_C), to_russian)
        .when(russian_word, t)
        .when(latin & cyrillic, to_latin)
        .when(latin & (greek | armenian) & ~left(to_latin, GRE_C + ARM_C), to_latin)
        .when(~latin & whole, to_latin)
        .otherwise(t)
    )


def long_form(tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Rows (field, row_id, value) of (table, key, column, field name)."""
    by: dict[int, tuple[DataFrame, str, list]] = {}
    for df, key, col, name in tables:
        by.setdefault(id(df), (df, key, []))[2].append(F.struct(F.lit(name).alias("field"), df[col].alias("value")))
    parts = [df.select(df[key].cast("long").alias("row_id"), F.explode(F.array(*fs)).alias("v")).select("v.field", "row_id", "v.value") for df, key, fs in by.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def values(tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Rows (field, row_id, value, pattern) of the suspect values, written once as several steps read them; `pattern` names the words to be taken out."""
    p = patterns()
    v = F.col("value")
    unusual = long_form(tables).where(v.rlike(UNUSUAL))

    def only_such(name: str, chars: str) -> Column:
        """The value has words of twins, other letters, and nothing else of the script."""
        rest = F.regexp_replace(v, p[f"{name}_word"], " ")
        return v.rlike(f"[{chars}]") & ~rest.rlike(f"[{chars}]") & rest.rlike(r"\p{L}") & v.rlike(p[f"{name}_word"])

    kind = F.when(only_such("cyrillic", CYR_C), F.lit("cyrillic")).when(only_such("greek", GRE_C), F.lit("greek")).when(v.rlike(p["suspect"]), F.lit("plain"))
    return settle(unusual.withColumn("pattern", kind).where("pattern is not null"))


def token_of(pattern: Column) -> Column:
    """The pattern of the words to be taken out of a value."""
    p = patterns()
    return F.when(pattern == "cyrillic", F.lit(f"{p['token']}|{p['cyrillic_word']}")).when(pattern == "greek", F.lit(f"{p['token']}|{p['greek_word']}")).otherwise(F.lit(p["token"]))


def corpus_words(tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(word, n): every plain word of all values and how often it comes, combined on the map side."""
    words = long_form(tables).select(F.explode(F.regexp_extract_all("value", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(~F.col("word").rlike(rf"[{TWIN}]"))


def canonical_words(words: DataFrame, corpus: DataFrame, collation: str = "UNICODE", spell: bool = True) -> DataFrame:
    """Rows (token, canonical): the class of each distinct `token` under the Unicode collation, and its canonical member.

    `corpus` (word, n) holds the words that occur; those that collate with a mapped token are members of its class. `spell=False` leaves the choice to what occurs.
    """
    m = settle(words.select("token").distinct().withColumn("mapped", mapped(F.col("token"))))
    m = m.withColumn("class", F.expr(f"collate(mapped, '{collation}')"))
    odd = lambda c: F.length(c) - F.length(F.regexp_replace(c, rf"[{INVISIBLE}{TWIN}{SPACE}\x{{300}}-\x{{36F}}\x{{200C}}\x{{200D}}\x{{FE00}}-\x{{FE0F}}]", ""))
    rank = lambda made, n: F.struct(odd(F.col("member")).alias("odd"), made.alias("made"), (-n).alias("n"), F.length("member").alias("length"), "member").alias("r")
    made = F.array(F.struct(F.col("mapped").alias("member"), F.lit(0).alias("made")), *[F.struct(spelled(F.col("mapped")).alias("member"), F.lit(1).alias("made"))] * spell)
    own = m.select("class", F.explode(made).alias("x")).select("class", "x.*").select("class", rank(F.col("made"), F.lit(0).cast("bigint")))
    occurs = corpus.withColumn("class", F.expr(f"collate(word, '{collation}')")).join(m.select("class").distinct(), "class", "left_semi")
    members = own.unionByName(occurs.withColumnRenamed("word", "member").select("class", rank(F.lit(0), F.col("n"))))
    best = members.groupBy("class").agg(F.min("r").alias("b"))
    return m.join(best, "class").select("token", F.expr("collate(b.member, 'UTF8_BINARY')").alias("canonical"))


def disguised(long: DataFrame, tables: list[tuple[DataFrame, str, str, str]], **how) -> DataFrame:
    """Rows (field, row_id, value, pattern, at, token, canonical) of every word taken out of the suspect values."""
    words = long.select("field", "row_id", "value", "pattern", F.posexplode(F.regexp_extract_all("value", token_of(F.col("pattern")), F.lit(0))).alias("at", "token"))
    return words.join(canonical_words(words, corpus_words(tables), **how), "token")


def found_rows(tables: list[tuple[DataFrame, str, str, str]], **how) -> DataFrame:
    """Distinct (field, row_id) of the values that are a case."""
    hit = disguised(values(tables), tables, **how).where("token != canonical").select("field", "row_id", "value").distinct()
    wrong = garbled(hit)
    return hit.join(wrong, ["field", "row_id"], "left_anti").select("field", "row_id").distinct()


def garbled(hit: DataFrame) -> DataFrame:
    """Those of the values that were decoded with a wrong encoding; a search query is judged like a title."""
    long = hit.withColumn("id", F.struct("field", "row_id"))
    return encoding.repaired_values(long, "id", ["value"]).select("id.field", "id.row_id").distinct()


def normalized(tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Rows (field, row_id, normalized) of the cases: each word replaced by its canonical member, all else as it was."""
    words = disguised(values(tables), tables)
    whole = words.groupBy("field", "row_id", "value", "pattern").agg(F.sort_array(F.collect_list(F.struct("at", "canonical"))).alias("new"), F.max((F.col("token") != F.col("canonical")).cast("int")).alias("hit")).where("hit = 1")
    whole = whole.join(garbled(whole), ["field", "row_id"], "left_anti")
    gaps = F.split("value", token_of(F.col("pattern")), -1)
    text = F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(F.col("new"), F.slice(gaps, 2, F.size(gaps)), lambda w, g: F.concat(w["canonical"], g)), ""))
    return whole.select("field", "row_id", text.alias("normalized")).distinct()
