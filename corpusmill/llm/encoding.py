"""Text decoded with a wrong encoding: finding it and restoring the original by round trips (problem 4).

A garbled stretch is re-encoded under a candidate legacy encoding and strictly decoded as the encoding that was meant;
this repeats for nested layers and is accepted only while a garbling cost drops. Stretches are found in character space:
for each legacy encoding the characters of UTF-8 lead and continuation bytes form a pattern, so a text that is garbled only
in places is repaired there and nowhere else. Single-byte Cyrillic read as Western text or as another Cyrillic encoding, double-byte Chinese, Japanese
and Korean read as Western text, UTF-8 read as a Chinese encoding, and UTF-16 read byte by byte or in the wrong order have patterns of their own; all are accepted by
the cost alone. Layers are undone until the cost drops no further, however many there are. Characters that were lost (a question mark or U+FFFD in place of
a byte) make a value a case, but are left where nothing tells what they were.

Defined results: null, empty and ASCII values are no case and stay as they are; repeated rows come out each; texts are
scanned whole whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legacy encodings whose misuse for UTF-8 is looked for; "sloppy" ones keep undefined bytes as control characters.
SINGLE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman", "cp850", "iso8859_2", "cp1254")
#: What can hold a case at all: anything else never reaches Python.
SUSPECT = r"\x00|[^\x00-\x7F]{2}|[\x{80}-\x{9F}\x{FFFD}]|[ÂÃÄÅÐÑâäåæçèé]\?|[a-zA-Z]\p{IsHan}+[a-zA-Z]"
#: Signs of lost characters: substitutes, half sequences, and substitutes that went through UTF-8 and GBK once more.
LOST = re.compile(r"�|锟斤|斤拷|拷锟|[ÃÂÐÑ]\?(?=[a-zà-ÿA-Z ])|(?:ï¿½)")
CYRILLIC = re.compile("[Ѐ-џ]")
COMMON_CYRILLIC = frozenset("абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ")
COMMON_LATIN = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒšžŠŽčćşğıłńśźżąęőűřěůďťňăâîșț")
COMMON_SIGNS = frozenset("–—‘’‚“”„…•«»‹›€£§°±²³µ·¹º¼½¾¿¡×÷©®™№ ‰†‡¶⁶✔❤≤≥≠√")


@lru_cache(maxsize=200_000)
def char_cost(ch: str) -> float:
    """Garbling cost of one character: what ordinary text holds is cheap, what only garbling makes is dear."""
    o = ord(ch)
    if o < 0x80:
        return 0.3
    if ch in COMMON_CYRILLIC or ch in COMMON_LATIN:
        return 1.0
    if ch in COMMON_SIGNS:
        return 1.4
    if 0x4E00 <= o <= 0x9FFF:
        try:
            return 1.0 if ch.encode("gb2312")[0] < 0xD8 else 2.0
        except UnicodeEncodeError:
            return 3.0
    if 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFFEF or 0x3040 <= o <= 0x30FF:
        return 1.0
    if 0x1F300 <= o <= 0x1FAFF or o in (0x200D, 0xFE0F) or 0x2000 <= o <= 0x206F or 0x0300 <= o <= 0x036F:
        return 1.5
    if 0x0370 <= o <= 0x03FF or 0x1E00 <= o <= 0x1EFF or 0x0600 <= o <= 0x06FF or 0x0100 <= o <= 0x024F or 0x2070 <= o <= 0x22FF or 0x2E80 <= o <= 0x2FDF or 0xF900 <= o <= 0xFAFF or 0xAC00 <= o <= 0xD7AF or 0x0590 <= o <= 0x05FF:
        return 1.8
    return 4.0


#: Frequencies of Russian letters in percent, the least common ones last.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04)))
#: Single-byte Cyrillic encodings that are taken for each other.
CYRILLIC_BYTE = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")


STACKED = re.compile("[À-ÿ]{3}")


def cost(text: str) -> float:
    """Garbling cost of a text; accented letters in a row, which no Western word has, cost more."""
    return sum(map(char_cost, text)) + 1.5 * len(STACKED.findall(text))


def cyrillic_cost(word: str) -> float:
    """Garbling cost of a Cyrillic word by the frequency of its letters and its case: capitals behind small letters are dear."""
    letters = sum(-math.log(RUSSIAN.get(c, 0.01) / 100) if c.isalpha() else 8.0 for c in word.lower())
    return letters + 3.0 * sum(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


class Legacy:
    """One single-byte encoding: the pattern of UTF-8 sequences seen through it, and the way back to bytes."""

    def __init__(self, name: str):
        self.name = name
        self.byte: dict[str, int] = {}
        for b in range(0x80, 0x100):
            try:
                ch = bytes([b]).decode(name)
            except UnicodeDecodeError:
                ch = chr(b)
            self.byte.setdefault(ch, b)
        for b in range(0x80, 0xA0):  # sloppy decoders keep what they can't map
            self.byte.setdefault(chr(b), b)
        chars = lambda lo, hi: "".join(re.escape(c) for c, b in self.byte.items() if lo <= b <= hi)
        tail = f"[{chars(0x80, 0xBF)}]"
        self.lead = frozenset(c for c, b in self.byte.items() if 0xC2 <= b <= 0xF4)
        self.tail = frozenset(c for c, b in self.byte.items() if 0x80 <= b <= 0xBF)
        self.high = frozenset(self.byte)
        self.letters = frozenset(c for c, b in self.byte.items() if c.isalpha())
        self.pattern = re.compile(f"(?:[{chars(0xC2, 0xDF)}]{tail}|[{chars(0xE0, 0xEF)}]{tail}{{2}}|[{chars(0xF0, 0xF4)}]{tail}{{3}})+")
        self.holes = re.compile(f"[{chars(0xE0, 0xEF)}](?:{tail}\\?|\\?{tail}|\\?\\?)|[{chars(0xC2, 0xDF)}]\\?")

    def back(self, text: str) -> str | None:
        try:
            return bytes(map(self.byte.__getitem__, text)).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return None


LEGACY = [Legacy(n) for n in SINGLE_BYTE]
#: GBK read as a Western encoding, and Russian in a single-byte encoding read as one.
WEST = re.compile("[¡-ÿŒœŠšŸŽžƒˆ˜–-—‘-„†-•…‰‹›€™]{3,}")
PAIRS = re.compile("(?:[°-÷][¡-þ])+|[¡-©][¡-þ]")
WEST_BYTE = LEGACY[0].byte
CYR_WORD = re.compile("(?<![A-Za-zÀ-ÿ])[À-ÿ¸¨]{3,}(?![A-Za-zÀ-ÿ])")
CYR_ANY = re.compile("(?<![A-Za-z])[À-ÿ¸¨]+(?![A-Za-z])")
#: Runs of Cyrillic letters, and of the signs that other encodings have in their places.
CYR_RUN = re.compile("[Ѐ-џ\u0490\u0491ЂЃѓЉЊЌЋЏђљњќћџ°-¿─-╿▀-▟§¤®©™£•№]*[Ѐ-џ][Ѐ-џ\u0490\u0491°-¿─-╿▀-▟§¤®©™£•№]*")
#: UTF-16 read as single bytes, and with low and high bytes exchanged: letters of ASCII in the high byte.
NULLS = re.compile("(?:[^\x00]\x00){3,}|(?:\x00[^\x00]){3,}")
SWAPPED = re.compile("[" + "".join(chr(o << 8) for o in (*range(0x20, 0x7F), 0x0A)) + "]{4,}")
#: UTF-8 read as GBK: runs of what that encoding gives, and single ideographs inside Western words.
HAN = re.compile("[㐀-鿿豈-﫿　-ㄯ＀-￯Α-ωЁ-ё‐-♂-�€]{2,}")
INSIDE = re.compile("(?<=[a-z])[一-鿿]{1,2}(?=[a-z])")


@lru_cache(maxsize=50_000)
def plausible(new: str) -> bool:
    """Whether a decoded stretch holds ordinary characters, or is a garbled stretch of the next layer, however many follow."""
    dear = max(map(char_cost, new))
    if dear <= 1.5 or len(new) >= 3 and dear < 4:
        return True
    return any(e.pattern.fullmatch(new) and (inner := e.back(new)) is not None and len(inner) < len(new) and (max(map(char_cost, inner)) <= 1.5 or e.pattern.search(inner) and plausible(inner)) for e in LEGACY)


#: A capital behind a small letter, or a rare pair of capitals: a word that another Cyrillic encoding may have made.
ODD_CYRILLIC = re.compile("[а-яёѓ-џ][А-ЯЁЂ-Џ]|[А-ЯЁЂ-Џ]{4}|[°-¿─-╿▀-▟][Ѐ-џ]|[Ѐ-џ][°-¶¸¹¼-¿─-╿▀-▟]")
HALF = re.compile(r"(?<=[a-z])Ã\?(?=[a-z])")


def utf8_as_legacy(text: str, chars: frozenset[str]) -> str:
    """Undo one layer of UTF-8 read as a single-byte encoding; the encoding that explains most characters wins, among equal ones that with the greatest drop of the cost."""
    best, low = text, (0, 0.0)
    for e in LEGACY:
        if not (chars & e.lead and chars & e.tail):
            continue
        gain, taken = 0.0, 0
        out, at = [], 0
        for m in e.pattern.finditer(text):
            old = m.group(0)
            new = e.back(old)
            if new is None:
                continue
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if len(old) < 6 and (before in e.letters or after in e.letters):
                continue  # part of a word in that alphabet
            drop = cost(old) - cost(new)
            if drop <= 0.3 or not plausible(new):
                continue
            gain += drop
            taken += len(old)
            out += [text[at : m.start()], new]
            at = m.end()
        if gain > 0 and (taken, gain) > low:
            best, low = "".join(out) + text[at:], (taken, gain)
    return best


def other_double(old: str, data: bytes) -> str:
    """Japanese, Korean or traditional Chinese text of three letters or more that was read as a Western encoding; only common rows of the encoding count."""
    if len(data) < 6:
        return old
    for name, lo, hi in (("euc_jp", 0xA4, 0xCF), ("euc_kr", 0xB0, 0xC8), ("big5", 0xA4, 0xC6)):
        try:
            new = data.decode(name)
        except UnicodeDecodeError:
            continue
        if all(len(b := c.encode(name)) == 2 and lo <= b[0] <= hi for c in new) and len(new) < cost(old):
            return new
    return old


def cyrillic_as_cyrillic(text: str) -> str:
    """Undo one single-byte Cyrillic encoding read as another, word by word; short words go with a repaired neighbour."""
    best, low = text, 0.0
    spans = [m.span() for m in CYR_RUN.finditer(text)]
    if not spans:
        return text
    for read in CYRILLIC_BYTE:
        for meant in CYRILLIC_BYTE:
            if read == meant:
                continue
            news, gains = [], []
            for i, j in spans:
                old = text[i:j]
                try:
                    new = old.encode(read).decode(meant)
                except UnicodeError:
                    new = old
                proper = all(c in COMMON_CYRILLIC for c in new) and new[1:] in (new[1:].lower(), new[1:].upper())
                news.append(new if proper else old)
                gains.append(cyrillic_cost(old) - cyrillic_cost(new) if proper and new != old else 0.0)
            sure = [g >= max(4.0, 0.8 * (j - i)) and j - i >= 4 for g, (i, j) in zip(gains, spans)]
            # Capitals behind a small letter tell a sentence's first word; without one, a single word may be a code in capitals.
            if sum(sure) < 3 and not any(ok and re.search("[а-яё][А-ЯЁ]|[^Ѐ-џ]", text[i:j]) for ok, (i, j) in zip(sure, spans)):
                continue
            for _ in (0, 1):  # from a repaired word to those beside it, both ways: capitals that become ordinary words
                for k in range(1, len(sure)):
                    old, new = text[slice(*spans[k])], news[k]
                    sure[k] = sure[k] or sure[k - 1] and gains[k] > -4 and not (old.islower() or old.istitle() and len(old) > 1) and (new.islower() or new.istitle())
                sure, gains, news, spans = sure[::-1], gains[::-1], news[::-1], spans[::-1]
            gain = sum(g for g, ok in zip(gains, sure) if ok)
            if gain > low:
                out, at = [], 0
                for (i, j), new, ok in zip(spans, news, sure):
                    if ok:
                        out += [text[at:i], new]
                        at = j
                best, low = "".join(out) + text[at:], gain
    return best


def utf16_slip(text: str) -> str:
    """Undo UTF-16 read byte by byte, or with its bytes in the wrong order."""
    text = NULLS.sub(lambda m: m.group(0).replace("\x00", ""), text)
    swapped = lambda m: m.group(0).encode("utf-16-le").decode("utf-16-be")
    return SWAPPED.sub(lambda m: new if cost(new := swapped(m)) < cost(m.group(0)) else m.group(0), text)


def double_as_west(text: str) -> str:
    """Undo GBK, or single-byte Cyrillic, read as a Western encoding."""

    def run(m: re.Match) -> str:
        old = m.group(0)
        data = bytes(map(WEST_BYTE.get, old)) if all(c in WEST_BYTE for c in old) else None
        if not data or len(data) < 2:
            return old
        try:
            new = data.decode("gbk")
        except UnicodeDecodeError:
            try:  # the run may have lost a byte at an end
                new = data[:-1].decode("gbk") + old[-1]
            except UnicodeDecodeError:
                return other_double(old, data)
        return new if cost(new) / len(data) < 0.75 and (m.re is PAIRS or sum(0x4E00 <= ord(c) <= 0x9FFF for c in new) >= 2) else other_double(old, data)

    def word(m: re.Match) -> str:
        old = m.group(0)
        tries = []
        for e in ("cp1251", "koi8_r"):
            try:
                new = old.encode("latin-1").decode(e)
            except UnicodeDecodeError:
                continue
            if all(c in COMMON_CYRILLIC for c in new) and new[1:] in (new[1:].lower(), new[1:].upper()):
                tries.append(new)
        return tries[0] if tries else old

    out = WEST.sub(run, text)
    if out != text:
        out = PAIRS.sub(run, out)
    words = [m.group(0) for m in CYR_WORD.finditer(text)]
    if words and sum(word(CYR_WORD.fullmatch(w) or w) != w for w in words if CYR_WORD.fullmatch(w)) > 0.6 * len(words):
        out = min(out, CYR_ANY.sub(word, text), key=cost)
    return out


def utf8_as_double(text: str) -> str:
    """Undo UTF-8 read as GBK; bytes that had no pair are lost."""

    def run(m: re.Match) -> str:
        old = m.group(0)
        if 2 * sum(0x4E00 <= ord(c) <= 0x9FFF for c in old) < len(old):
            return old
        try:
            data = old.replace("�", "").replace("€", "").encode("gbk")
        except UnicodeEncodeError:
            return old
        new = data.decode("utf-8", "ignore")
        if len(new.encode()) < 0.7 * len(data) or cost(new) >= cost(old) or len(new) < 2 and not old.isalpha():
            return old
        if max(map(char_cost, new)) > 2 or len(data) < 6:
            return old
        exact = len(new.encode()) == len(data)
        if not exact and "�" not in old and "€" not in old:
            return old
        return new if exact else data.decode("utf-8", "replace")

    def inside(m: re.Match) -> str:
        try:
            new = m.group(0).encode("gbk").decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m.group(0)
        return new if all(c in COMMON_LATIN and c != "ÿ" for c in new) and cost(new) < cost(m.group(0)) + 0.5 else m.group(0)

    return INSIDE.sub(inside, HAN.sub(run, text))


def repair(text: str | None) -> tuple[str | None, bool]:
    """The restored text and whether any part had been decoded wrongly."""
    if not text or text.isascii() and "\x00" not in text:
        return text, False
    found = LOST.search(text) is not None
    now = text
    while True:
        new = utf8_as_legacy(now, frozenset(now))
        if WEST.search(now):
            other = double_as_west(now)
            if other != now and cost(other) < cost(new):
                new = other
        if new == now:
            new = utf8_as_double(now)
        if new == now and ("\x00" in now or SWAPPED.search(now)):
            new = utf16_slip(now)
        if new == now and ODD_CYRILLIC.search(now):
            new = cyrillic_as_cyrillic(now)
            if new != now:
                return new, True
        if new == now or len(new) > len(now):  # every layer of the others shortens the text
            break
        now, found = new, True
    if found:  # a byte lost inside a lower-case word, where the letter it makes costs less than the two signs left of it
        now = HALF.sub(lambda m: "í" if cost("í") < cost(m.group(0)) else m.group(0), now)
    return now, found


def repaired_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, field, old, fixed) of the values of `fields` of which any part was decoded wrongly."""
    kind = df.schema[key].dataType.simpleString()
    long = df.select(df[key].alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), df[f].alias("old")) for f in fields])).alias("v"))
    long = long.select("key", "v.field", "v.old").where(F.col("old").rlike(SUSPECT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, fixed = [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                new, found = repair(v)
                if found:
                    keep.append(i)
                    fixed.append(new)
            part = batch.take(pa.array(keep, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fixed, type=pa.string())], names=["key", "field", "old", "fixed"])

    return long.mapInArrow(run, f"key {kind}, field string, old string, fixed string").withColumnRenamed("key", key)


def found_rows(df: DataFrame, key: str = "row_id", fields: tuple[str, ...] = ("content", "title")) -> DataFrame:
    return repaired_values(df, key, list(fields)).select(key, "field").distinct()
