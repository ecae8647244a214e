"""Template residue, filler and error pages (problem 9).

Records are aligned on what they share, and what differs between them is a slot. A possible slot is a bracketed name or a blank;
its template is the text of its sentence to the left (to the right, where nothing stands left), with the other slots and numbers
masked. Records with the same template are aligned by grouping: a position that retains brackets of three or more kinds, or that
other records fill with ordinary words, is a slot of the template, not its syntax. Names that such slots retain are variables' names (if
most of their own places are slots), and every open place with a variable's name, and every blank in a slot, is residue. A place is
closed only if its own sentence, or the one before it on its line, explains or instructs how templates are written.

Beside slots, whole pages are aligned: what is no menu, header or footer line and no tag is the body, the rest its frame. A body that comes, but
for its numbers, in three or more different frames is a notice. Sentences that stand on pages with a notice only are notices as well; that is repeated
until none is added, so notices that come beside others only are reached as well. A page is a case if all its
sentences are notices or filler. A few seeds per language let tables that are too small for repetition start; `seeds=False` leaves
them out, `learn=False` leaves out what is learned.

One Python pass reads each text once; everything after it is grouping and joining in SQL over distinct texts, so copies count once and a
text that a third of all rows repeat is one row.

Defined results: null, empty and blank texts are no case; repeated rows are judged each; texts are read whole; empty tables give no rows.
A body of more than NOTICE_LENGTH characters that comes in several frames is taken for a text that several sites show, not for a notice.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import settle

#: Kinds of brackets that a slot must retain in aligned records; only kinds that no markup uses for its own tell (numbers as in SLOTS, from 1).
KINDS, OWN_KINDS = 3, (1, 3, 4, 8, 10, 11, 12, 13, 14, 15, 17)
#: Share of a name's places that must be slots; different texts in which a template, a sentence or a body must come; share of a sentence's texts that must hold a notice.
NAME_SHARE, LEARN, SHARE = 0.5, 3, 0.9
#: Longest body that is learned from its frames alone.
NOTICE_LENGTH = 400

# How templates write a slot.
SLOTS = [
    r"\$\{\{\s*([^{}\n]+?)\s*\}\}", r"\{\{\s*([^{}\n]+?)\s*\}\}", r"\{%\s*([^{}%\n]+?)\s*%\}", r"\$\{\s*([^{}\n]+?)\s*\}", r"\{\s*([^{}\n]+?)\s*\}",
    r"\[\[\s*([^\[\]\n]+?)\s*\]\]", r"\[\s*([^\[\]\n]+?)\s*\]", r"<<\s*([^<>\n]+?)\s*>>", r"<\s*([^<>\n]+?)\s*>", r"&lt;\s*([^&\n]+?)\s*&gt;",
    r"%\(([^()\n]+)\)s", r"%([^%\s][^%\n]*)%", r"@@([^@\n]+)@@", r"#([^#\s][^#\n]*)#", r"_{3,}\s?\(([^()\n]+)\)", r"__([^_\s][^\n]*?)__", r"\$([^$\s\d][^$\n]*)\$",
    r"(_{3,}|\[[ .…_]*\]|\{\{?\s*\}?\}|<\s+>|\.{5,})",
]
BLANK = len(SLOTS)
SLOT = re.compile(r"(?=[$\{\[<&%@#_.])(?:" + "|".join(SLOTS) + ")")
NAME = re.compile(r"[^\W\d_](?:[\w .:'-]*\w)?")
HTML_NAME = re.compile(r"(?i)/?(?:a|p|b|i|u|s|h[1-6]|ul|ol|li|dl|dt|dd|td|th|tr|br|hr|em|div|pre|code|span|img|html|head|body|title|table|tbody|thead|script|style|strong|noscript|center|link|meta|form|input|nav|main|header|footer|section|article|sub|sup|font|quote|blockquote|iframe|button|label|svg|path|ref|nowiki|math|gallery)(?:\s.*)?")
# Seeds, names that templates give their variables.
SEED_NAMES = r"(?i)(?:(?:first|last|full|your|company|project)?[ _.]?name|(?:insert|enter|your|fill in) .+|.+ (?:goes )?here|TBD\w*|TODO\w*|placeholder|company|city|recipient|signature|amount|(?:due[ _.])?date|vorname|nachname|betrag|datum|fecha|nombre|nom(?: du client)?|montant|nome|имя|дата|日期|姓名)"
#: Instructions that quote a slot, with the slot masked.
INSTRUCTS = re.compile(r"(?i)\b(?:put|write|type|use|schreiben sie|écrivez|mettez|escriba|ponga|escreva|coloque|напишите)\s+[\"'“„«`]?\x01[\"'”“»`]?,?\s+(?:where(?:ver)?|whenever|instead of|in place of|wo|dort|là où|donde|onde|там,? где)\b|(?:写上|写)\x01(?:的地方|代替)")
EXPLAINS = re.compile(r"(?i)\b(?:template|placeholder|mail merge|variable|syntax|Vorlage|Platzhalter|plantilla|modèle de document)\b|模板|占位符|шаблон")

# Seeds, whole sentences of notices and filler, a few per language.
NOTICES = [
    r"(?:please |you need to )?(?:enable|activate|turn on) (?:javascript|cookies)\b.*", r"(?:error )?[45]\d\d\b.{0,5}(?:not found|bad gateway|internal server error|the page you)\b.*", r"access (?:is )?denied.*", r"your session (?:has )?(?:expired|timed out)\b.*", r"this site is down for maintenance.*",
    r"bitte aktivieren sie javascript.*", r"seite nicht gefunden.*", r"ihre sitzung ist abgelaufen.*", r"zugriff verweigert.*", r"interner serverfehler.*",
    r"veuillez activer javascript.*", r"page introuvable.*", r"votre session a expiré.*", r"accès (?:refusé|interdit).*", r"erreur interne du serveur.*",
    r"active javascript.*", r"página no encontrada.*", r"su sesión ha (?:caducado|expirado).*", r"acceso denegado.*", r"error interno del servidor.*",
    r"ative o javascript.*", r"página não encontrada.*", r"sua sessão expirou.*", r"acesso negado.*",
    r"请启用 ?javascript.*", r"页面不存在.*", r"登录已过期.*", r"访问被拒绝.*", r"服务器内部错误.*",
    r"включите javascript.*", r"страница не найдена.*", r"доступ запрещ[её]н.*", r"ваша сессия истекла.*",
]
FILLERS = [
    r"this is placeholder (?:copy|text)\b.*", r"text goes here", r"content coming soon", r"headline one", r"das ist ein blindtext.*", r"hier steht (?:später )?ihr text.*",
    r"votre texte ici.*", r"ceci est un faux texte.*", r"texto de relleno.*", r"aquí va su texto.*", r"texto de exemplo.*", r"此处填写.*", r"(?:占位文本)+.*", r"текст-заполнитель.*",
]
SEED_SENTENCE = re.compile("(?is)(?:" + "|".join([*NOTICES, *FILLERS]) + r")[.!?。！？…]*")
KEYS = ("asd", "Asd", "ASD", "qwe", "Qwe", "QWE", "jkl", "zxcv", "uiop", "fdsa")
LOREM = re.compile(r"(?:lorem|ipsum|dolor|situm?$|sit$|amet|conse|adip|elit|eiusm|tempo|tempu|incid|labor|magn|aliqu|viver|lacu|fauc|port[ao]|ferme|morbi|urna|null|bland|pret[io]|salic|congu|est(?:um)?$|veli|ris[ou]|sed$|ut$|et$|non$|in$)")
WORDS = re.compile(r"[^\W\d_]+")
MASH = re.compile(r"(?i)\b(?:(?:asdf|qwer(?:ty)?|jkl|hjkl|zxcv|uiop|fdsa|asd|qwe)[a-z]{0,4}\b[ ,;]*){2,}")
CHROME = re.compile(
    r"(?i)(?:home|menu|men[uú]|login|log ?in|log ?out|sign (?:in|up)|help|search|contact|about(?: us)?|back(?: to (?:start|top|home))?|skip to (?:main )?content|share(?: this page)?|print(?: this page)?|top|next|previous|newsletter|imprint|privacy(?: policy)?|terms(?: of use)?|sitemap|cookies?|impressum|datenschutz|kontakt|startseite|hilfe|suche|anmelden|accueil|aide|recherche|connexion|inicio|ayuda|buscar|contacto|acceder|"
    r"powered by [^.!?。！？]+|(?:©|\(c\)|copyright)[^.!?。！？]*|request id:? ?[\w. -]+|all rights reserved[^.!?。！？]*)(?:\s*[|•·»>/-]\s*(?:home|search|contact|help|login|menu|about|[^\W\d]{2,14}))*"
)
TAGS = re.compile(r"(?is)<(?:title|style|script)\b[^>]*>.*?</(?:title|style|script)\s*>|</?[a-z!][^<>]*>")
SENTENCE = re.compile(r"(?<=[.!?。！？…])(?!\d)\s*")
WORD = re.compile(r"\w")
MARK = re.compile(r"[.!?。！？；;](?!\d)")
PUNCTUATION = re.compile(r"[.,;:!?。！？，；：、]")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
#: Numbers and the Latin words they are part of vary from record to record: times, references, addresses.
MASK = re.compile(r"(?<![A-Za-z/-])[A-Za-z/-]*\d+(?:[A-Za-z/:.,-]*\d+)*")


def hash64(text: str) -> int:
    import xxhash

    return signed(xxhash.xxh64_intdigest(text))


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def is_filler_latin(sentence: str) -> bool:
    words = WORDS.findall(sentence.lower())
    if not any(LOREM.match(w) for w in words[:2]):
        return False
    hits = sum(bool(LOREM.match(w)) for w in words)
    return len(words) >= 4 and hits >= 0.75 * len(words) or hits == len(words) > 1


def slots_of(text: str) -> Iterator[tuple[int, int, str, int]]:
    """(template, kind, name, filled) of every open place: the template's hash, the kind of brackets, what it retains, and the hash of its sentence as other records may fill it."""
    import xxhash

    found = [m for m in SLOT.finditer(text)]
    if not found:
        return
    pieces, places, at, size = [], [], 0, 0  # the text with every place as one character, and where each stands in it
    for m in found:
        pieces += [text[at : m.start()], "\x01"]
        size += m.start() - at
        places.append(size)
        size, at = size + 1, m.end()
    whole = "".join([*pieces, text[at:]])
    starts = {0, *(m.end() for m in re.finditer("\n", whole))}
    marks = sorted({*starts, *(m.end() for m in MARK.finditer(whole)), len(whole) + 1})
    n = 0
    while n < len(places):
        k = bisect_right(marks, places[n])
        own, stop = marks[k - 1], min(marks[k], len(whole))
        begin = marks[max(k - 2, 0)] if own not in starts else own
        last = n
        while last < len(places) and places[last] < stop:
            last += 1
        sentence = whole[own:stop]
        if not EXPLAINS.search(whole[begin:stop]) and not any(EXPLAINS.search(m.group(0)) for m in found[n:last]) and not INSTRUCTS.search(whole[begin:stop]):
            filled = hash64(MASK.sub("0", sentence.replace("\x01", "0").strip()))
            left, at, first = xxhash.xxh64(), own, True
            for m, i in zip(found[n:last], places[n:last]):
                left.update(NUMBER.sub("0", whole[at:i].lstrip() if first else whole[at:i]))
                bare = first and not whole[own:i].strip()
                at, first = i, False
                name = m.group(m.lastindex)
                kind = m.lastindex if name.strip(" \t._…") else BLANK
                if kind == BLANK:
                    name = ""
                elif not NAME.fullmatch(name) or kind in (9, 10) and HTML_NAME.fullmatch(name):
                    continue
                template = hash64("\x02" + NUMBER.sub("0", whole[i + 1 : stop]).strip()) if bare else signed(left.intdigest())
                yield template, kind, name, filled
        n = last


def page_of(text: str, seeds: bool = True) -> tuple[list[int], int, int, int]:
    """Hashes of the distinct sentence templates that are no seeds, the number of seeds and filler, the hash of the body (0 if it is none to learn from) and that of its frame."""
    body = TAGS.sub("\n", text) if "<" in text else text
    mash = any(k in body for k in KEYS)
    unknown: set[int] = set()
    said, frame = [], ["" if body is text else "<>"]
    known = 0
    lines = [x.strip() for x in body.split("\n")]
    first = True
    for n, line in enumerate(lines):
        if not line:
            continue
        if CHROME.fullmatch(line):
            frame.append(line)
            continue
        if mash:
            line = MASH.sub("\n", line)
            if "\n" in line:
                known += 1
        for s in SENTENCE.split(line.replace("\n", " ")):
            s = s.strip()
            if not WORD.search(s):
                continue
            if seeds and SEED_SENTENCE.fullmatch(s) or is_filler_latin(s):
                known += 1
                first = False
                continue
            if CHROME.fullmatch(s.rstrip(".")):
                frame.append(s)
                continue
            if first and not PUNCTUATION.search(s) and n + 1 < len(lines) and not lines[n + 1]:
                first = False  # a heading
                frame.append(s)
                continue
            first = False
            said.append(s)
            unknown.add(hash64(MASK.sub("0", s)))
    short = said and sum(map(len, said)) <= NOTICE_LENGTH
    return list(unknown), known, hash64(MASK.sub("0", "\n".join(said))) if short else 0, hash64("\n".join(frame))


def scanned(docs: DataFrame, key: str, text: str, seeds: bool = True) -> DataFrame:
    """One row per document: id, text (its hash), known, body, frame, sentences array<bigint>, slots array<struct>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_type = pa.list_(pa.struct([("template", pa.int64()), ("kind", pa.int32()), ("name", pa.string()), ("filled", pa.int64())]))
        for batch in batches:
            pages, slots, texts = [], [], batch.column(1).to_pylist()
            for t in texts:
                pages.append(page_of(t, seeds))
                slots.append([dict(zip(("template", "kind", "name", "filled"), x)) for x in slots_of(t)])
            cols = [pa.array([p[k] for p in pages], kind) for k, kind in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (0, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(hash64, texts), pa.int64()), *cols, pa.array(slots, slot_type)], names=["id", "text", "known", "body", "frame", "sentences", "slots"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text")).where(F.col("text").rlike(r"\S"))
    return rows.mapInArrow(run, f"id {kind}, text bigint, known int, body bigint, frame bigint, sentences array<bigint>, slots array<struct<template:bigint,kind:int,name:string,filled:bigint>>")


def learned_slots(texts: DataFrame, said: DataFrame, seeds: bool, learn: bool) -> DataFrame:
    """Texts with residue: open places with a variable's name, and blanks in slots. `said` has (s, n): sentences and the number of texts they come in."""
    places = settle(texts.select("text", F.explode("slots").alias("p")).select("text", "p.*"))
    own = F.when(F.col("kind").isin(*OWN_KINDS), F.expr("shiftleft(1, kind)"))
    variable = places.where(F.lit(seeds) & F.col("name").rlike(f"^(?:{SEED_NAMES})$")).select("name").distinct()
    if not learn:
        return places.join(variable, "name", "left_semi").select("text")
    # Bits of the kinds combine on the map side, however often a template comes.
    varied = places.groupBy("template").agg(F.bit_or(own).alias("kinds")).where(F.bit_count("kinds") >= KINDS).select("template")
    filled = places.select("template", F.col("filled").alias("s")).distinct().join(said.where(F.col("n") >= LEARN), "s", "left_semi").select("template")
    slots = settle(varied.union(filled).distinct().withColumn("slot", F.lit(1)))
    judged = settle(places.join(slots, "template", "left"))
    names = judged.where(f"kind != {BLANK}").groupBy("name").agg(F.bit_or(own).alias("kinds"), (F.count("slot") / F.count(F.lit(1))).alias("share"), F.count("slot").alias("slots"))
    names = names.where((F.col("share") >= NAME_SHARE) & (F.col("slots") >= LEARN) & (F.bit_count("kinds") >= KINDS)).select("name")
    retained = judged.join(variable.union(names).distinct(), "name", "left_semi").select("text")
    return retained.union(judged.where(f"kind = {BLANK} and slot = 1").select("text"))


def learned_pages(texts: DataFrame, spoken: DataFrame, said: DataFrame) -> DataFrame:
    """Sentences (s) of notices: of bodies in several frames, and those that come on pages with a notice only."""
    bodies = texts.where("body != 0").groupBy("body", "frame").agg(F.first("sentences").alias("sentences")).groupBy("body").agg(F.count(F.lit(1)).alias("frames"), F.first("sentences").alias("sentences"))
    known = settle(bodies.where(F.col("frames") >= LEARN).select(F.explode("sentences").alias("s")).distinct())
    often = settle(spoken.join(said.where(F.col("n") >= LEARN), "s"))
    seeded = spoken.where("known > 0").select("text").distinct()
    while True:
        pages = often.join(known, "s", "left_semi").select("text").union(seeded).distinct()
        more = often.join(pages, "text", "left_semi").groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).where(F.col("k") >= SHARE * F.col("n")).select("s")
        new = settle(more.join(known, "s", "left_anti"))
        if new.isEmpty():
            return known
        known = settle(known.union(new))


def found_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", seeds: bool = True, learn: bool = True) -> DataFrame:
    """Distinct keys of the documents that are template residue, filler, error pages or notices."""
    docs = settle(scanned(docs, key, text, seeds))
    texts = settle(docs.groupBy("text").agg(*[F.first(c).alias(c) for c in ("known", "body", "frame", "sentences", "slots")]))
    spoken = texts.where(F.size("sentences") > 0).select("text", "known", F.size("sentences").alias("of"), F.explode("sentences").alias("s"))
    said = settle(spoken.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEARN))
    hit = learned_slots(texts, said, seeds, learn).union(texts.where("known > 0 and size(sentences) = 0").select("text"))
    if learn:
        notices = learned_pages(texts, spoken, said)
        whole = spoken.join(notices, "s", "left_semi").groupBy("text").agg(F.first("of").alias("of"), F.count(F.lit(1)).alias("k")).where("k = of").select("text")
        hit = hit.union(whole)
    return docs.join(hit.distinct(), "text", "left_semi").select(F.col("id").alias(key)).distinct()


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that remain."""
    return docs.join(found_rows(docs, key, text), key, "left_anti")
