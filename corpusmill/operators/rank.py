"""Intent-aware reranking, deduplication, noise removal and paging of search candidates."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text

# Fixed values of the ranking: word sets and path fragments.
BROWSERS = ("chrome", "edge", "firefox")
FILE_WORDS = ("csv", "doc", "docx", "json", "md", "pdf", "ppt", "pptx", "txt", "xls", "xlsx")
FOLDER_WORDS = ("dir", "directory", "folder", "folders")
FOLDER_PHRASES = ("open folder", "in folder", "directory", "folder")
NOISY_PATHS = (
    "/$recycle.bin/", "/appdata/local/google/chrome/user data/", "/appdata/local/microsoft/edge/user data/", "/cache/", "/code cache/", "/dist/", "/dist-electron/", "/gpucache/",
    "/jssdk/", "/node_modules/", "/software/dingding/", "/software/dingtalk/", "/software/feishu/", "/software/lark/", "/web_content/", "/webcontent/",
)
NOISY_WORDS = ("dingding", "dingtalk", "feishu", "jssdk", "lark", "web_content", "webcontent")
PERSONAL = ("/desktop/", "/documents/", "/downloads/")
DAY = 86_400


def _words(s: str) -> str:
    return " ".join(s.lower().split())


@dataclass(frozen=True)
class Profile:
    """What a search string asks for."""

    query: str
    tokens: tuple[str, ...]
    file: bool
    folder: bool
    filename: bool
    url: bool
    bare: bool

    @property
    def compact(self) -> str:
        return self.query.replace(" ", "")

    @property
    def noisy(self) -> bool:
        return any(w in self.query for w in NOISY_WORDS)


def profile(search: str) -> Profile:
    q = _words(search)
    toks, run = [], ""
    for c in search.lower() + " ":
        if c == "_" or unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            toks.append(run)
            run = ""
    toks = list(dict.fromkeys(toks))
    head, dot, ext = q.rpartition(".")
    filename = " " not in q and bool(dot and head) and 2 <= len(ext.encode()) <= 6 and all(unicodedata.category(c)[0] in "LN" for c in ext)
    return Profile(
        query=q,
        tokens=tuple(toks),
        file=any(c in q for c in "./\\") or any(t in FILE_WORDS for t in toks),
        folder=any(t in FOLDER_WORDS for t in toks) or any(p in q for p in FOLDER_PHRASES),
        filename=filename,
        url="://" in search,
        bare=len(q) >= 2 and not any(c in q for c in " /\\."),
    )


def features(df: DataFrame) -> DataFrame:
    """The texts that rules look at, in columns that begin with two underscores."""
    df = df.withColumn("__title", text.rank_text(F.col("title"))).withColumn("__path", text.normal_path(F.col("path")))
    base = text.rank_text(text.base_name(F.col("path")))
    df = df.withColumn("__name", F.when(base == "", F.col("__title")).otherwise(base))
    df = df.withColumn("__stem", F.regexp_replace("__name", r"\.[^.]*$", F.lit("")))
    df = df.withColumn("__words", text.name_words(F.col("__name"))).withColumn("__base", text.name_words(text.rank_text(text.base_name(F.col("__path")))))
    df = df.withColumn("__preview", text.rank_text(F.col("preview")))
    return df.withColumn("__type", F.regexp_replace(F.lower(F.coalesce("file_type", F.lit(""))), r"^\.", ""))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def _cols(names: str) -> list[Column]:
    return [F.col(f"__{n}") for n in names.split()]


def _equal(names: str, q: str) -> Column:
    return _any([c == F.lit(q) for c in _cols(names)])


def _holds(names: str, q: str) -> Column:
    return _any([c.contains(F.lit(q)) for c in _cols(names)])


def _begins(names: str, q: str) -> Column:
    return _any([c.startswith(F.lit(q)) for c in _cols(names)])


def _ladder(*steps: tuple[Column, float]) -> Column:
    """The weight of the first step that holds."""
    out = F.when(steps[0][0], F.lit(steps[0][1]))
    for test, weight in steps[1:]:
        out = out.when(test, F.lit(weight))
    return out.otherwise(F.lit(0.0))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts, F.lit(0.0))


def exact_rule(p: Profile) -> Column:
    """Whole-query hits in title, name, path and preview."""
    if not p.query:
        return F.lit(0.0)
    q = p.query
    equal, within = _equal("title name stem words base", q), _holds("title name words", q)
    begins, stem, path = _begins("name words base", q), _begins("stem", q), _holds("path", q)
    parts = [_ladder((equal, -36.0), (within, -20.0)), _ladder((begins, -10.0)), _ladder((stem, -8.0)), _ladder((path, -8.0)), _ladder((_holds("preview", q), -2.0))]
    outside = [equal, within, begins, stem, path]
    if p.compact and p.compact != q:
        tight = _any([F.replace(c, F.lit(" "), F.lit("")).contains(F.lit(p.compact)) for c in _cols("title words")])
        parts.append(_ladder((tight, -14.0)))
        outside.append(tight)
    if p.filename:
        parts.append(_ladder((_equal("name stem", q), -80.0), (_begins("name stem", q), -30.0), (~_any(outside), 18.0)))
    return _sum(parts)


def token_rule(p: Profile) -> Column:
    """Hits of single words of the query."""
    parts = []
    for t in p.tokens:
        parts.append(_ladder((_equal("title name stem", t), -9.0), (_equal("words base", t), -8.0), (_begins("name words base", t), -5.5), (_holds("title name", t), -4.0), (_holds("words base", t), -3.6)))
        parts += [_ladder((_holds("path", t), -1.2)), _ladder((_holds("preview", t), -0.3))]
    return _sum(parts)


def folder_rule(p: Profile) -> Column:
    """A single clean word names a folder or a file."""
    if not p.bare or p.filename:
        return F.lit(0.0)
    q, folder = p.query, F.col("__type") == "folder"
    return _ladder((folder & _equal("name words", q), -60.0), (folder & _begins("name words", q), -25.0), (~folder & _equal("name stem words", q), -40.0), (~folder & _begins("name stem", q), -15.0))


def source_rule(p: Profile) -> Column:
    """Where the row comes from, against what the query asks for."""
    folder = F.col("__type") == "folder"
    as_folder = -6.0 if p.folder else 0.0 if p.bare else 1.2
    own = F.lit(-2.0 - (4.0 if p.filename else 0.0)) + (F.lit(-3.0) if p.file else _ladder((F.col("__path") != "", -3.0)))
    own = own + F.when(folder, F.lit(as_folder)).otherwise(F.lit(2.2 if p.folder else 0.0)) + _ladder((_any([F.col("__path").contains(x) for x in PERSONAL]), -1.5))
    rule = F.when(F.col("source") == "file", own).otherwise(F.lit(0.0))
    return F.when(F.col("source").isin(*BROWSERS), F.lit(-12.0)).otherwise(rule) if p.url else rule


def noisy_path(path: Column) -> Column:
    return _any([path.contains(x) for x in NOISY_PATHS])


def generated(type_: Column, name: Column) -> Column:
    """Assets that a build made."""
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    script = type_.isin("js", "mjs", "cjs", "css") & (_any([name.contains(x) for x in (".min.", ".bundle.", ".chunk.")]) | (dots >= 2))
    return type_.isin("map", "min", "bundle") | script


def noise_rule() -> Column:
    noisy, made = noisy_path(F.col("__path")), generated(F.col("__type"), F.col("__name"))
    return _sum([_ladder((noisy, 42.0)), _ladder((made, 8.0)), _ladder((noisy & made, 18.0))])


def freshness_rule(now: int) -> Column:
    age = F.lit(now) - F.col("updated_at")
    ladder = _ladder((age < 0, -0.5), (age <= 7 * DAY, -1.2), (age <= 30 * DAY, -0.8), (age <= 180 * DAY, -0.3), (age >= 3 * 365 * DAY, 0.4))
    return F.when((F.col("updated_at") > 0) & F.lit(now > 0), ladder).otherwise(F.lit(0.0))


def adjusted(df: DataFrame, search: str, now: int) -> DataFrame:
    """Candidates with the adjustment added to their score."""
    p = profile(search)
    total = _sum([exact_rule(p), token_rule(p), source_rule(p), folder_rule(p), noise_rule(), freshness_rule(now)])
    return features(df).withColumn("score", F.col("score") + total)


def dedupe_key() -> Column:
    """What makes two hits the same: path, title of a browser page, item, or title; null is the same as nothing."""
    browser = F.col("source").isin(*BROWSERS)
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    titled = F.concat_ws(":title:", F.col("source"), text.rank_text(F.col("title")))
    return (
        F.when(some("path"), F.concat(F.lit("path:"), text.normal_path(F.col("path"))))
        .when(browser & some("title"), titled)
        .when(some("item_id"), F.concat_ws(":", "source", "item_id"))
        .when(some("title"), titled)
    )




def order() -> list[Column]:
    return [F.col("score").asc(), F.col("updated_at").desc(), F.col("row_id").asc()]


def deduped(df: DataFrame) -> DataFrame:
    """The best row of each key; rows without a key all stay."""
    key = F.coalesce(dedupe_key(), F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    w = Window.partitionBy("__key").orderBy(*order())
    return df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def without_noise(df: DataFrame, search: str) -> DataFrame:
    return df if profile(search).noisy else df.where(~noisy_path(text.normal_path(F.col("path"))))


def page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page in order; `rank` counts from 1 over all pages."""
    top = df.orderBy(*order()).limit(offset + limit)
    w = Window.orderBy(*order())  # over one bounded page
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > offset)


def load_more(shown: DataFrame, more: DataFrame) -> DataFrame:
    """Pages put together; a row that is there already isn't added."""
    return shown.unionByName(more).dropDuplicates(["source", "item_id", "row_id"])
