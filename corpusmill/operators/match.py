"""Evaluating a parsed search expression and scoring what it matches.

Every phrase becomes an array expression over the positions of a row's own terms, so matching needs no shuffle of its own; the document frequencies are one
aggregation to SHARDS rows. Positions come from the texts (`scored`), or from stored postings (`scored_stored`), which then are all that is read:
the postings of the expression's terms, grouped by row, and the lengths and counts that were stored with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import keys, text
from corpusmill.operators import index
from corpusmill.operators.query import COLUMNS, Near, Phrase

K1, B = 1.2, 0.75
#: Weight of a hit in the title and in the content.
WEIGHTS = {"title": 8.0, "content": 1.0}
LEAST_IDF = 1e-6


def _at(tokens: Column, word: str, prefix: bool) -> Column:
    """Positions of a term."""

    def same(t: Column) -> Column:
        return t.startswith(F.lit(word)) if prefix else t == F.lit(word)

    return F.filter(F.transform(tokens, lambda t, i: F.when(same(t), i)), lambda p: p.isNotNull())


def _followed(hits: Column, later: Column, k: int) -> Column:
    return F.filter(hits, lambda p: F.array_contains(later, p + F.lit(k)))


def in_text(column: str, word: str, prefix: bool) -> Column:
    """Positions of a term in the terms of a text."""
    return _at(F.col(f"{column}_terms"), word, prefix)


def in_postings(column: str, word: str, prefix: bool) -> Column:
    """Positions of a term in a row's postings, an array of (col, token, positions)."""
    number = COLUMNS.index(column)
    mine = F.filter("__postings", lambda x: (x["col"] == number) & (x["token"].startswith(word) if prefix else x["token"] == word))
    return F.array_sort(F.flatten(F.transform(mine, lambda x: x["positions"])))


def starts(at, column: str, phrase: Phrase) -> Column:
    """Positions at which the phrase begins; `at` gives those of a term."""
    last = len(phrase.terms) - 1
    out = at(column, phrase.terms[0], phrase.prefix and last == 0)
    for k in range(1, last + 1):
        out = _followed(out, at(column, phrase.terms[k], phrase.prefix and k == last), k)
    return F.filter(out, lambda p: p == 0) if phrase.first else out


def _close(hits: Column, other: Column, length: int, other_length: int, gap: int) -> Column:
    """Those of the hits that have one of the other phrase with at most `gap` terms between."""

    def near(p: Column) -> Column:
        return F.exists(other, lambda q: F.when(q > p, q - p - F.lit(length)).otherwise(p - q - F.lit(other_length)) <= F.lit(gap))

    return F.filter(hits, near)


def near_starts(at, column: str, group: Near) -> list[Column]:
    """For each phrase of the group, its hits that have every other phrase within the gap."""
    hits = [starts(at, column, p) for p in group.phrases]
    out = []
    for i, h in enumerate(hits):
        for j, other in enumerate(hits):
            if j != i:
                h = _close(h, other, len(group.phrases[i].terms), len(group.phrases[j].terms), group.gap)
        out.append(h)
    return out


class Matcher:
    """Columns that say whether a row matches and how often each phrase hits."""

    def __init__(self, tree, at=in_text):
        self.at = at
        self.hits: list[dict[str, Column]] = []  # of each phrase, per column, as they count for the score
        self.alone: list[dict[str, Column]] = []  # of each phrase by itself, for its document frequency
        self.phrases: list[Phrase] = []
        self.matched = self._walk(tree)

    def _add(self, phrase: Phrase, hits: dict[str, Column], alone: dict[str, Column]) -> Column:
        self.phrases.append(phrase)
        self.hits.append(hits)
        self.alone.append(alone)
        return F.col(f"__f{len(self.hits) - 1}") > 0

    def _walk(self, node) -> Column | None:
        if isinstance(node, Phrase):
            if not node.terms or not node.columns:
                return None if not node.terms else F.lit(False)
            h = {c: F.size(starts(self.at, c, node)) for c in node.columns}
            return self._add(node, h, h)
        if isinstance(node, Near):
            if len(node.phrases) == 1:
                return self._walk(node.phrases[0])
            cols = [c for c in COLUMNS if all(c in p.columns for p in node.phrases)]
            near = {c: near_starts(self.at, c, node) for c in cols}
            tests = []
            for i, p in enumerate(node.phrases):
                tests.append(self._add(p, {c: F.size(near[c][i]) for c in cols}, {c: F.size(starts(self.at, c, p)) for c in p.columns}))
            return reduce(lambda x, y: x & y, tests)
        parts = [self._walk(p) for p in node.parts]
        if node.op == "not":
            left, right = parts
            return left if right is None or left is None else left & ~right
        parts = [p for p in parts if p is not None]
        if not parts:
            return None
        return reduce((lambda x, y: x & y) if node.op == "and" else (lambda x, y: x | y), parts)

    def apply(self, analyzed: DataFrame) -> DataFrame:
        """Rows with __f<i>, the weighted hits of phrase i, __d<i>, whether it stands there by itself, and __match."""
        weigh = lambda h: reduce(lambda x, y: x + y, [F.lit(WEIGHTS[c]) * n for c, n in h.items()], F.lit(0.0))
        df = analyzed.select("*", *[weigh(h).alias(f"__f{i}") for i, h in enumerate(self.hits)], *[(weigh(h) > 0).alias(f"__d{i}") for i, h in enumerate(self.alone)])
        return df.withColumn("__match", self.matched if self.matched is not None else F.lit(False))


def idf(n_docs: Column, n: Column) -> Column:
    raw = F.log((n_docs - n + 0.5) / (n + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def bm25(f: Column, length: Column, mean: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def every_phrase(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node] if node.terms else []
    return [p for n in (node.phrases if isinstance(node, Near) else node.parts) for p in every_phrase(n)]


def finished(rows: DataFrame, m: Matcher, stats: DataFrame) -> DataFrame:
    """Rows that match, with their score; `stats` has __scope, __n, __mean and __n<i> of each phrase, one row per shard, SHARDS at most."""
    n = range(len(m.hits))
    hit = rows.where("__match").join(F.broadcast(stats), "__scope")
    score = reduce(lambda x, y: x + y, [idf(F.col("__n"), F.col(f"__n{i}")) * bm25(F.col(f"__f{i}"), F.col("terms"), F.col("__mean")) for i in n], F.lit(0.0))
    return hit.withColumn("score", -score).drop("__scope", "__match", "__n", "__mean", *[f"__{x}{i}" for i in n for x in "fdn"])


def scored(chunks: DataFrame, tree, scope: str = "shard") -> DataFrame:
    """Matching chunks with their score; lower is better. Statistics are those of the row's shard or of all rows. The texts are read whole."""
    if tree is None:
        return index.analyzed(chunks).where("false").withColumn("score", F.lit(0.0)).drop("title_terms", "content_terms")
    m = Matcher(tree)
    rows = m.apply(index.analyzed(chunks)).withColumn("__scope", F.col("shard") if scope == "shard" else F.lit(0)).drop("title_terms", "content_terms")
    stats = rows.groupBy("__scope").agg(F.count(F.lit(1)).alias("__n"), F.avg("terms").alias("__mean"), *[F.count_if(f"__d{i}").alias(f"__n{i}") for i in range(len(m.hits))])
    return finished(rows, m, stats)


def scored_stored(stored: index.Index, tree, scope: str = "shard") -> DataFrame:
    """As `scored`, from an index: (row_id, shard, terms, score) of the matching rows. Only the postings of the expression's terms are read."""
    if tree is None:
        return stored.table("postings").where("false").select("row_id", "shard", "terms", F.lit(0.0).alias("score"))
    tests = [F.col("token").startswith(t) if p.prefix and k == len(p.terms) - 1 else F.col("token") == t for p in every_phrase(tree) for k, t in enumerate(p.terms)]
    own = stored.table("postings").where(reduce(lambda x, y: x | y, tests, F.lit(False)))
    # A row's postings of the terms of one expression: no more than the row has terms.
    rows = own.groupBy("shard", "row_id").agg(F.collect_list(F.struct("col", "token", "positions")).alias("__postings"), F.first("terms").alias("terms"))
    m = Matcher(tree, in_postings)
    rows = m.apply(rows).drop("__postings").withColumn("__scope", F.col("shard") if scope == "shard" else F.lit(0))
    counts = rows.groupBy("__scope").agg(*[F.count_if(f"__d{i}").alias(f"__n{i}") for i in range(len(m.hits))])
    known = stored.table("stats").withColumn("__scope", F.col("shard") if scope == "shard" else F.lit(0)).groupBy("__scope")
    known = known.agg(F.sum("n_docs").alias("__n"), (F.sum(F.col("n_docs") * F.col("avg_len")) / F.sum("n_docs")).alias("__mean"))
    return finished(rows, m, known.join(counts, "__scope"))


def gram_score(n: int) -> Column:
    each = [idf(F.col("__n"), F.col(f"__n{i}")) * bm25(F.lit(1.0), F.col("terms"), F.col("__mean")) for i in range(n)]
    return -reduce(lambda x, y: x + y, each, F.lit(0.0))


def scored_grams(chunks: DataFrame, grams: list[str]) -> DataFrame:
    """Chunks that hold all grams, scored on grams alone."""
    own = text.cjk_grams(text.gram_text(F.col("title"), F.col("content"), F.col("preview")))
    rows = chunks.withColumn("shard", keys.rowid_shard(F.col("row_id"))).withColumn("__g", own).withColumn("terms", F.size("__g"))
    rows = rows.select("*", *[F.array_contains("__g", g).alias(f"__d{i}") for i, g in enumerate(grams)]).drop("__g")
    stats = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("__n"), F.avg("terms").alias("__mean"), *[F.count_if(f"__d{i}").alias(f"__n{i}") for i in range(len(grams))])
    hit = rows.where(reduce(lambda x, y: x & y, [F.col(f"__d{i}") for i in range(len(grams))], F.lit(bool(grams)))).join(F.broadcast(stats), "shard")
    return hit.withColumn("score", gram_score(len(grams))).drop("__n", "__mean", *[f"__{x}{i}" for i in range(len(grams)) for x in "dn"])


def scored_grams_stored(stored: index.Index, grams: list[str]) -> DataFrame:
    """As `scored_grams`, from an index: (row_id, shard, terms, score); only the postings of the grams are read."""
    own = stored.table("grams").where(F.col("token").isin(grams) if grams else F.lit(False))
    rows = own.groupBy("shard", "row_id").agg(F.collect_set("token").alias("__g"), F.first("terms").alias("terms"))
    rows = rows.select("shard", "row_id", "terms", *[F.array_contains("__g", g).alias(f"__d{i}") for i, g in enumerate(grams)])
    counts = rows.groupBy("shard").agg(*[F.count_if(f"__d{i}").alias(f"__n{i}") for i in range(len(grams))] or [F.lit(0).alias("__none")])
    known = stored.table("stats").select("shard", F.col("n_docs").alias("__n"), F.col("avg_grams").alias("__mean"))
    hit = rows.where(reduce(lambda x, y: x & y, [F.col(f"__d{i}") for i in range(len(grams))], F.lit(bool(grams)))).join(F.broadcast(known.join(counts, "shard")), "shard")
    return hit.select("row_id", "shard", "terms", gram_score(len(grams)).alias("score"))


def filtered(df: DataFrame, source: str | None = None, file_type: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """The filters of a request; empty, null and values not above zero are inactive."""
    if source:
        df = df.where(F.col("source") == source)
    if file_type:
        df = df.where(F.col("file_type") == file_type)
    if since and since > 0:
        df = df.where(F.col("updated_at") >= since)
    if until and until > 0:
        df = df.where(F.col("updated_at") <= until)
    return df


def limits(limit: int | None, offset: int | None) -> tuple[int, int, int]:
    """(limit, offset, candidates per shard)."""
    limit = 50 if not limit or limit <= 0 else min(limit, 200)
    offset = max(offset or 0, 0)
    return limit, offset, min(max(4 * (limit + offset), 80), 5000)


def shard_top(df: DataFrame, k: int) -> DataFrame:
    """The best k of each shard; Spark keeps k rows per task before it moves any."""
    w = Window.partitionBy("shard").orderBy("score", F.desc("updated_at"), "row_id")
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
