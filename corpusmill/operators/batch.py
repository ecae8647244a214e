"""Many searches at once against all rows.

Requests that differ in nothing but number, limit and offset are one ask, and an ask's search string is evaluated once. The rows' terms are cut once and written to the shared folder;
tasks take them in pieces of at most PIECE terms, make an inverted index of each piece in memory and evaluate every search string on it, in two passes: the first counts in how many rows of
each shard every phrase stands, the second scores the matches and hands on no more rows of a piece than an ask's last page can show. So nothing is moved but counts and those rows.
Asks are dealt to the tasks in blocks of about BLOCK, so that neither the driver nor a task ever holds more; each block reads all rows.
Strings with ideographs are looked for by their grams first.

Defined results: null and blank strings, strings without searchable characters and invalid expressions give no rows; limits and offsets are those of a single search, but an offset
may be of any size, where a single search looks at no more than 5,000 rows of a shard.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import keys, text
from corpusmill.operators import index, match, query
from corpusmill.operators.query import COLUMNS, Near, Phrase
from corpusmill.session import settle, shared_dir

#: Asks evaluated in one pass over the rows; terms held in memory as one piece; rows handed on at once.
BLOCK, PIECE, OUT = 100_000, 5_000_000, 50_000
#: What the first pass counts besides phrases and grams: rows, their terms and their grams.
ROWS, TERMS, GRAMS = -1, -2, -3
NONE = (np.empty(0, np.int32), np.empty(0))
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
WEIGHT = np.array([match.WEIGHTS[c] for c in COLUMNS])


@lru_cache(maxsize=10_000)
def tree_of(search: str):
    """The tree of a search string; None if it is invalid or empty."""
    try:
        return query.parse(query.rewrite(search))
    except query.QuerySyntaxError:
        return None


@dataclass
class Plan:
    """Search strings with phrases, NEAR groups and grams by number.

    A tree is the number of a phrase, ("near", number), (operator, trees), or () for what never matches. A slot is what counts for the score, in order: (number of the phrase, None),
    or (number of the phrase, (number of the group, place in it)).
    """

    phrases: dict[Phrase, int] = field(default_factory=dict)
    nears: dict[tuple, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    queries: list[tuple] = field(default_factory=list)  # (tree, slots, grams, asks)

    def add(self, search: str, asks: list[tuple]) -> None:
        slots: list[tuple] = []
        tree = self._tree(tree_of(search), slots)
        grams = [self.grams.setdefault(g, len(self.grams)) for g in query.cjk_query(search)]
        if tree is not None or grams:
            self.queries.append((() if tree is None else tree, slots, grams, asks))

    def _phrase(self, p: Phrase) -> int:
        return self.phrases.setdefault(p, len(self.phrases))

    def _tree(self, node, slots: list[tuple]):
        if node is None:
            return None
        if isinstance(node, Near):
            group = [p for p in node.phrases if p.terms]
            if len(group) > 1:
                columns = tuple(c for c in COLUMNS if all(c in p.columns for p in group))
                numbers = tuple(map(self._phrase, group))
                near = self.nears.setdefault((tuple(group), node.gap, columns), len(self.nears))
                slots += [(n, (near, k)) for k, n in enumerate(numbers)]
                return ("near", near)
            node = group[0] if group else Phrase(())
        if isinstance(node, Phrase):
            if not node.terms or not node.columns:
                return None if not node.terms else ()
            slots.append((self._phrase(node), None))
            return slots[-1][0]
        parts = [self._tree(p, slots) for p in node.parts]
        if node.op == "not":
            return parts[0] if None in parts else ("not", parts)
        parts = [p for p in parts if p is not None]
        return (node.op, parts) if parts else None


def _among(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted `a` its place in the sorted `b`, and whether it is there; `b` isn't empty."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return at, b[at] == a


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) > len(b):
        a, b = b, a
    return a[_among(a, b)[1]] if len(a) else a


def _numbered(values: list[pa.DictionaryArray]) -> tuple[list[str], np.ndarray]:
    """The distinct values in order, and the number of each value."""
    coded = pa.chunked_array(values).unify_dictionaries().chunks
    known = coded[0].dictionary.to_pylist()
    order = sorted(range(len(known)), key=known.__getitem__)
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(len(known), dtype=np.int32)
    return [known[i] for i in order], rank[np.concatenate([c.indices.to_numpy() for c in coded])]


def _by_number(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each number stands, in order, and where those of each number begin."""
    return np.argsort(numbers, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=n))])


class Piece:
    """An inverted index of some rows (row_id, shard, source, file_type, updated_at, title, content, grams), in memory. Terms stand one behind another: a row's title, its content, the next row's."""

    def __init__(self, batches: list[pa.RecordBatch], coded: list[dict[str, tuple[np.ndarray, pa.DictionaryArray]]]):
        """Each batch with the lengths and values of its lists, which it needn't hold itself."""
        rows = pa.Table.from_batches(batches)
        col = {n: rows.column(n).combine_chunks() for n in rows.column_names}
        self.row_id, self.shards = col["row_id"].to_numpy(), col["shard"].to_numpy()
        self.source, self.file_type = (np.array(col[n].to_pylist(), object) for n in ("source", "file_type"))
        there = np.array(col["updated_at"].is_valid())
        at = col["updated_at"].fill_null(0).to_numpy()
        self.updated = col["updated_at"]
        self.since, self.until, self.late = np.where(there, at, LOW), np.where(there, at, HIGH), np.where(there, ~at, HIGH)
        lengths = np.stack([np.concatenate([c[n][0] for c in coded]) for n in COLUMNS], axis=1)
        self.terms = lengths.sum(axis=1)
        self.begin = np.concatenate([[0], np.cumsum(lengths.ravel())])
        self.segment = np.repeat(np.arange(lengths.size, dtype=np.int32), lengths.ravel())
        self.words, numbers = _numbered([c[n][1] for n in COLUMNS for c in coded])
        placed = np.empty(len(numbers), np.int32)
        # The terms of all titles come first, those of all contents behind them.
        placed[self.segment & 1 == 0], placed[self.segment & 1 == 1] = np.split(numbers, [lengths[:, 0].sum()])
        self.places, self.starts_of = _by_number(placed, len(self.words))
        self.n_grams = np.concatenate([c["grams"][0] for c in coded])
        self.gram_words, numbers = _numbered([c["grams"][1] for c in coded])
        self.gram_rows, self.gram_starts = _by_number(numbers, len(self.gram_words))
        self.gram_rows = np.repeat(np.arange(len(self.row_id), dtype=np.int32), self.n_grams)[self.gram_rows]

    def at(self, term: str, prefix: bool) -> np.ndarray:
        """Places of a term, in order."""
        lo = bisect_left(self.words, term)
        # Behind all words that begin with the term: no word holds the last code point.
        hi = bisect_left(self.words, term + "\U0010ffff", lo) if prefix else lo + (lo < len(self.words) and self.words[lo] == term)
        out = self.places[self.starts_of[lo] : self.starts_of[hi]]
        return np.sort(out) if hi - lo > 1 else out

    def starts(self, p: Phrase, columns: tuple[str, ...]) -> np.ndarray:
        """Places at which the phrase begins in these columns."""
        last = len(p.terms) - 1
        out = self.at(p.terms[0], p.prefix and last == 0)
        for k in range(1, last + 1):
            later = self.at(p.terms[k], p.prefix and k == last) if len(out) else out
            if not len(later):
                return later
            out = out[_among(out + k, later)[1]]
            out = out[self.segment[out] == self.segment[out + k]]
        if len(columns) < len(COLUMNS):
            out = out[np.isin(self.segment[out] & 1, [COLUMNS.index(c) for c in columns])]
        return out[self.begin[self.segment[out]] == out] if p.first else out

    def weighed(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the places, and the weight of those of each."""
        if not len(places):
            return NONE
        segment = self.segment[places]
        row = segment >> 1
        cut = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
        return row[cut], np.add.reduceat(WEIGHT[segment & 1], cut)

    def phrase(self, p: Phrase) -> tuple[np.ndarray, np.ndarray]:
        return self.weighed(self.starts(p, p.columns))

    def near(self, phrases: tuple[Phrase, ...], gap: int, columns: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each phrase of a group, as `phrase`, its hits that have every other phrase within the gap."""
        hits = [self.starts(p, columns) for p in phrases]
        if not all(map(len, hits)):
            return [NONE] * len(hits)
        out = []
        for i, h in enumerate(hits):
            for j, other in enumerate(hits):
                if i != j:
                    a, b = len(phrases[i].terms), len(phrases[j].terms)
                    k = np.searchsorted(other, h, "right")
                    after, before = other[np.minimum(k, len(other) - 1)], other[np.maximum(k - 1, 0)]
                    ok = (k < len(other)) & (self.segment[after] == self.segment[h]) & (after - h - a <= gap)
                    h = h[ok | (k > 0) & (self.segment[before] == self.segment[h]) & (h - before - b <= gap)]
            out.append(self.weighed(h))
        return out

    def gram(self, g: str) -> np.ndarray:
        """The rows of a gram."""
        k = bisect_left(self.gram_words, g)
        return self.gram_rows[self.gram_starts[k] : self.gram_starts[k + 1]] if k < len(self.gram_words) and self.gram_words[k] == g else NONE[0]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    """Pieces of at least PIECE terms, but the last. Terms are held as numbers from the start, which take a third of the memory."""
    lists = [*COLUMNS, "grams"]
    held, n = ([], []), 0
    for b in batches:
        coded = {c: (b.column(c).value_lengths().to_numpy(), b.column(c).flatten().dictionary_encode()) for c in lists}
        # Taken, as a slice would keep the whole batch.
        held[0].append(b.drop_columns(lists).take(pa.array(range(len(b)), pa.int64())))
        held[1].append(coded)
        n += sum(len(coded[c][1]) for c in COLUMNS)
        if n >= PIECE:
            full, held, n = held, ([], []), 0
            del coded
            piece = Piece(*full)
            del full
            pa.default_memory_pool().release_unused()
            yield piece
            del piece
    if sum(map(len, held[0])):
        yield Piece(*held)


def _counts(piece: Piece, plan: Plan) -> pa.RecordBatch:
    """(what, shard, n): in how many rows each phrase stands, and each gram behind them, and sums over the rows."""
    shards, own = np.unique(piece.shards, return_inverse=True)
    found = chain(((k, piece.phrase(p)[0]) for p, k in plan.phrases.items()), ((len(plan.phrases) + k, piece.gram(g)) for g, k in plan.grams.items()))
    what, n = [], []
    for k, rows in found:
        if len(rows):
            what.append(k)
            n.append(np.bincount(own[rows], minlength=len(shards)))
    what += [ROWS, TERMS, GRAMS]
    n += [np.bincount(own, minlength=len(shards)), np.bincount(own, piece.terms, len(shards)).astype(np.int64), np.bincount(own, piece.n_grams, len(shards)).astype(np.int64)]
    n = np.concatenate(n)
    some = n > 0
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(what, np.int32), len(shards))[some]), pa.array(np.tile(shards, len(what)).astype(np.int32)[some]), pa.array(n.astype(np.int64)[some])], names=["what", "shard", "n"])


@dataclass
class Statistics:
    """Of each shard: the number of its rows, their mean lengths, and the weight of each phrase and, behind them, of each gram."""

    shards: np.ndarray
    terms: np.ndarray
    grams: np.ndarray
    idf: np.ndarray

    @staticmethod
    def of(counts: pa.Table, n: int) -> Statistics:
        what, shard, count = (counts.column(c).to_numpy() for c in ("what", "shard", "n"))
        shards = np.unique(shard)
        every = np.zeros((n + 3, len(shards)))
        every[what, np.searchsorted(shards, shard)] = count  # the last three are ROWS, TERMS and GRAMS
        rows = every[ROWS]
        raw = np.log((rows - every[:n] + 0.5) / (every[:n] + 0.5))
        return Statistics(shards, every[TERMS] / rows, every[GRAMS] / rows, np.where(raw <= 0, match.LEAST_IDF, raw).astype(np.float64))


class Hits:
    """Matches of search strings in a piece."""

    def __init__(self, piece: Piece, plan: Plan, known: Statistics):
        self.piece, self.known, self.n = piece, known, len(plan.phrases)
        self.phrases, self.nears, self.grams = list(plan.phrases), list(plan.nears), list(plan.grams)
        self.shard = np.searchsorted(known.shards, piece.shards)
        self.done: dict = {}
        self.done_near: dict = {}
        self.done_gram: dict = {}

    def phrase(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.done:
            self.done[k] = self.piece.phrase(self.phrases[k])
        return self.done[k]

    def near(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if k not in self.done_near:
            self.done_near[k] = self.piece.near(*self.nears[k])
        return self.done_near[k]

    def gram(self, k: int) -> np.ndarray:
        if k not in self.done_gram:
            self.done_gram[k] = self.piece.gram(self.grams[k])
        return self.done_gram[k]

    def rows(self, tree) -> np.ndarray:
        """The rows that match, in order."""
        if isinstance(tree, int):
            return self.phrase(tree)[0]
        if not tree:
            return NONE[0]
        op, parts = tree
        if op == "near":
            return self.all([r for r, _ in self.near(parts)])
        if op == "and":
            each = []
            for p in parts:
                each.append(self.rows(p))
                if not len(each[-1]):
                    return NONE[0]
            return self.all(each)
        each = [self.rows(p) for p in parts]
        if op == "or":
            return np.unique(np.concatenate(each))
        left, right = each
        return left[~_among(left, right)[1]] if len(left) and len(right) else left

    @staticmethod
    def all(each: list[np.ndarray]) -> np.ndarray:
        each = sorted(each, key=len)
        out = each[0]
        for r in each[1:]:
            out = _both(out, r)
        return out

    def scored(self, tree, slots: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows(tree)
        if not len(rows):
            return NONE
        shard, total = self.shard[rows], np.zeros(len(rows))
        terms, mean = self.piece.terms[rows], self.known.terms[shard]
        for k, group in slots:
            own, weight = self.phrase(k) if group is None else self.near(group[0])[group[1]]
            if len(own):
                at, there = _among(rows, own)
                total = total + self.known.idf[k, shard] * match.bm25(np.where(there, weight[at], 0.0), terms, mean)
        return rows, -total

    def scored_grams(self, grams: list[int]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.gram(g) for g in grams]
        rows = self.all(each) if each and all(map(len, each)) else NONE[0]
        if not len(rows):
            return NONE
        shard = self.shard[rows]
        once = match.bm25(1.0, self.piece.n_grams[rows], self.known.grams[shard])
        return rows, -sum((self.known.idf[self.n + g, shard] * once for g in grams), np.zeros(len(rows)))

    def first(self, rows: np.ndarray, score: np.ndarray, asks: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each ask, the best of the rows that pass its filters, and their scores."""
        p = self.piece
        order = np.lexsort((p.row_id[rows], p.late[rows], score))
        rows, score = rows[order], score[order]
        out = []
        for _, source, kind, since, until, most in asks:
            ok = None
            for test in ((p.source[rows] == source) if source else None, (p.file_type[rows] == kind) if kind else None, (p.since[rows] >= since) if since else None, (p.until[rows] <= until) if until else None):
                if test is not None:
                    ok = test if ok is None else ok & test
            at = slice(most) if ok is None else np.flatnonzero(ok)[:most]
            out.append((rows[at], score[at]))
        return out


_PAGE = "ask bigint, most bigint, row_id bigint, score double, updated_at bigint, gram boolean"


def _page(piece: Piece, plan: Plan, known: Statistics) -> Iterator[pa.RecordBatch]:
    """The rows of a piece that each ask may show: those of the gram index or, if it has none here, all others."""
    hits = Hits(piece, plan, known)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        rows = np.concatenate([h[2] for h in held])
        n = [len(h[2]) for h in held]
        each = [np.repeat(np.array([h[i] for h in held], np.int64), n) for i in (0, 1)]
        gram = np.repeat(np.array([h[4] for h in held]), n)
        return pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(piece.row_id[rows]), pa.array(np.concatenate([h[3] for h in held])), piece.updated.take(pa.array(rows)), pa.array(gram)], names=["ask", "most", "row_id", "score", "updated_at", "gram"])

    n = 0
    for tree, slots, grams, asks in plan.queries:
        left = asks
        for gram in (True, False):
            rows, score = (hits.scored_grams(grams) if grams else NONE) if gram else hits.scored(tree, slots) if left else NONE
            if not len(rows):
                continue
            best = hits.first(rows, score, left)
            for a, (r, s) in zip(left, best):
                if len(r):
                    held.append((a[0], a[-1], r, s, gram))
                    n += len(r)
            left = [a for a, (r, _) in zip(left, best) if not len(r)]
            if n >= OUT:
                yield batch()
                held, n = [], 0
    if held:
        yield batch()


def _block(terms: DataFrame, asks: DataFrame) -> DataFrame:
    """The rows of a block of asks, from every piece."""
    sc = terms.sparkSession.sparkContext
    plan, by = Plan(), {}
    for a in asks.select("query", "ask", "source", "file_type", "since_at", "until_at", "most").toArrow().to_pylist():
        by.setdefault(a.pop("query"), []).append(tuple(a.values()))
    for q, own in by.items():
        plan.add(q, own)
    sent = sc.broadcast(plan)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(partial(_counts, plan=sent.value), _pieces(batches))

    counts = terms.mapInArrow(count, "what int, shard int, n bigint").groupBy("what", "shard").agg(F.sum("n").alias("n")).toArrow()
    known = sc.broadcast(Statistics.of(counts, len(plan.phrases) + len(plan.grams)))

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # No piece is held here while the next one is made.
        yield from chain.from_iterable(map(partial(_page, plan=sent.value, known=known.value), _pieces(batches)))

    return terms.mapInArrow(page, _PAGE)


def _terms(chunks: DataFrame) -> DataFrame:
    """The rows' terms and grams, cut once and kept in the shared folder."""
    spark = chunks.sparkSession
    grams = text.cjk_grams(text.gram_text(F.col("title"), F.col("content"), F.col("preview")))
    rows = chunks.where("row_id is not null").select(F.col("row_id").cast("bigint").alias("row_id"), keys.rowid_shard(F.col("row_id")).alias("shard"), "source", "file_type", "updated_at", text.terms(F.col("title")).alias("title"), text.terms(F.col("content")).alias("content"), grams.alias("grams"))
    at = f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def search_rows(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, rank, row_id, score): the page of each request (request_id, query, source, file_type, since_at, until_at, max_rows, skip_rows) by its score."""
    asked = requests.where("query is not null").withColumn("query", F.trim("query")).where("query != ''")
    limit = F.when(F.coalesce("max_rows", F.lit(0)) <= 0, F.lit(50)).otherwise(F.least("max_rows", F.lit(200))).cast("bigint")
    same = ["query", "source", "file_type", "since_at", "until_at"]
    filters = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "file_type")] + [F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint").alias(c) for c in ("since_at", "until_at")]
    asked = asked.select("request_id", "query", *filters, limit.alias("limit"), F.greatest(F.coalesce("skip_rows", F.lit(0)), F.lit(0)).cast("bigint").alias("offset"))
    asks = settle(asked.groupBy(*same).agg(F.max(F.col("limit") + F.col("offset")).alias("most")).withColumn("ask", F.monotonically_increasing_id()))
    terms = _terms(chunks)
    blocks = max(1, math.ceil(asks.count() / BLOCK))
    found = [_block(terms, asks.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)) for b in range(blocks)]
    page = found[0]
    for f in found[1:]:
        page = page.unionByName(f)
    # Hits of the gram index come before all others, and those stand only where it has none.
    w = Window.partitionBy("ask").orderBy(F.desc("gram"), F.col("score"), F.desc("updated_at"), F.col("row_id"))
    page = page.withColumn("rank", F.row_number().over(w)).where("rank <= most").withColumn("first", F.max("gram").over(Window.partitionBy("ask"))).where("gram = first")
    wanted = asked.join(asks.select("ask", *same), same).select("request_id", "ask", "limit", "offset")
    return wanted.join(page, "ask").where("rank > offset and rank <= offset + limit").select("request_id", "rank", "row_id", "score")


def search_many(stored: index.Index, requests: DataFrame) -> DataFrame:
    """As `search_rows`, against the rows of an index."""
    return search_rows(stored.chunks(), requests)
