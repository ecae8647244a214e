"""Near-duplicate texts by covering locality-sensitive hashing (problem 5).

A text's signature is a row of minimum hashes of its sequences of adjacent words, packed into one bit string. Structured bit masks
select parts of it: the positions of a block of 2^(r+1)-1 symbols are the non-zero vectors of F2^(r+1), and for each
non-zero vector v there is a mask that keeps the positions whose product with v is 1. Any r differing positions leave some v orthogonal
to all of them, so every pair within radius r of some block collides in some table: none within the radius can be missed. BLOCKS
independent blocks make the chance that a pair of the least similarity is outside the radius in all of them negligible (it is
stated by `miss_probability`). Colliding pairs are then checked exactly on their word sequences.

Texts with equal sets of sequences are collapsed to one representative before anything is hashed into tables, so a group of
copies that holds a third of all rows costs one row per partition; pairs are found between representatives and expanded at the end, as the
result asks for rows. Tables are joined on (table, key) by sort and merge, where adaptive execution splits skewed keys; nothing is collected
per group, capped or dropped.

Defined results: null and short texts (fewer than MIN_WORDS words) are no members; rows of one item are no pair, rows with null items are one item;
copies count with each of their ids; texts are read whole; empty tables give no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import settle

#: Words of a sequence, least words of a member, least similarity: the values of the stated query.
ADJACENT, MIN_WORDS, SIMILAR = 3, 80, 0.6
#: Radius covered within a block, and independent blocks.
RADIUS, BLOCKS = 2, 7
WORD = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]|[^\\W_㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]+")
SEED = 20240229


def masks(radius: int = RADIUS) -> list[list[int]]:
    """For each table of a block, the positions its mask keeps."""
    n = 2 ** (radius + 1) - 1
    return [[i - 1 for i in range(1, n + 1) if bin(i & v).count("1") % 2] for v in range(1, n + 1)]


def miss_probability(similarity: float, radius: int = RADIUS, blocks: int = BLOCKS) -> float:
    """Chance that a pair differs in more than `radius` positions of every block, an upper bound of the chance to miss it."""
    n, d = 2 ** (radius + 1) - 1, 1 - similarity
    return (1 - sum(comb(n, k) * d**k * (1 - d) ** (n - k) for k in range(radius + 1))) ** blocks


class Sketcher:
    """Word sequences and signatures of texts."""

    def __init__(self, adjacent: int, radius: int, blocks: int):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.np, self.adjacent = np, adjacent
        self.symbols = blocks * (2 ** (radius + 1) - 1)
        self.mul = rng.integers(1, 1 << 63, size=self.symbols, dtype=np.uint64)[:, None] | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, size=self.symbols, dtype=np.uint64)[:, None]
        self.mix = rng.integers(1, 1 << 63, size=adjacent, dtype=np.uint64) | np.uint64(1)
        n = 2 ** (radius + 1) - 1
        self.words: dict[str, int] = {}

    def words_of(self, text: str) -> list[str]:
        return WORD.findall(text.lower())

    def shingles(self, words: list[str]):
        """Distinct hashes of the sequences of adjacent words, sorted."""
        import xxhash

        np, memory = self.np, self.words
        if len(memory) > 500_000:
            memory.clear()
        ids = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = memory.get(w)
            if h is None:
                h = memory[w] = xxhash.xxh64_intdigest(w)
            ids[i] = h
        n = len(words) - self.adjacent + 1
        if n < 1:
            return np.empty(0, dtype=np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.adjacent):
            h = (h ^ ids[k : k + n]) * self.mix[k]
            h ^= h >> np.uint64(29)
        return np.unique(h)

    def signature(self, shingles):
        """The minimum of each random hash over the sequences, 32 bits of each."""
        np = self.np
        low = np.full(self.symbols, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(shingles), 4096):  # bounded memory for very long texts
            x = shingles[None, i : i + 4096] * self.mul + self.add
            x ^= x >> np.uint64(31)
            low = np.minimum(low, (x * self.mul).min(axis=1))
        return ((low ^ (low >> np.uint64(29))) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)

    def sketch(self, signature):
        """Two bits of each symbol, 31 symbols to a word: a filter of colliding pairs that travels with the keys."""
        np = self.np
        bits = (signature.view(np.uint32).astype(np.uint64) >> np.uint64(7)) & np.uint64(3)
        parts = (bits[i : i + 31] for i in range(0, len(bits), 31))
        return [int((x << (np.arange(len(x), dtype=np.uint64) * np.uint64(2))).sum(dtype=np.uint64)) for x in parts]


def agreeing(x: Column, y: Column, symbols: int) -> Column:
    """Symbols that are equal in the sketches of two texts."""

    def differ(i: int) -> Column:
        d = F.element_at(x, i + 1).bitwiseXOR(F.element_at(y, i + 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return F.lit(symbols) - sum(differ(i) for i in range(-(-symbols // 31)))


def least_agreeing(similarity: float, symbols: int) -> int:
    """Agreeing symbols that a pair of the similarity falls short of about once in twenty thousand pairs."""
    p = similarity + (1 - similarity) / 4
    return max(0, int(symbols * p - 3.9 * (symbols * p * (1 - p)) ** 0.5))


def table_keys(signature: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """The key of each table: the symbols that the table's mask keeps, with the table's number."""
    n = 2 ** (radius + 1) - 1
    symbol = lambda i: F.element_at(signature, i + 1)
    return F.array(*[F.xxhash64(F.lit(b * n + t), *[symbol(b * n + i) for i in keep]) for b in range(blocks) for t, keep in enumerate(masks(radius))])


def signatures(chunks: DataFrame, adjacent: int = ADJACENT, min_words: int = MIN_WORDS, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(row_id, item, set1, set2, n, w, signature) of the members; set1 and set2 name the set of n sequences by 128 bits, w is its sketch, item the item_id by 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        s = Sketcher(adjacent, radius, blocks)
        for b in batches:
            at, one, two, size, sketch, signed = [], [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                words = s.words_of(t)
                if len(words) < min_words:
                    continue
                h = s.shingles(words)
                d = xxhash.xxh128_intdigest(h.tobytes())
                at.append(i)
                one.append(d >> 64)
                two.append(d & ((1 << 64) - 1))
                size.append(len(h))
                signed.append(s.signature(h))
                sketch.append(s.sketch(signed[-1]))
            part = b.take(pa.array(at, pa.int64()))
            flat = pa.array(np.concatenate(signed) if signed else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * s.symbols), flat)
            sets = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sets, pa.array(size, pa.int32()), pa.array(sketch, pa.list_(pa.int64())), lists], names=["row_id", "item", "set1", "set2", "n", "w", "signature"])

    item = F.when(F.col("item_id").isNotNull(), F.xxhash64("item_id"))
    rows = chunks.select("row_id", item.alias("item"), "content").where(F.length("content") >= min_words)
    return rows.mapInArrow(run, f"row_id {chunks.schema['row_id'].dataType.simpleString()}, item bigint, set1 bigint, set2 bigint, n int, w array<bigint>, signature array<int>")


def shingle_sets(chunks: DataFrame, adjacent: int = ADJACENT) -> DataFrame:
    """(row_id, shingles array<bigint>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        s = Sketcher(adjacent, 1, 1)
        for b in batches:
            sets = [s.shingles(s.words_of(t)).view(np.int64) for t in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["row_id", "shingles"])

    return chunks.select("row_id", "content").mapInArrow(run, f"row_id {chunks.schema['row_id'].dataType.simpleString()}, shingles array<bigint>")


def similar_sets(chunks: DataFrame, least: float = SIMILAR, adjacent: int = ADJACENT, min_words: int = MIN_WORDS, blocks: int = BLOCKS, sketch: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members (row_id, item, rep) and pairs (a, b, similarity) of representatives of different sets, a < b; colliding pairs are checked exactly. More `blocks` miss fewer (`miss_probability`).

    With `sketch`, colliding pairs are filtered before their sets are read by a sketch that travels with the keys, at a loss of about 1 in 20,000 pairs at the least similarity; without it, all are read.
    """
    signed = settle(signatures(chunks, adjacent, min_words, blocks=blocks))
    reps = settle(signed.groupBy("set1", "set2").agg(F.min("row_id").alias("rep")))
    members = signed.select("row_id", "item", "set1", "set2").join(reps, ["set1", "set2"]).select("row_id", "item", "rep")
    own = signed.select(F.col("row_id").alias("rep"), "n", "w", "signature").join(reps.select("rep"), "rep", "left_semi")
    entry = own.select(F.explode(table_keys(F.col("signature"), blocks=blocks)).alias("key"), "rep", "n", *["w"] * sketch)
    # The tables are joined with themselves by sort and merge: both sides are one exchange, and adaptive execution splits a key that many texts share.
    x, y = (entry.select("key", F.struct("rep", "n", *["w"] * sketch).alias(r)).hint("merge") for r in "ab")
    # Sets of too different sizes can't be similar enough; that loses nothing.
    pair = (F.col("a.rep") < F.col("b.rep")) & (F.least("a.n", "b.n") >= F.lit(least) * F.greatest("a.n", "b.n"))
    if sketch:
        symbols = blocks * (2 ** (RADIUS + 1) - 1)
        pair &= agreeing(F.col("a.w"), F.col("b.w"), symbols) >= least_agreeing(least, symbols)
    found = x.join(y, "key").where(pair).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    found = settle(found)
    ends = found.select(F.col("a").alias("row_id")).union(found.select("b")).distinct()
    sets = settle(shingle_sets(chunks.join(ends, "row_id", "left_semi"), adjacent).dropDuplicates(["row_id"]))
    left, right = sets.select(F.col("row_id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("row_id").alias("b"), F.col("shingles").alias("sb"))
    both = found.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    similarity = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))
    return members, both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def found_rows(chunks: DataFrame, least: float = SIMILAR, adjacent: int = ADJACENT, min_words: int = MIN_WORDS, blocks: int = BLOCKS, sketch: bool = True) -> DataFrame:
    """Distinct pairs (row_id_a, row_id_b) of rows of different items; copies are expanded, as the result is stated in rows. `groups` is the form without that."""
    members, pairs = similar_sets(chunks, least, adjacent, min_words, blocks, sketch)
    members = members.select("rep", F.struct("row_id", "item").alias("m"))
    x, y = members.select(F.col("rep").alias("a"), F.col("m").alias("x")), members.select(F.col("rep").alias("b"), F.col("m").alias("y"))
    between = pairs.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    # Copies: only groups with rows of two items have pairs.
    several = members.groupBy("rep").agg(F.min("m.item").alias("lo"), F.max("m.item").alias("hi"), F.count("m.item").alias("k"), F.count(F.lit(1)).alias("n"))
    several = several.where("n > 1 and (lo != hi or (k > 0 and k < n))").select(F.col("rep").alias("a"))
    copies = x.join(several, "a", "left_semi").join(y, F.col("a") == F.col("b")).where("x.row_id < y.row_id").select("x", "y")
    every = between.union(copies).where(~F.col("x.item").eqNullSafe(F.col("y.item")))
    return every.select(F.least("x.row_id", "y.row_id").alias("row_id_a"), F.greatest("x.row_id", "y.row_id").alias("row_id_b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(id, least): the least id of each node's connected component; labels spread and jump until none changes."""
    edges = settle(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    label = settle(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).select(F.col("a").alias("id"), "least"))
    while True:
        l2 = label.select(F.col("id").alias("b"), F.col("least").alias("lb"))
        near = edges.join(l2, "b").groupBy(F.col("a").alias("id")).agg(F.min("lb").alias("near"))
        step = label.join(near, "id").select("id", F.col("least").alias("old"), F.least("least", "near").alias("least"))
        jump = step.select(F.col("id").alias("via"), F.col("least").alias("lv"))
        new = settle(step.join(jump, step["least"] == jump["via"]).select("id", "old", F.least("least", "lv").alias("least")))
        moved = new.where("least != old").limit(1).count()
        label = new.select("id", "least")
        if not moved:
            return label


def groups(chunks: DataFrame, least: float = SIMILAR, adjacent: int = ADJACENT, min_words: int = MIN_WORDS, blocks: int = BLOCKS, sketch: bool = True) -> DataFrame:
    """(row_id, group_id, links): one row per member text with a near-duplicate or a copy; links counts representatives."""
    members, pairs = similar_sets(chunks, least, adjacent, min_words, blocks, sketch)
    pairs = settle(pairs.select("a", "b"))
    comp = components(pairs)
    links = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    m = members.join(comp, members["rep"] == comp["id"], "left").join(links, members["rep"] == links["a"], "left")
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    m = m.select("row_id", "rep", F.coalesce("least", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")).join(size, "rep")
    return m.where("links > 0 or copies > 1").select("row_id", "group_id", "links")
