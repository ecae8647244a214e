"""Splitting oversized or badly overlapping pieces at natural boundaries (problem 3).

Faulty rows are marked first: rows that are too long by themselves, badly overlapping ones by an equi-join of the beginnings of rows with the ends of the pieces before them, keyed by source, item and
ordinal, so that an item with a third of all rows still spreads over all tasks; only beginnings and ends of the length of the greatest overlap move. Each faulty row is then cut on its own: its text
becomes atomic segments with a boundary strength between neighbours, a heap merges the weakest boundary first as long as
the joined size plus the overlap fits, and what is left are pieces that end at the strongest boundaries. Every piece after
the first begins with the last `overlap` characters of the piece before it. New ordinals are a prefix sum in two levels
(blocks of an item, rows of a block), so no task holds a whole item.

No character is lost: the pieces without what each repeats are the text, but for what the text itself repeats of the piece before it. A
repeat is taken for one if it has REPEAT characters of VARIED kinds or more, or is the whole overlap that the setting asks for.

Defined results: null content has no fault and gives no piece, empty content one empty piece; a file_type without its own
setting, and null, take the `default` row, or DEFAULT where that is missing; a size below 1 counts as missing, an overlap is
held between 0 and half the size; several settings of one type give the smallest size; rows stored twice (same source,
item, ordinal and content) are judged each but give pieces once, under the least row_id; where several rows stand one ordinal lower,
a difference from any of them is a fault.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import settle

#: Size and overlap where no setting exists at all.
DEFAULT = (1024, 100)
#: Characters, and different ones among them, from which on a text's beginning counts as repeated from the piece before.
REPEAT, VARIED = 16, 6
#: Bytes of faulty rows' marks up to which they are sent to every task.
SMALL = 32 << 20
#: Ordinals of one block of the prefix sum.
BLOCK = 512
#: Boundaries from strong to weak; a text is first cut at all of them down to the clause.
BOUNDARIES = [
    (6.0, re.compile(r"\n[^\S\n]*\n\s*|\n(?=#{1,6} |={2,}[^=]|\\(?:sub)*section|<h[1-6])")),
    (5.0, re.compile(r"\n+")),
    (4.0, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][”’」』）]*\s*")),
    (3.0, re.compile(r"[;:]\s+|[；：]\s*")),
    (2.0, re.compile(r",\s+|[，、]\s*|\s[–—-]\s")),
    (1.0, re.compile(r"\s+")),
]
CLAUSE = 5


def atoms(text: str, budget: int) -> tuple[list[str], list[float]]:
    """Segments of at most `budget` characters and the strength of the boundary after each but the last."""

    def cut(part: str, end: float, level: int) -> Iterator[tuple[str, float]]:
        if level >= len(BOUNDARIES):
            for i in range(0, len(part), budget):
                yield part[i : i + budget], end if i + budget >= len(part) else 0.0
            return
        if level >= CLAUSE and len(part) <= budget:
            yield part, end
            return
        strength, pattern = BOUNDARIES[level]
        at = 0
        for m in pattern.finditer(part):
            if m.end() < len(part):
                yield from cut(part[at : m.end()], strength, level + 1)
                at = m.end()
        yield from cut(part[at:], end, level + 1)

    out = [(p, s) for p, s in cut(text, 0.0, 0) if p]
    return [p for p, _ in out], [s for _, s in out[:-1]]


def merge(parts: list[str], strength: list[float], budget: int) -> list[str]:
    """Agglomerative merging: the weakest boundary first, and of equal ones that with the smaller joined size."""
    n = len(parts)
    size = [len(p) for p in parts]
    nxt, prv, alive, version = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n
    heap = [(strength[i], size[i] + size[i + 1], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    text = [[p] for p in parts]
    while heap:
        _, joined, i, vi, vj = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj or joined > budget:
            continue
        text[i] += text[j]
        size[i] = joined
        alive[j] = False
        nxt[i] = nxt[j]
        strength_after = strength[j] if j < n - 1 else 0.0
        if nxt[i] < n:
            prv[nxt[i]] = i
            strength[i] = strength_after
        version[i] += 1
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < n:
                heapq.heappush(heap, (strength[a], size[a] + size[b], a, version[a], version[b]))
    return ["".join(text[i]) for i in range(n) if alive[i]]


def repeated(before: str, text: str, overlap: int) -> int:
    """Characters at the beginning of `text` that repeat the end of `before`: the longest run that can't have come about by accident."""
    # The longest suffix of `before` that is a prefix of `text`, and the shorter ones, by the prefix function: linear in both.
    joined = text[: len(before)] + "\0\0" + before[-len(text) :] if text else ""
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        border[i] = k + (joined[i] == joined[k])
    k = border[-1] if border else 0
    while k:
        if k == overlap or k >= REPEAT and len(set(text[:k])) >= VARIED:
            return k
        k = border[k - 1]
    return 0


def split_text(text: str, size: int, overlap: int, before: str | None = None) -> list[str]:
    """Pieces of `text` within `size`; `before` is the end of the preceding piece, which the first piece is to repeat."""
    overlap = max(0, min(overlap, size // 2))
    lead = ""
    if before and overlap:
        lead = before[-overlap:]
        text = text[repeated(before, text, overlap) :]
    if len(lead) + len(text) <= size:
        return [lead + text]
    parts, strength = atoms(text, size - overlap)
    out, end = [], lead
    for body in merge(parts, strength, size - overlap):
        out.append(end + body)
        end = (end + body)[-overlap:] if overlap else ""
    return out


def with_settings(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """`chunks` with chunk_size and chunk_overlap as bigint `__size` and `__overlap`."""
    ok = settings.where("chunk_size >= 1").groupBy("file_type").agg(F.min(F.struct("chunk_size", "chunk_overlap")).alias("s"))
    ok = ok.select(F.col("file_type").alias("__type"), F.col("s.chunk_size").alias("__s"), F.col("s.chunk_overlap").alias("__o"))
    default = ok.where(F.col("__type") == "default")

    def scalar(c: str, fallback: int) -> Column:
        return F.coalesce(default.agg(F.max(c)).scalar(), F.lit(fallback))

    size = F.coalesce("__s", scalar("__s", DEFAULT[0]))
    overlap = F.coalesce(F.when(F.col("__s").isNotNull(), F.coalesce("__o", F.lit(0))), scalar("__o", DEFAULT[1]))
    df = chunks.join(ok, chunks["file_type"] == ok["__type"], "left")
    return df.withColumn("__size", size.cast("long")).withColumn("__overlap", F.greatest(F.lit(0), F.least(overlap.cast("long"), F.floor(F.col("__size") / 2)))).drop("__type", "__s", "__o")


def marked(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Every row with its faults, its setting and, where it doesn't repeat it rightly, the end of the piece before it."""
    cols = ["row_id", "source", "item_id", "ordinal", "file_type", "content"]
    df = with_settings(chunks.select(*[chunks[c] for c in cols]), settings)
    reach = settings.agg(F.max("chunk_overlap")).scalar()
    reach = F.greatest(F.coalesce(reach, F.lit(0)), F.lit(DEFAULT[1]))
    ends = chunks.where(F.col("content").isNotNull()).select(
        F.col("source").alias("s"), F.col("item_id").alias("i"), (F.col("ordinal") + 1).alias("o"), F.expr("content").alias("c")
    )
    ends = ends.select("s", "i", "o", F.right("c", reach).alias("tail")).where("s is not null and i is not null and o is not null").distinct()
    heads = df.where("content is not null and __overlap > 0 and source is not null and item_id is not null and ordinal is not null")
    heads = heads.select("row_id", F.col("source").alias("s"), F.col("item_id").alias("i"), F.col("ordinal").alias("o"), F.left("content", F.col("__overlap")).alias("head"), F.col("__overlap").alias("w"))
    bad = heads.join(ends, ["s", "i", "o"]).where(F.col("head") != F.right("tail", F.col("w"))).groupBy("row_id").agg(F.max("tail").alias("before"))
    long = df.where(F.length("content") > F.col("__size"))
    # Only faulty rows are brought together with their texts; the rest never moves.
    return long.select("row_id").withColumn("__long", F.lit(True)).join(bad, "row_id", "full").withColumn("fault", F.filter(F.array(F.when(F.col("__long"), "oversized"), F.when(F.col("before").isNotNull(), "overlap")), lambda x: x.isNotNull())).select("row_id", "fault", "before")


def resplit(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Faulty rows: row_id, source, item_id, ordinal, fault array<string>, pieces array<string>."""
    faults = settle(marked(chunks, settings))
    texts = with_settings(chunks.select("row_id", "source", "item_id", "ordinal", "file_type", "content").where("content is not null"), settings)
    work = texts.join(small(faults), "row_id").select("row_id", "source", "item_id", "ordinal", "fault", "before", "__size", "__overlap", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["before", "__size", "__overlap", "content"]).to_pylist()
            pieces = [split_text(r["content"], r["__size"], r["__overlap"], r["before"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(pieces, type=pa.list_(pa.string()))], names=["row_id", "source", "item_id", "ordinal", "fault", "pieces"])

    kinds = {c: work.schema[c].dataType.simpleString() for c in ("row_id", "source", "item_id", "ordinal")}
    return work.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", fault array<string>, pieces array<string>")


def small(faults: DataFrame) -> DataFrame:
    """`faults`, to be sent to every task if they were measured and found small, so that no text moves; larger ones are joined by key."""
    size = faults.agg((F.coalesce(F.sum(F.length("before") * 4), F.lit(0)) + F.count(F.lit(1)) * 64).alias("n")).first().n
    return F.broadcast(faults) if (size or 0) <= SMALL else faults


def found_rows(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Distinct (row_id, fault) of the rows that were cut anew."""
    return resplit(chunks, settings).select("row_id", F.explode("fault").alias("fault")).distinct()


def all_pieces(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Every item as pieces within the size: source, item_id, ordinal (consecutive from 0), row_id, content. Texts move once, by row_id."""
    new = settle(resplit(chunks, settings).select("row_id", "pieces").dropDuplicates(["row_id"]))
    base = chunks.select(*[chunks[c] for c in ("row_id", "source", "item_id", "ordinal", "content")]).where("content is not null")
    # Rows stored twice are told by 128 bits of their texts.
    rows = base.groupBy("source", "item_id", "ordinal", F.xxhash64("content"), F.xxhash64(F.reverse("content"))).agg(F.min("row_id").alias("row_id")).select("source", "item_id", "ordinal", "row_id")
    rows = rows.join(new.select("row_id", F.size("pieces").alias("__k")), "row_id", "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    rows = settle(rows.withColumn("__block", F.floor(F.coalesce("ordinal", F.lit(0)) / BLOCK)))
    blocks = rows.groupBy("source", "item_id", "__block").agg(F.sum("__k").alias("__sum"))
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy("source", "item_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = blocks.select(F.col("source").alias("bs"), F.col("item_id").alias("bi"), F.col("__block").alias("bb"), "__before")
    rows = rows.join(b, F.expr("source <=> bs and item_id <=> bi and __block = bb")).drop("bs", "bi", "bb")
    inner = Window.partitionBy("source", "item_id", "__block").orderBy(F.col("ordinal").asc_nulls_first(), "row_id").rowsBetween(Window.unboundedPreceding, -1)
    places = rows.select("row_id", (F.col("__before") + F.coalesce(F.sum("__k").over(inner), F.lit(0))).alias("__from"))
    whole = base.select("row_id", "source", "item_id", "content").join(places, "row_id").dropDuplicates(["row_id"]).join(new, "row_id", "left")
    return whole.select("source", "item_id", "row_id", "__from", F.posexplode(F.coalesce("pieces", F.array("content"))).alias("__p", "piece")).select(
        "source", "item_id", (F.col("__from") + F.col("__p")).cast("int").alias("ordinal"), "row_id", F.col("piece").alias("content")
    )
