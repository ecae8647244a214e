"""Cutting texts into overlapping pieces, in one Arrow pass that looks at every character once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text

SIZE, OVERLAP, LOOK_BACK = 1024, 100, 220
#: Characters after which a text may be cut.
BOUNDARY = "\n.!?;:。！？；："
#: White space as in `text.SPACE`.
BLANK = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = re.compile(f"[{BOUNDARY}]")


def trimmed(content: Column, stream: bool = False) -> Column:
    """The text to be cut; null becomes empty."""
    whole = F.coalesce(content, F.lit(""))
    return F.regexp_replace(whole, f"[{text.SPACE}]+$", "") if stream else text.trim_space(whole)


def cut(whole: str, size: int = SIZE, overlap: int = OVERLAP, stream: bool = False) -> Iterator[tuple[int, str]]:
    """(ordinal, piece) of a text.

    A piece ends at the last boundary of the stretch before `size`, or at `size`; the next starts `overlap` before that end.
    Blank pieces are left out; they use up an ordinal, unless `stream`, which also keeps leading white space in place.
    """
    reach = min(LOOK_BACK, size - size // 2)
    start, ordinal = 0, 0
    while start < len(whole):
        end = start + size
        if end < len(whole):
            last = max((m.end() for m in _BOUNDARY.finditer(whole, end - reach, end)), default=end)
            end = last
        piece = whole[start:end].strip(BLANK)
        if piece:
            yield ordinal, piece
        ordinal += bool(piece) or not stream
        if end >= len(whole):
            return
        start = max(end - overlap, start + 1)


def pieces(whole: Column, stream: bool = False) -> Column:
    """array<struct<ordinal int, content string>> of a trimmed text."""

    @F.arrow_udf("array<struct<ordinal:int,content:string>>")
    def run(texts: pa.Array) -> pa.Array:
        offsets, ordinals, contents = [0], [], []
        for t in texts.to_pylist():
            for n, c in cut(t or "", stream=stream):
                ordinals.append(n)
                contents.append(c)
            offsets.append(len(ordinals))
        flat = pa.StructArray.from_arrays([pa.array(ordinals, pa.int32()), pa.array(contents, pa.string())], names=["ordinal", "content"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return run(whole)


def split_items(items, key: str = "id", content: str = "content", stream: bool = False):
    """Chunks of items (id, source, title, content, ...): ordinal, chunk_id, hash and preview added."""
    from corpusmill.functions import keys

    rows = items.withColumn("__whole", trimmed(F.col(content), stream)).drop(content)
    rows = rows.withColumn("__piece", F.explode(pieces(F.col("__whole"), stream))).drop("__whole")
    rows = rows.withColumn("ordinal", F.col("__piece.ordinal")).withColumn("content", F.col("__piece.content")).drop("__piece")
    rows = rows.withColumn("hash", keys.text_hash(F.col("content"))).withColumn("preview", text.preview(F.col("content")))
    return rows.withColumn("chunk_id", keys.chunk_id(F.col("source"), F.col(key).cast("string"), F.col("ordinal"), F.col("hash")))
