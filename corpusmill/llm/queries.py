"""Stated queries of the text-preparation problems, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import encoding, lookalikes, markup, mixing, nearcopies, pieces, residue, tokens
from corpusmill.session import table, texts


def _p1_tables(spark: SparkSession, base: str) -> list[tuple[DataFrame, str, str, str]]:
    chunks, requests = texts(spark, base, "chunks"), table(spark, base, "search_requests")
    return [(chunks, "row_id", "content", "content"), (chunks, "row_id", "title", "title"), (requests, "request_id", "query", "query")]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.found_rows(_p1_tables(spark, base))


def p1_normalized(spark: SparkSession, base: str) -> DataFrame:
    return lookalikes.normalized(_p1_tables(spark, base))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return markup.found_rows(texts(spark, base, "chunks"))


def p2_cleaned(spark: SparkSession, base: str) -> DataFrame:
    return markup.cleaned(texts(spark, base, "chunks"))


def p2_wrappers(spark: SparkSession, base: str) -> DataFrame:
    """The inferred wrapper of each host."""
    return markup.wrappers(texts(spark, base, "chunks"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return pieces.found_rows(texts(spark, base, "chunks"), table(spark, base, "chunker_settings"))


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    return pieces.all_pieces(texts(spark, base, "chunks"), table(spark, base, "chunker_settings"))


P3_SQL = """
WITH d AS (SELECT max(chunk_size) s, max(chunk_overlap) o FROM chunker_settings WHERE file_type = 'default'),
c AS (SELECT k.row_id, k.source, k.item_id, k.ordinal, k.content, coalesce(t.chunk_size, d.s) s, coalesce(t.chunk_overlap, d.o) o
      FROM chunks k LEFT JOIN chunker_settings t ON t.file_type = k.file_type CROSS JOIN d)
SELECT DISTINCT row_id, 'oversized' AS fault FROM c WHERE length(content) > s
UNION
SELECT DISTINCT c.row_id, 'overlap' AS fault FROM c JOIN chunks p
  ON p.source = c.source AND p.item_id = c.item_id AND p.ordinal = c.ordinal - 1
WHERE c.o > 0 AND substr(c.content, 1, c.o) <> (CASE WHEN length(p.content) <= c.o THEN p.content ELSE substr(p.content, length(p.content) - c.o + 1) END)
"""


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return encoding.found_rows(texts(spark, base, "chunks"))


def p4_restored(spark: SparkSession, base: str) -> DataFrame:
    """The affected values and what they were."""
    return encoding.repaired_values(texts(spark, base, "chunks"), "row_id", ["content", "title"])


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return nearcopies.found_rows(texts(spark, base, "chunks"))


P5_SQL = r"""
WITH w AS (SELECT row_id, item_id, regexp_extract_all(regexp_replace(lower(content), '([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS x FROM chunks WHERE content IS NOT NULL),
s AS (SELECT DISTINCT row_id, item_id, unnest(list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])) AS g FROM w WHERE len(x) >= 80),
n AS (SELECT row_id, count(*) AS n FROM s GROUP BY row_id),
p AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.row_id < b.row_id AND a.item_id IS DISTINCT FROM b.item_id GROUP BY ALL)
SELECT row_id_a, row_id_b FROM p JOIN n x ON x.row_id = row_id_a JOIN n y ON y.row_id = row_id_b WHERE c >= 0.6 * (x.n + y.n - c)
"""


def p5_groups(spark: SparkSession, base: str) -> DataFrame:
    """Each near-duplicate or copied text with its group and its number of links."""
    return nearcopies.groups(texts(spark, base, "chunks"))


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode_table(texts(spark, base, "documents"))


def p8_mix(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix(mixing.sizes_of(texts(spark, base, "documents")), table(spark, base, "mix_targets"))


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares(mixing.sizes_of(texts(spark, base, "documents")), table(spark, base, "mix_targets"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return residue.found_rows(texts(spark, base, "documents"))


def p9_kept(spark: SparkSession, base: str) -> DataFrame:
    return residue.kept_rows(texts(spark, base, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_normalized": p1_normalized, "p2_found": p2_found, "p2_cleaned": p2_cleaned, "p2_wrappers": p2_wrappers, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_groups": p5_groups, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_kept": p9_kept}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p5_found": P5_SQL}
