"""Queries of the engine's own operators, each over its whole tables, with the SQL they are compared with."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.engine import SearchRequest, candidates, results, stored_candidates
from corpusmill.functions import chunking, keys, text
from corpusmill.operators import batch, index, match, query, rank, sync
from corpusmill.plans import sql as Q
from corpusmill.session import shared_dir, table, texts
from corpusmill.sources import browser, files
from corpusmill.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The moment at which results are ranked: shortly after the newest record.
NOW = 1_930_300_000


def query_of(name: str, oracle: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# ---------------------------------------------------------------- text


@query_of("clean_text", f"SELECT row_id, {Q.clean('content')} AS text FROM chunks WHERE content IS NOT NULL")
def clean_text(spark: SparkSession, base: str) -> DataFrame:
    return texts(spark, base, "chunks").where("content is not null").select("row_id", text.clean(F.col("content")).alias("text"))


@query_of("preview", f"SELECT row_id, {Q.preview('content')} AS preview FROM chunks WHERE content IS NOT NULL")
def preview(spark, base):
    return texts(spark, base, "chunks").where("content is not null").select("row_id", text.preview(F.col("content")).alias("preview"))


@query_of("path_only_chunks", rf"SELECT DISTINCT path, {Q.base('path')} || ' ' || path || ' ' || replace(path, '\', ' ') || ' ' || replace(path, '/', ' ') AS content FROM file_candidates")
def path_only_chunks(spark, base):
    return table(spark, base, "file_candidates").select("path", text.path_only_content(text.base_name(F.col("path")), F.col("path")).alias("content")).distinct()


@query_of(
    "cjk_grams",
    r"""WITH t AS (SELECT row_id, concat_ws(' ', title, CASE WHEN length(content) <= 4096 THEN content ELSE preview END) AS x FROM chunks),
r AS (SELECT row_id, unnest(regexp_extract_all(x, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+')) AS run FROM t)
SELECT DISTINCT row_id, unnest(CASE WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substr(run, i, 2)) END) AS gram FROM r""",
)
def cjk_grams(spark, base):
    return index.gram_postings(texts(spark, base, "chunks")).select("row_id", F.col("token").alias("gram"))


@query_of(
    "snippets",
    f"""WITH t AS (SELECT row_id, preview AS p, instr(lower(preview), 'plan') AS a, instr(lower(preview), 'liste') AS b FROM chunks WHERE preview IS NOT NULL),
u AS (SELECT row_id, p, CASE WHEN a > 0 THEN a ELSE b END AS pos FROM t), v AS (SELECT *, greatest(pos - 56, 0) AS s FROM u), w AS (SELECT *, least(s + 220, length(p)) AS e FROM v)
SELECT row_id, CASE WHEN pos = 0 OR length(p) <= 220 THEN {Q.preview('p')} ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || {Q.trim('substr(p, s + 1, e - s)')} || (CASE WHEN e < length(p) THEN '...' ELSE '' END) END AS snippet FROM w""",
)
def snippets(spark, base):
    return texts(spark, base, "chunks").where("preview is not null").select("row_id", text.snippet(F.col("preview"), '"plan" liste').alias("snippet"))


@query_of("name_parts", rf"SELECT DISTINCT path, {Q.base('path')} AS name, {Q.ext('path')} AS ext, {Q.path('path')} AS normal, {Q.words(Q.rank_text(Q.base('path')))} AS words FROM file_candidates")
def name_parts(spark, base):
    p = F.col("path")
    name = text.base_name(p)
    return table(spark, base, "file_candidates").select("path", name.alias("name"), text.extension(p).alias("ext"), text.normal_path(p).alias("normal"), text.name_words(text.rank_text(name)).alias("words")).distinct()


# ---------------------------------------------------------------- keys, times


@query_of("shard_assign", f"WITH k AS (SELECT DISTINCT source, item_id FROM chunks) SELECT source, item_id, ({Q.fnv('''(coalesce(source, '') || ':' || coalesce(item_id, ''))''')} % 8)::INT AS shard FROM k")
def shard_assign(spark, base):
    return texts(spark, base, "chunks").select("source", "item_id").distinct().withColumn("shard", keys.shard(F.col("source"), F.col("item_id")))


@query_of("global_rowid", "SELECT row_id, (row_id >> 56)::INT AS shard, row_id & ((1::BIGINT << 56) - 1) AS local, row_id AS again FROM chunks")
def global_rowid(spark, base):
    r = F.col("row_id")
    return texts(spark, base, "chunks").select("row_id", keys.rowid_shard(r).alias("shard"), keys.rowid_local(r).alias("local"), keys.global_rowid(keys.rowid_shard(r), keys.rowid_local(r)).alias("again"))


@query_of("epoch_convert", "WITH t AS (SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events) SELECT event_id, (s + 11644473600) * 1000000 AS webkit, s AS unix, 0::BIGINT AS none FROM t")
def epoch_convert(spark, base):
    t = table(spark, base, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("s"))
    t = t.withColumn("webkit", keys.unix_to_webkit(F.col("s")))
    return t.select("event_id", "webkit", keys.webkit_to_unix(F.col("webkit")).alias("unix"), keys.webkit_to_unix(F.lit(-5).cast("bigint")).alias("none"))


@query_of("item_keys", "SELECT DISTINCT path, sha256(lower(path)) AS item_id, 'file:' || substr(sha256(lower(path)), 1, 16) AS sync_key, 'file-content:' || substr(sha256(lower(path)), 1, 16) AS content_key FROM file_candidates")
def item_keys(spark, base):
    p = F.col("path")
    return table(spark, base, "file_candidates").select("path", keys.file_item_id(p).alias("item_id"), keys.sync_key(p).alias("sync_key"), keys.sync_key(p, True).alias("content_key")).distinct()


@query_of("content_fingerprint", "SELECT source, item_id, 'content:' || sha1(string_agg(hash, '' ORDER BY ordinal, hash)) AS content_hash FROM chunks GROUP BY source, item_id")
def content_fingerprint(spark, base):
    return texts(spark, base, "chunks").groupBy("source", "item_id").agg(keys.content_fingerprint(F.col("ordinal"), F.col("hash")).alias("content_hash"))


# ---------------------------------------------------------------- chunking

_CUT = r"""CASE WHEN n - s <= 1024 THEN n - s
 WHEN regexp_matches(substr(x, s + 805, 220), '[\n.!?;:。！？；：]') THEN 804 + length(regexp_extract(substr(x, s + 805, 220), '(?s)^.*[\n.!?;:。！？；：]'))
 ELSE 1024 END"""
_CHUNKS = f"""
RECURSIVE t AS (SELECT doc_id, source, x, length(x) AS n FROM (SELECT doc_id, source, {Q.clean('text')} AS x FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, source, x, n, 0 AS s, 0 AS ordinal FROM t WHERE n > 0
      UNION ALL SELECT doc_id, source, x, n, s + cut - 100, ordinal + 1 FROM (SELECT *, {_CUT} AS cut FROM c) WHERE s + cut < n),
p AS (SELECT doc_id, source, ordinal, {Q.trim(f'substr(x, s + 1, {_CUT})')} AS content FROM c)"""


def _document_chunks(spark, base) -> DataFrame:
    d = texts(spark, base, "documents").where("text is not null").select("doc_id", "source", text.clean(F.col("text")).alias("content"))
    return chunking.split_items(d, "doc_id")


@query_of("chunk_documents", f"WITH {_CHUNKS} SELECT doc_id, ordinal, sha256(content) AS hash, source || ':' || doc_id || ':' || lpad(ordinal::VARCHAR, 4, '0') || ':' || substr(sha256(content), 1, 16) AS chunk_id, {Q.preview('content')} AS preview FROM p WHERE content <> ''")
def chunk_documents(spark, base):
    return _document_chunks(spark, base).select("doc_id", "ordinal", "hash", "chunk_id", "preview")


@query_of("chunk_stats", f"WITH {_CHUNKS} SELECT source, count(*) AS chunks, max(ordinal) AS last, sum(length(content)) AS chars, max(length(content)) AS longest FROM p WHERE content <> '' GROUP BY source")
def chunk_stats(spark, base):
    return _document_chunks(spark, base).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.max("ordinal").alias("last"), F.sum(F.length("content")).alias("chars"), F.max(F.length("content")).alias("longest"))


# ---------------------------------------------------------------- index


@query_of("fts_postings", f"WITH {Q.TOKENS} SELECT shard, token, row_id, col, count(*)::INT AS tf, min(pos)::INT AS first, max(pos)::INT AS last FROM tok GROUP BY ALL")
def fts_postings(spark, base):
    p = index.postings(texts(spark, base, "chunks"))
    return p.select("shard", "token", "row_id", "col", "tf", F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


@query_of("doc_stats", f"WITH {Q.TOKENS} SELECT shard, row_id, tl::INT AS title_len, cl::INT AS content_len FROM d")
def doc_stats(spark, base):
    return index.doc_stats(texts(spark, base, "chunks"))


@query_of("corpus_stats", f"WITH {Q.TOKENS} SELECT shard, n AS n_docs, round(mean, 9) AS avg_len FROM st")
def corpus_stats(spark, base):
    return index.corpus_stats(texts(spark, base, "chunks")).withColumn("avg_len", F.round("avg_len", 9))


# ---------------------------------------------------------------- matching and scores


def _scored(spark, base, search: str, scope: str = "shard") -> DataFrame:
    hit = match.scored(texts(spark, base, "chunks"), query.parse(query.rewrite(search)), scope)
    return hit.select("row_id", F.round("score", 6).alias("score"))


def _match(name: str, search: str, ctes: str, hits: list[tuple[str, str]], where: str, scope: str = "shard") -> None:
    total = " + ".join(f"coalesce(s{i}.sc, 0)" for i in range(len(hits)))
    joins = " ".join(f"LEFT JOIN s{i} ON s{i}.row_id = d.row_id" for i in range(len(hits)))
    SQL[name] = f"WITH {Q.TOKENS}, {ctes}, {Q.score(hits, scope)} SELECT d.row_id, round({total}, 6) AS score FROM d {joins} WHERE {where}"
    QUERIES[name] = lambda spark, base: _scored(spark, base, search, scope)


_match("match_prefix", "plan", Q.hit("a0", "starts_with(token, 'plan')"), [("a0", "a0")], "s0.sc IS NOT NULL")
_match("match_and", "floor plan", Q.hit("a0", "starts_with(token, 'floor')") + ", " + Q.hit("a1", "starts_with(token, 'plan')"), [("a0", "a0"), ("a1", "a1")], "s0.sc IS NOT NULL AND s1.sc IS NOT NULL")
_match("match_or", '"scanner" OR informe', Q.hit("a0", "token = 'scanner'") + ", " + Q.hit("a1", "token = 'informe'"), [("a0", "a0"), ("a1", "a1")], "s0.sc IS NOT NULL OR s1.sc IS NOT NULL")
_match("match_not", "plan NOT (floor OR travel)", Q.hit("a0", "token = 'plan'") + ", " + Q.hit("a1", "token = 'floor'") + ", " + Q.hit("a2", "token = 'travel'"), [("a0", "a0")], "s0.sc IS NOT NULL AND d.row_id NOT IN (SELECT row_id FROM a1) AND d.row_id NOT IN (SELECT row_id FROM a2)")
_PHRASE = Q.hit("b0", "token = 'search'") + ", " + Q.hit("b1", "token = 'log'") + ", a0 AS (SELECT b0.* FROM b0 JOIN b1 ON b1.row_id = b0.row_id AND b1.col = b0.col AND b1.pos = b0.pos + 1)"
_match("match_phrase", '"search log"', _PHRASE, [("a0", "a0")], "s0.sc IS NOT NULL")
_match("match_folded", '"expediente medico"', Q.hit("b0", "token = 'expediente'") + ", " + Q.hit("b1", "token = 'medico'") + ", a0 AS (SELECT b0.* FROM b0 JOIN b1 ON b1.row_id = b0.row_id AND b1.col = b0.col AND b1.pos = b0.pos + 1)", [("a0", "a0")], "s0.sc IS NOT NULL")
_NEAR = (
    Q.hit("o0", "token = 'old'") + ", " + Q.hit("o1", "token = 'scanner'") + ", "
    "a0 AS (SELECT DISTINCT o0.* FROM o0 JOIN o1 ON o1.row_id = o0.row_id AND o1.col = o0.col AND (CASE WHEN o1.pos > o0.pos THEN o1.pos - o0.pos ELSE o0.pos - o1.pos END) - 1 <= 3), "
    "a1 AS (SELECT DISTINCT o1.* FROM o1 JOIN o0 ON o1.row_id = o0.row_id AND o1.col = o0.col AND (CASE WHEN o1.pos > o0.pos THEN o1.pos - o0.pos ELSE o0.pos - o1.pos END) - 1 <= 3)"
)
_match("match_near", "NEAR(old scanner, 3)", _NEAR, [("a0", "o0"), ("a1", "o1")], "s0.sc IS NOT NULL AND s1.sc IS NOT NULL")
_match("match_column", "title : plan*", Q.hit("a0", "starts_with(token, 'plan') AND col = 0"), [("a0", "a0")], "s0.sc IS NOT NULL")
_match("match_initial", "^annual*", Q.hit("a0", "starts_with(token, 'annual') AND pos = 0"), [("a0", "a0")], "s0.sc IS NOT NULL")
_match("bm25_global", "garden survey", Q.hit("a0", "starts_with(token, 'garden')") + ", " + Q.hit("a1", "starts_with(token, 'survey')"), [("a0", "a0"), ("a1", "a1")], "s0.sc IS NOT NULL AND s1.sc IS NOT NULL", "global")

_AND = f"""{Q.TOKENS}, {Q.hit('a0', "starts_with(token, 'plan')")}, {Q.score([('a0', 'a0')])},
sc AS (SELECT c.*, (c.row_id >> 56)::INT AS shard, s0.sc AS score FROM chunks c JOIN s0 USING (row_id))"""


def _plan(spark, base) -> DataFrame:
    return match.scored(texts(spark, base, "chunks"), query.parse(query.rewrite("plan")))


@query_of("filters_source_type_time", f"WITH {_AND} SELECT row_id, round(score, 6) AS score FROM sc WHERE source = 'file' AND file_type = 'md' AND updated_at >= 1880000000 AND updated_at <= 1929000000")
def filters_source_type_time(spark, base):
    return match.filtered(_plan(spark, base), "file", "md", 1_880_000_000, 1_929_000_000).select("row_id", F.round("score", 6).alias("score"))


@query_of("shard_topk", f"WITH {_AND} SELECT row_id, shard, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score, updated_at DESC NULLS LAST, row_id) k FROM sc) WHERE k <= 80")
def shard_topk(spark, base):
    return match.shard_top(_plan(spark, base), 80).select("row_id", "shard", F.round("score", 6).alias("score"))


@query_of("bm25_topk", f"WITH {_AND} SELECT row_id, title, round(score, 6) AS score FROM sc ORDER BY sc.score, updated_at DESC NULLS LAST, row_id LIMIT 20")
def bm25_topk(spark, base):
    top = _plan(spark, base).orderBy(*rank.order()).limit(20)
    return top.select("row_id", "title", F.round("score", 6).alias("score"))


@query_of(
    "bm25_cjk",
    r"""WITH t AS (SELECT row_id, (row_id >> 56)::INT AS shard, concat_ws(' ', title, CASE WHEN length(content) <= 4096 THEN content ELSE preview END) AS x FROM chunks),
g AS (SELECT row_id, shard, list_distinct(flatten(list_transform(regexp_extract_all(x, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))) AS grams FROM t),
h AS (SELECT row_id, shard, coalesce(len(grams), 0) AS terms, coalesce(list_contains(grams, '备份'), false) AS p, coalesce(list_contains(grams, '份方'), false) AS q FROM g),
s AS (SELECT shard, count(*) AS n, avg(terms) AS mean, count(*) FILTER (p) AS np, count(*) FILTER (q) AS nq FROM h GROUP BY shard),
i AS (SELECT *, CASE WHEN ln((n - np + 0.5) / (np + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - np + 0.5) / (np + 0.5)) END + CASE WHEN ln((n - nq + 0.5) / (nq + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nq + 0.5) / (nq + 0.5)) END AS w FROM s)
SELECT row_id, round(-w * 2.2 / (1 + 1.2 * (0.25 + 0.75 * terms / mean)), 6) AS score FROM h JOIN i USING (shard) WHERE p AND q""",
)
def bm25_cjk(spark, base):
    return match.scored_grams(texts(spark, base, "chunks"), query.cjk_query("备份方")).select("row_id", F.round("score", 6).alias("score"))


@query_of("request_limits", "WITH r AS (SELECT request_id, CASE WHEN coalesce(max_rows, 0) <= 0 THEN 50 ELSE least(max_rows, 200) END AS l, greatest(coalesce(skip_rows, 0), 0) AS o FROM search_requests) SELECT request_id, l::INT AS row_limit, o::INT AS row_offset, least(greatest(4 * (l + o), 80), 5000)::INT AS oversampled FROM r")
def request_limits(spark, base):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [match.limits(None if pd.isna(m) else int(m), None if pd.isna(o) else int(o)) for m, o in zip(b["max_rows"], b["skip_rows"])]
            yield pd.DataFrame({"request_id": b["request_id"]} | {n: [r[k] for r in rows] for k, n in enumerate(("row_limit", "row_offset", "oversampled"))})

    return table(spark, base, "search_requests").select("request_id", "max_rows", "skip_rows").mapInPandas(run, "request_id bigint, row_limit int, row_offset int, oversampled int")


# ---------------------------------------------------------------- the stored index

_BUILT: dict[tuple[str, str], str] = {}


def _stored(spark, base) -> index.Index:
    """An index of the whole chunk table in the shared folder, built once in a session."""
    key = (spark.sparkContext.applicationId, os.path.realpath(base))
    if key not in _BUILT:
        at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        index.Index(spark, at).write(table(spark, base, "chunks"))
        _BUILT[key] = at
    return index.Index(spark, _BUILT[key])


def _match_stored(name: str, of: str, search: str, scope: str = "shard") -> None:
    """The same matches and scores from stored postings as from the texts."""
    SQL[name] = SQL[of]
    QUERIES[name] = lambda spark, base: match.scored_stored(_stored(spark, base), query.parse(query.rewrite(search)), scope).select("row_id", F.round("score", 6).alias("score"))


_match_stored("and_indexed", "match_and", "floor plan")
_match_stored("not_indexed", "match_not", "plan NOT (floor OR travel)")
_match_stored("phrase_indexed", "match_phrase", '"search log"')
_match_stored("near_indexed", "match_near", "NEAR(old scanner, 3)")
_match_stored("column_indexed", "match_column", "title : plan*")
_match_stored("initial_indexed", "match_initial", "^annual*")
_match_stored("global_indexed", "bm25_global", "garden survey", "global")


@query_of("cjk_indexed", SQL["bm25_cjk"])
def cjk_indexed(spark, base):
    return match.scored_grams_stored(_stored(spark, base), query.cjk_query("备份方")).select("row_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- ranking

_CAND = "cand AS (SELECT * FROM chunks)"


def _rank(name: str, rule, sql_rule: str) -> None:
    SQL[name] = f"WITH {_CAND}, {Q.FEATURES} SELECT row_id, round({sql_rule}, 4)::DOUBLE AS adjustment FROM fe"
    QUERIES[name] = lambda spark, base: rank.features(texts(spark, base, "chunks")).select("row_id", F.round(rule(), 4).cast("double").alias("adjustment"))


_rank("rank_exact", lambda: rank.exact_rule(rank.profile("floor plan")), Q.exact("floor plan", False))
_rank("rank_filename", lambda: rank.exact_rule(rank.profile("all-mail-483.txt")), Q.exact("all-mail-483.txt", True))
_rank("rank_tokens", lambda: rank.token_rule(rank.profile("annual plan_b Plan")), Q.token(["annual", "plan_b", "plan"]))
_rank("rank_folder", lambda: rank.folder_rule(rank.profile("Approved")), Q.bare("approved"))
_rank("rank_source", lambda: rank.source_rule(rank.profile("design folder")), Q.source(False, False, True, False, False))
_rank("rank_url", lambda: rank.source_rule(rank.profile("https://tornby.test")), Q.source(True, True, False, False, True))
_rank("rank_noise", rank.noise_rule, Q.NOISE)
_rank("rank_freshness", lambda: rank.freshness_rule(NOW), Q.fresh(NOW))

_ADJ = " + ".join([Q.exact("plan", False), Q.token(["plan"]), Q.source(False, False, False, True, False), Q.bare("plan"), Q.NOISE, Q.fresh(NOW)])
_FULL = f"""{_AND}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score, updated_at DESC NULLS LAST, row_id) k FROM sc) WHERE k <= 200), {Q.FEATURES},
ad AS (SELECT *, score + {_ADJ} AS total FROM fe),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {Q.KEY} ORDER BY total, updated_at DESC NULLS LAST, row_id) dk FROM ad) WHERE dk = 1)"""


@query_of("rank_full", f"WITH {_FULL} SELECT rank::INT AS rank, row_id, source, title, round(total, 5) AS score FROM (SELECT *, row_number() OVER (ORDER BY total, updated_at DESC NULLS LAST, row_id) rank FROM dd WHERE NOT {Q.NOISY}) WHERE rank <= 50")
def rank_full(spark, base):
    r = SearchRequest("plan")
    return results(candidates(texts(spark, base, "chunks"), r), r, NOW).select("rank", "row_id", "source", "title", F.round("score", 5).alias("score"))


@query_of("search_indexed", SQL["rank_full"])
def search_indexed(spark, base):
    r = SearchRequest("plan")
    return results(stored_candidates(_stored(spark, base), r), r, NOW).select("rank", "row_id", "source", "title", F.round("score", 5).alias("score"))


@query_of("search_requests")
def search_requests(spark, base):
    """Every request, against all rows."""
    return batch.search_rows(texts(spark, base, "chunks"), table(spark, base, "search_requests")).withColumn("score", F.round("score", 6))


@query_of("paginate", f"WITH {_FULL} SELECT rank::INT AS rank, row_id FROM (SELECT *, row_number() OVER (ORDER BY total, updated_at DESC NULLS LAST, row_id) rank FROM dd WHERE NOT {Q.NOISY}) WHERE rank > 20 AND rank <= 50")
def paginate(spark, base):
    r = SearchRequest("plan", limit=30, offset=20)
    return results(candidates(texts(spark, base, "chunks"), r), r, NOW).select("rank", "row_id")


@query_of("load_more", f"WITH {_FULL} SELECT row_id FROM (SELECT *, row_number() OVER (ORDER BY total, updated_at DESC NULLS LAST, row_id) rank FROM dd WHERE NOT {Q.NOISY}) WHERE rank <= 45")
def load_more(spark, base):
    c = texts(spark, base, "chunks")
    pages = [results(candidates(c, r), r, NOW) for r in (SearchRequest("plan", limit=30, offset=0), SearchRequest("plan", limit=25, offset=20))]
    return rank.load_more(*pages).select("row_id")


@query_of("dedupe_results", f"WITH s AS (SELECT *, 0.0 AS score FROM chunks) SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {Q.KEY} ORDER BY score, updated_at DESC NULLS LAST, row_id) k FROM s) WHERE k = 1")
def dedupe_results(spark, base):
    return rank.deduped(texts(spark, base, "chunks").withColumn("score", F.lit(0.0))).select("row_id")


@query_of("noise_filter", f"SELECT row_id FROM (SELECT row_id, {Q.path('path')} AS pa FROM chunks) WHERE NOT {Q.NOISY}")
def noise_filter(spark, base):
    return rank.without_noise(texts(spark, base, "chunks"), "react").select("row_id")


# ---------------------------------------------------------------- browser sources

_URLS = "u AS (SELECT id AS url, title, (updated_at + 11644473600) * 1000000 AS t FROM data_items WHERE source = 'chrome' AND updated_at IS NOT NULL)"


def _urls(spark, base) -> DataFrame:
    d = table(spark, base, "data_items").where("source = 'chrome' and updated_at is not null")
    return d.select(F.col("id").alias("url"), "title", keys.unix_to_webkit(F.col("updated_at")).alias("last_visit_time"), F.lit(1).cast("bigint").alias("visit_count"))


@query_of(
    "history_topn",
    f"""WITH {_URLS}, k AS (SELECT * FROM u WHERE t > (1928000000 + 11644473600) * 1000000 ORDER BY t DESC, url LIMIT 5000), z AS (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN url ELSE title END AS ti FROM k)
SELECT url AS id, ti AS title, ti || chr(10) || url AS content, t // 1000000 - 11644473600 AS updated_at FROM z""",
)
def history_topn(spark, base):
    return browser.chromium_history(_urls(spark, base), "chrome", 1_928_000_000).select("id", "title", "content", "updated_at")


@query_of(
    "downloads_topn",
    rf"""WITH u AS (SELECT path, (updated_at + 11644473600) * 1000000 AS t FROM file_fingerprints WHERE updated_at IS NOT NULL AND path IS NOT NULL), k AS (SELECT * FROM u WHERE t > 0 ORDER BY t DESC, path LIMIT 2000)
SELECT 'download:' || path AS id, {Q.base('path')} AS title, {Q.base('path')} || chr(10) || path || chr(10) || 'https://a.test' AS content, t // 1000000 - 11644473600 AS updated_at FROM k""",
)
def downloads_topn(spark, base):
    d = table(spark, base, "file_fingerprints").where("updated_at is not null and path is not null")
    rows = d.select(F.col("path").alias("target_path"), F.lit("https://a.test").alias("tab_url"), keys.unix_to_webkit(F.col("updated_at")).alias("start_time"), F.col("size").alias("received_bytes"), F.col("size").alias("total_bytes"))
    return browser.chromium_downloads(rows, "chrome").select("id", "title", "content", "updated_at")


@query_of(
    "bookmarks_join",
    """WITH p AS (SELECT row_id AS id, chunk_id AS url, title FROM chunks WHERE source <> 'file'), b AS (SELECT row_id AS fk, CASE WHEN row_id % 3 = 0 THEN NULL ELSE preview END AS own, row_id % 2 + 1 AS type, updated_at * 1000000 AS t FROM chunks WHERE source <> 'file' AND updated_at IS NOT NULL),
j AS (SELECT coalesce(own, title, '') AS name, url, t FROM b JOIN p ON p.id = b.fk WHERE type = 1 AND t > 0 ORDER BY t DESC, url LIMIT 5000), z AS (SELECT *, CASE WHEN trim(name) = '' THEN url ELSE name END AS ti FROM j)
SELECT 'bookmark:' || url AS id, ti AS title, ti || chr(10) || url AS content, t // 1000000 AS updated_at FROM z""",
)
def bookmarks_join(spark, base):
    c = texts(spark, base, "chunks").where("source != 'file'")
    places = c.select(F.col("row_id").alias("id"), F.col("chunk_id").alias("url"), "title")
    marks = c.where("updated_at is not null").select(F.col("row_id").alias("fk"), F.when(F.col("row_id") % 3 != 0, F.col("preview")).alias("title"), (F.col("row_id") % 2 + 1).alias("type"), (F.col("updated_at") * 1_000_000).alias("dateAdded"))
    return browser.firefox_bookmarks(marks, places).select("id", "title", "content", "updated_at")


@query_of("bookmarks_flatten", "SELECT 'bookmark:' || id AS id, CASE WHEN trim(coalesce(title, '')) = '' THEN id ELSE title END AS title, updated_at FROM data_items WHERE updated_at > 0 AND id <> ''")
def bookmarks_flatten(spark, base):
    """Trees whose bookmarks stand in none to six folders, beside an empty folder and a node of another type."""
    d = table(spark, base, "data_items").where("updated_at is not null")
    leaf = F.to_json(F.struct(F.lit("url").alias("type"), F.coalesce("title", F.lit("")).alias("name"), F.col("id").alias("url"), keys.unix_to_webkit(F.col("updated_at")).cast("string").alias("date_added")))
    depth = F.pmod(F.xxhash64("id"), F.lit(7)).cast("int")
    tree = F.concat(F.lit('{"roots":{"other":{"type":"folder","children":[]},"note":{"type":"separator"},"bar":'), F.repeat(F.lit('{"type":"folder","name":"f","children":['), depth), leaf, F.repeat(F.lit("]}"), depth), F.lit("}}"))
    return browser.chromium_bookmarks(d.select(tree.alias("tree")), "chrome").select("id", "title", "updated_at")


@query_of(
    "history_firefox",
    """WITH u AS (SELECT id AS url, title, updated_at FROM data_items WHERE source = 'firefox' AND updated_at > 1928000000), z AS (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN url ELSE title END AS ti FROM u)
SELECT url AS id, ti AS title, ti || chr(10) || url AS content, updated_at FROM z""",
)
def history_firefox(spark, base):
    d = table(spark, base, "data_items").where("source = 'firefox' and updated_at is not null")
    places = d.select(F.col("id").alias("url"), "title", (F.col("updated_at") * 1_000_000).alias("last_visit_date"), F.lit(1).cast("bigint").alias("visit_count"))
    return browser.firefox_history(places, 1_928_000_000, None).select("id", "title", "content", "updated_at")


@query_of("browser_names", "SELECT DISTINCT source, upper(substr(source, 1, 1)) || substr(source, 2) || ' History' AS name FROM data_items")
def browser_names(spark, base):
    return table(spark, base, "data_items").select("source", F.concat(text.title_case(F.col("source")), F.lit(" History")).alias("name")).distinct()


@query_of("metadata_json", "SELECT id, json_extract_string(m, '$.url') AS url, json_extract_string(m, '$.visit_count')::BIGINT AS visits FROM (SELECT id, json_object('visit_count', 1, 'url', id) AS m FROM data_items WHERE source = 'chrome' AND updated_at IS NOT NULL AND updated_at > 1928000000)")
def metadata_json(spark, base):
    """Metadata as it is stored and read again."""
    m = F.from_json("metadata_json", "visit_count bigint, url string")
    return browser.chromium_history(_urls(spark, base), "chrome", 1_928_000_000, None).select("id", m.alias("m")).select("id", "m.url", F.col("m.visit_count").alias("visits"))


# ---------------------------------------------------------------- files and incremental sync

_DIRS = ", ".join(Q.lit(x) for x in files.SKIPPED_DIRECTORIES)
_FRAG = " OR ".join(f"contains(p || '/', {Q.lit(x)})" for x in files.NOISY_FRAGMENTS)
_SUF = " OR ".join(f"ends_with(nm, {Q.lit(x)})" for x in files.SKIPPED_SUFFIXES)
_ROOT = r"regexp_matches(p, '^[a-z]:/(windows|program files|program files \(x86\)|programdata|perflogs)/')"


@query_of(
    "candidate_filter",
    f"""WITH c AS (SELECT DISTINCT path, is_dir, size, {Q.path('path')} AS p, lower({Q.base('path')}) AS nm FROM file_candidates),
e AS (SELECT *, string_split(p, '/')[1:-2] AS up FROM c)
SELECT path, is_dir FROM e WHERE NOT ({_FRAG}) AND NOT {_ROOT} AND len(list_filter(up, lambda x: starts_with(x, '.') OR starts_with(x, 'skin_') OR x IN ({_DIRS}))) = 0
 AND CASE WHEN is_dir THEN NOT (starts_with(nm, '.') OR starts_with(nm, 'skin_') OR nm IN ({_DIRS}) OR regexp_matches(p, '^[a-z]:/(windows|program files|program files \\(x86\\)|programdata|perflogs)$'))
     ELSE NOT (trim(nm) = '' OR starts_with(nm, '.') OR starts_with(nm, '~$') OR nm IN ('.ds_store', 'desktop.ini', 'thumbs.db') OR {_SUF}) AND coalesce(size, 0) <= 104857600 END""",
)
def candidate_filter(spark, base):
    return files.admitted(table(spark, base, "file_candidates").select("path", "is_dir", "size").distinct()).select("path", "is_dir")


_TYPES = ", ".join(Q.lit(x) for x in files.TEXT_TYPES)
_KIND = f"CASE WHEN NOT is_dir AND {Q.ext('path')} IN ({_TYPES}) AND coalesce(size, 0) > 0 AND coalesce(size, 0) <= 65536 THEN 'content:' ELSE 'path:' END"


@query_of("desired_kind", f"SELECT DISTINCT path, coalesce(size, -1) AS size, {_KIND} AS kind FROM file_candidates")
def desired_kind(spark, base):
    return table(spark, base, "file_candidates").select("path", F.coalesce("size", F.lit(-1)).alias("size"), sync.desired_kind().alias("kind")).distinct()


_KNOWN = f"""fp AS (SELECT * FROM (SELECT {Q.path('path')} AS np, size AS fs, mod_time_ns AS ft, content_hash AS fh, row_number() OVER (PARTITION BY {Q.path('path')} ORDER BY coalesce(updated_at, -1) DESC, coalesce(content_hash, '') DESC, path DESC, size DESC NULLS LAST, mod_time_ns DESC NULLS LAST) k FROM file_fingerprints) WHERE k = 1)"""


def _decided(content: bool, limit: int, strict: bool, last: int) -> str:
    kind = _KIND.replace("65536", str(limit)).replace("ELSE 'path:'", "ELSE NULL" if content else "ELSE 'path:'")
    same = "coalesce((starts_with(fh, 'content:') OR (starts_with(fh, 'path:') AND kind = 'path:')) AND size IS NOT DISTINCT FROM fs AND mod_time_ns IS NOT DISTINCT FROM ft, false)"
    fresh = f"coalesce(mod_time_ns, 0) // 1000000000 > {last}" if strict else "true"
    return f"""{_KNOWN}, c AS (SELECT DISTINCT path, size, mod_time_ns, is_dir, {Q.path('path')} AS np, {kind} AS kind FROM file_candidates),
de AS (SELECT c.path, c.size, c.mod_time_ns, c.is_dir, kind, CASE WHEN kind IS NULL OR {same} OR (fh IS NULL AND ft IS NULL AND NOT ({fresh})) THEN 'skip' WHEN kind = 'content:' THEN 'index_content' ELSE 'index_path' END AS action FROM c LEFT JOIN fp USING (np))"""


def _candidates(spark, base):
    return table(spark, base, "file_candidates").select("path", "size", "mod_time_ns", "is_dir").distinct()


@query_of("fingerprint_diff", f"WITH {_decided(False, 65536, True, 1900000000)} SELECT path, coalesce(size, -1) AS size, coalesce(mod_time_ns, -1) AS mod_time_ns, kind, action FROM de")
def fingerprint_diff(spark, base):
    return sync.decisions(_candidates(spark, base), table(spark, base, "file_fingerprints"), 1_900_000_000).select("path", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("mod_time_ns", F.lit(-1)).alias("mod_time_ns"), "kind", "action")


@query_of("backfill_upgrade", f"WITH {_decided(True, 1048576, False, 0)} SELECT path, size, action FROM de WHERE action = 'index_content'")
def backfill_upgrade(spark, base):
    return sync.backfill(_candidates(spark, base), table(spark, base, "file_fingerprints")).select("path", "size", "action")


@query_of("sync_summary", f"WITH {_decided(False, 65536, True, 1900000000)} SELECT count(*) AS scanned, count(*) FILTER (action <> 'skip') AS indexed, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'index_content') AS content FROM de")
def sync_summary(spark, base):
    return sync.summary(sync.decisions(_candidates(spark, base), table(spark, base, "file_fingerprints"), 1_900_000_000))


_FRESH = "CASE WHEN ordinal % 5 = 1 THEN hash || 'x' ELSE hash END"


def _fresh(spark, base) -> DataFrame:
    """A later state of the chunk table: some pieces changed, the last ones gone, a new one in front of others."""
    c = texts(spark, base, "chunks")
    f = c.where("ordinal % 7 != 6").withColumn("hash", F.expr(_FRESH)).select("source", "item_id", "ordinal", "hash", "title", *[x for x in c.columns if x not in ("source", "item_id", "ordinal", "hash", "title")])
    return f.unionByName(f.where("ordinal = 0").withColumn("ordinal", F.lit(100000)))


@query_of(
    "chunk_diff",
    f"""WITH f0 AS (SELECT source, item_id, ordinal, {_FRESH} AS hash, title FROM chunks WHERE ordinal % 7 <> 6), f1 AS (SELECT * FROM f0 UNION ALL SELECT source, item_id, 100000, hash, title FROM f0 WHERE ordinal = 0),
n AS (SELECT source, item_id, ordinal, min(struct_pack(h := hash, t := title)) AS x FROM f1 GROUP BY ALL), o AS (SELECT source, item_id, ordinal, min(struct_pack(r := row_id, h := hash, t := title)) AS x FROM chunks WHERE (source, item_id) IN (SELECT (source, item_id) FROM f1) GROUP BY ALL)
SELECT source, item_id, ordinal, CASE WHEN o.x IS NULL THEN 'insert' WHEN n.x IS NULL THEN 'delete' WHEN o.x.h IS NOT DISTINCT FROM n.x.h AND o.x.t IS NOT DISTINCT FROM n.x.t THEN 'keep' ELSE 'replace' END AS action, coalesce(o.x.r, -1) AS row_id FROM o FULL JOIN n USING (source, item_id, ordinal)""",
)
def chunk_diff(spark, base):
    return sync.chunk_diff(texts(spark, base, "chunks"), _fresh(spark, base)).withColumn("row_id", F.coalesce("row_id", F.lit(-1)))


@query_of("delete_subtree", f"SELECT row_id FROM chunks WHERE NOT coalesce(source = 'file' AND ({Q.path('path')} = '/home/padek/work' OR starts_with({Q.path('path')}, '/home/padek/work/')), false)")
def delete_subtree(spark, base):
    return sync.delete_subtree(texts(spark, base, "chunks"), "/home/padek/Work/").select("row_id")


@query_of("delete_subtrees", rf"SELECT row_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {Q.path('path')} AS g FROM file_candidates WHERE is_dir) WHERE c.source = 'file' AND ({Q.path('c.path')} = g OR starts_with({Q.path('c.path')}, g || '/')))")
def delete_subtrees(spark, base):
    """Every listed folder is removed at once, with all below it."""
    return sync.delete_subtrees(texts(spark, base, "chunks"), table(spark, base, "file_candidates").where("is_dir").select("path")).select("row_id")


@query_of("delete_items", "SELECT row_id FROM chunks WHERE (source, item_id) NOT IN (SELECT source, item_id FROM chunks WHERE ordinal = 1 AND item_id IS NOT NULL)")
def delete_items(spark, base):
    c = texts(spark, base, "chunks")
    return sync.delete_items(c, c.where("ordinal = 1")).select("row_id")


@query_of("sync_state", "SELECT adapter_id, max(read_upto) AS last_sync_time FROM sync_runs WHERE status = 'success' AND adapter_id IS NOT NULL AND read_upto IS NOT NULL GROUP BY adapter_id")
def sync_state(spark, base):
    """Watermarks written to a versioned table and read again."""
    from corpusmill import schema

    t = sync.Table(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}", schema.SYNC_STATE)
    ok = table(spark, base, "sync_runs").where("status = 'success' and adapter_id is not null and read_upto is not null")
    t.write(ok.groupBy("adapter_id").agg(F.min("read_upto").alias("last_sync_time"), F.lit(0).cast("bigint").alias("updated_at")))
    t.write(ok.groupBy("adapter_id").agg(F.max("read_upto").alias("last_sync_time"), F.lit(1).cast("bigint").alias("updated_at")))
    return t.read().select("adapter_id", "last_sync_time")


@query_of("records_under", rf"SELECT DISTINCT path, content_hash FROM file_fingerprints WHERE {Q.path('path')} = 'c:/users/quen' OR starts_with({Q.path('path')}, 'c:/users/quen/') OR starts_with({Q.path('path')}, '/home/minsa/')")
def records_under(spark, base):
    return sync.records_under(table(spark, base, "file_fingerprints"), ["C:\\Users\\quen", "/home/minsa"]).select("path", "content_hash").distinct()


@query_of(
    "upsert_fingerprints",
    """WITH b AS (SELECT path, size, mod_time_ns, content_hash, updated_at, 0 AS p FROM file_fingerprints UNION ALL SELECT path, size, mod_time_ns, content_hash, NULL, 1 FROM file_candidates WHERE NOT is_dir)
SELECT path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p DESC, coalesce(updated_at, -1) DESC, size DESC NULLS LAST, mod_time_ns DESC NULLS LAST, content_hash DESC NULLS LAST) k FROM b) WHERE k = 1""",
)
def upsert_fingerprints(spark, base):
    fresh = table(spark, base, "file_candidates").where("not is_dir").select("path", "size", "mod_time_ns", "content_hash", F.lit(None).cast("bigint").alias("updated_at"))
    stored = table(spark, base, "file_fingerprints")
    return sync.upsert_records(stored, fresh.select(*stored.columns)).select("path", "content_hash")


_MARKS = "m AS (SELECT adapter_id AS source, max(read_upto) AS mark FROM sync_runs WHERE status = 'success' GROUP BY adapter_id)"


def _marks(spark, base):
    return table(spark, base, "sync_runs").where("status = 'success'").groupBy(F.col("adapter_id").alias("source")).agg(F.max("read_upto").alias("mark"))


@query_of("watermark_sync", f"WITH {_MARKS} SELECT DISTINCT source, id, updated_at FROM data_items LEFT JOIN m USING (source) WHERE updated_at > coalesce(mark, 0) AND {Q.trim('''coalesce(content, '')''')} <> ''")
def watermark_sync(spark, base):
    return sync.new_items(table(spark, base, "data_items"), _marks(spark, base)).select("source", "id", "updated_at").distinct()


@query_of("watermarks", f"WITH {_MARKS}, t AS (SELECT source, max(updated_at) AS top FROM data_items GROUP BY source) SELECT source, greatest(coalesce(mark, 0), coalesce(top, 0)) AS mark FROM m FULL JOIN t USING (source) WHERE greatest(coalesce(mark, 0), coalesce(top, 0)) > 0")
def watermarks(spark, base):
    return sync.watermarks(table(spark, base, "data_items"), _marks(spark, base))


_OP = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 4 WHEN 'signup' THEN 8 ELSE 16 END"


_TICKS = f"SELECT epoch_us(ts) // 1000000 AS second, user_id::VARCHAR AS path, bit_or({_OP}) AS ops FROM events GROUP BY ALL"


@query_of("watch_debounce", f"SELECT second, path, ops, CASE WHEN ops & 12 <> 0 THEN 'remove' ELSE 'change' END AS action FROM ({_TICKS}) WHERE ops & 15 <> 0")
def watch_debounce(spark, base):
    e = table(spark, base, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("path"), F.expr(_OP).alias("op"))
    a = watch.actions(watch.gathered(e, 1))
    return a.select(F.floor(F.unix_micros("tick") / 1_000_000).alias("second"), "path", "ops", "action")


@query_of("stream_watch", f"SELECT second, path, ops FROM ({_TICKS})")
def stream_watch(spark, base):
    """The events as a stream, gathered per second with state; what the last trigger gives is the whole."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, base, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("path"), F.expr(_OP).alias("op"))
    e.write.parquet(f"{at}/in")
    ticks = watch.gathered(spark.readStream.schema(e.schema).parquet(f"{at}/in"))
    q = ticks.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.floor(F.unix_micros("tick") / 1_000_000).alias("second"), "path", "ops")
