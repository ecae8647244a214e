"""Matching and scores against SQLite's full-text index, and the parser's errors."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import match, query

QUERIES = [
    "alpha", "alp*", "alpha beta", "alpha AND beta", "alpha OR delta", "alpha NOT beta", '"alpha beta"', "alpha + beta", "^alpha", "NEAR(alpha delta, 2)", "NEAR(alpha delta)", "title : alpha", "{title content} : beta",
    "- title : beta", "(alpha OR beta) AND gamma", "alpha beta OR gamma NOT delta", "cafe", '"cafe noir"', "alpha NOT (beta OR gamma)", "title : (alpha OR beta) AND gamma", 'NEAR("alpha beta" gamma, 3)', "be* AND ga*",
]
WORDS = ["alpha", "beta", "gamma", "delta", "café", "Noir", "Beta-ray", "gamma_two", "naïve", "x"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    return [(i + 1, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 4))), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25)))) for i in range(200)]


@pytest.fixture(scope="module")
def chunks(spark, corpus):
    return spark.createDataFrame(corpus, "row_id bigint, title string, content string").cache()


@pytest.fixture(scope="module")
def fts(corpus):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(title, content, tokenize = 'unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, title, content) VALUES (?, ?, ?)", corpus)
    return con


@pytest.mark.parametrize("q", QUERIES)
def test_same_as_sqlite(chunks, fts, q):
    want = {r: round(s, 6) for r, s in fts.execute("SELECT rowid, bm25(t, 8.0, 1.0) FROM t WHERE t MATCH ?", (q,))}
    got = {r.row_id: round(r.score, 6) for r in match.scored(chunks, query.parse(q)).select("row_id", "score").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got)


@pytest.fixture(scope="module")
def stored(spark, chunks, tmp_path_factory):
    from corpusmill import schema
    from corpusmill.operators.index import Index

    have = set(chunks.columns)
    full = chunks.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.CHUNK])
    ix = Index(spark, str(tmp_path_factory.mktemp("ix")))
    ix.write(full)
    return ix


@pytest.mark.parametrize("q", QUERIES)
def test_stored_postings_give_the_same_as_sqlite(stored, fts, q):
    want = {r: round(s, 6) for r, s in fts.execute("SELECT rowid, bm25(t, 8.0, 1.0) FROM t WHERE t MATCH ?", (q,))}
    got = {r.row_id: round(r.score, 6) for r in match.scored_stored(stored, query.parse(q)).select("row_id", "score").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_stored_search_reads_no_text(stored):
    plan = match.scored_stored(stored, query.parse("alp*"))._jdf.queryExecution().executedPlan().toString()
    assert "content:string" not in plan and "StringStartsWith(token,alp)]" in plan


@pytest.mark.parametrize("q", ['"open', "alpha AND", "(alpha", "NEAR(alpha, x)", "body : alpha", "foo-bar", "AND"])
def test_errors(q):
    with pytest.raises(query.QuerySyntaxError):
        query.parse(q)


def test_rewrite():
    assert query.rewrite("floor plan") == "floor* AND plan*"
    assert query.rewrite("größe x") == '"größe" AND x*'
    assert query.rewrite("a linear fit") == "a linear fit"
    assert query.rewrite("rpc.php") == "rpc* AND php*"
    assert query.rewrite("!!!") == "" and query.parse("") is None
    assert query.cjk_query("备份方 x 案") == ["备份", "份方", "案"]


def test_paths_with_steps(spark):
    paths = {"/a/b/../c/./D": "/a/c/d", "C:\\A\\..\\b": "c:/b", "/../a": "/a", "../a/..": "..", "/a//b/": "/a/b", "a/..b/c..": "a/..b/c..", "": "", None: ""}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.n for r in df.select("p", text.normal_path(F.col("p")).alias("n")).collect()} == paths


def test_text_functions(spark):
    df = spark.createDataFrame([("a <b>c</b>\n\td\x0be<>  f", "x" * 221, "C:\\A\\b.TAR.gz", "中文字 a 国")], "a string, b string, p string, g string")
    r = df.select(text.clean(F.col("a")), text.preview(F.col("b")), text.base_name(F.col("p")), text.extension(F.col("p")), text.normal_path(F.col("p")), text.cjk_grams(F.col("g"))).first()
    assert r[0] == "a c de<> f" and r[1] == "x" * 220 + "..." and r[2:5] == ("b.TAR.gz", "gz", "c:/a/b.tar.gz") and r[5] == ["中文", "文字", "国"]


REQUEST = "request_id bigint, query string, source string, file_type string, since_at bigint, until_at bigint, max_rows int, skip_rows int"


def test_many_searches_give_what_single_ones_do(spark, sf, tmp_path):
    from corpusmill.engine import SearchRequest, stored_candidates
    from corpusmill.operators import batch, rank
    from corpusmill.operators.index import Index
    from corpusmill.session import table

    ix = Index(spark, str(tmp_path / "ix"))
    ix.write(table(spark, sf, "chunks"))
    asked = ["plan", "garden survey", '"search log"', "scanner OR informe", "plan NOT (floor OR travel)", "NEAR(old scanner, 3)", "title : plan*", "^annual*", "备份方", "打印的花园图纸", "résumé numérisé", "foo_bar plan", "plan plan", "zzz", '"open', "", "  ", "!!!", None]
    rows = [(i, q, None, None, None, 0, 30, 5 if i % 2 else 0) for i, q in enumerate(asked)] + [(100, "plan", "file", "md", 1_800_000_000, 1_929_000_000, 500, -3), (101, "plan", None, None, None, 0, 30, 0)]
    got = {}
    for r in batch.search_many(ix, spark.createDataFrame(rows, REQUEST)).collect():
        got.setdefault(r.request_id, []).append((r.rank, r.row_id, round(r.score, 6)))
    for i, q, source, kind, since, until, most, skip in rows:
        want = []
        if q and q.strip():
            try:
                r = SearchRequest(q, source or "", kind or "", since or 0, until or 0, most, max(skip, 0))
                limit, offset, _ = match.limits(r.limit, r.offset)
                top = stored_candidates(ix, r).orderBy(*rank.order()).limit(offset + limit).select("row_id", "score").collect()
                want = [(k + 1, x.row_id, round(x.score, 6)) for k, x in enumerate(top)][offset:]
            except query.QuerySyntaxError:
                pass
        assert sorted(got.get(i, [])) == want, q
    assert batch.search_many(ix, spark.createDataFrame([], REQUEST)).count() == 0


def test_segments_give_the_same_as_one(spark, chunks, tmp_path):
    """Rows that are added, replaced and left out in later segments, against an index of what remains."""
    from corpusmill import schema
    from corpusmill.operators.index import Index

    have = set(chunks.columns)
    full = chunks.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.CHUNK])
    ix, one = Index(spark, str(tmp_path / "many")), Index(spark, str(tmp_path / "one"))
    ix.write(full.where("row_id <= 120"))
    ix.update(full.where("row_id > 120"), full.where("row_id % 10 = 3"))
    changed = full.where("row_id % 7 = 0").withColumn("content", F.concat(F.lit("alpha beta "), "content"))
    ix.update(changed, full.where("row_id > 190").select("row_id"))
    ix.update(full.limit(0), full.where("row_id = 13").select("row_id"))
    gone = "row_id > 190 and row_id % 7 != 0 or row_id <= 120 and row_id % 10 = 3 and row_id % 7 != 0 or row_id = 13"
    one.write(full.where(f"not ({gone})").join(changed.select("row_id"), "row_id", "left_anti").select(*full.columns).unionByName(changed))
    assert len(ix.manifest()["segments"]) == 4 and len(one.manifest()["segments"]) == 1
    rows = lambda i, n: sorted(map(str, (r.asDict() for r in i.table(n).collect())))
    for n in ("chunks", "postings", "grams", "docs", "stats"):
        assert rows(ix, n) == rows(one, n), n
    for q in ("alp*", '"alpha beta"', "alpha NOT beta"):
        a, b = ({(r.row_id, round(r.score, 9)) for r in match.scored_stored(i, query.parse(q)).collect()} for i in (ix, one))
        assert a == b
    assert len(ix.versions()) == 2
