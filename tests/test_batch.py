"""Many searches at once: how much they move, and whether all are answered."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import batch, match, query
from corpusmill.plans import catalog
from corpusmill.session import table

REQUEST = "request_id bigint, query string, source string, file_type string, since_at bigint, until_at bigint, max_rows int, skip_rows int"


def rows_moved(spark, run):
    """Rows written to shuffles by what `run` starts."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = jvm.java.util.ArrayList()
    stages = lambda: store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    total = lambda s: sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))
    before = total(stages())
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, total(stages()) - before


@pytest.fixture(scope="module")
def same_words(spark):
    """Rows that all hold the words of all requests."""
    from corpusmill import schema

    known = {"row_id": F.col("id"), "title": F.lit("alpha beta"), "content": F.concat(F.lit("alpha beta gamma delta "), F.col("id").cast("string")), "updated_at": F.col("id")}
    return spark.range(1, 2001, 1, 2).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CHUNK])


def test_common_words_move_pages_only(spark, same_words, tmp_path):
    """40 strings of words that all 2,000 rows hold are 80,000 matches, of which 40 pages of one row are wanted."""
    from corpusmill.operators.index import Index

    ix = Index(spark, str(tmp_path / "ix"))
    ix.write(same_words)
    asked = spark.createDataFrame([(i, "alpha beta gamma" + " ." * i, None, None, None, None, 1, 0) for i in range(40)], REQUEST)
    got, moved = rows_moved(spark, lambda: batch.search_many(ix, asked).collect())
    assert {(r.request_id, r["rank"], r.row_id) for r in got} == {(i, 1, 2000) for i in range(40)}
    assert moved < 2000


def test_a_group_with_an_empty_phrase(spark, same_words):
    """Phrases without terms are left out of a group, as SQLite does."""
    asked = spark.createDataFrame([(1, 'NEAR("!!" alpha)', None, None, None, None, 1, 0), (2, "alpha*", None, None, None, None, 1, 0), (3, 'NEAR("!!" "?")', None, None, None, None, 1, 0)], REQUEST)
    assert [(r.request_id, r.row_id) for r in batch.search_rows(same_words, asked).orderBy("request_id").collect()] == [(1, 2000), (2, 2000)]


def test_blocks_give_the_same_as_one(spark, sf, monkeypatch):
    run = lambda: {tuple(r) for r in batch.search_rows(table(spark, sf, "chunks"), table(spark, sf, "search_requests")).collect()}
    one = run()
    monkeypatch.setattr(batch, "BLOCK", 12)
    assert one and run() == one


def test_every_request_is_answered(spark, sf):
    """requests of any number, not those divisible by 20 only; some of them against single searches of the texts."""
    got = {}
    for r in catalog.queries()["search_requests"](spark, sf).collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.row_id, r.score))
    assert any(i % 20 for i in got)
    chunks = table(spark, sf, "chunks")
    plain = table(spark, sf, "search_requests").where("request_id % 20 != 0 and query rlike '^[A-Za-z]+( [A-Za-z]+)*$'")
    some = plain.orderBy("request_id").limit(4).collect()
    assert some
    for r in some:
        limit, offset, _ = match.limits(r.max_rows, r.skip_rows)
        found = match.filtered(match.scored(chunks, query.parse(query.rewrite(r["query"]))), r.source, r.file_type, r.since_at, r.until_at)
        want = found.orderBy("score", F.desc("updated_at"), "row_id").limit(offset + limit).select("row_id", F.round("score", 6).alias("score")).collect()
        assert sorted(got.get(r.request_id, [])) == [(k + 1, x.row_id, x.score) for k, x in enumerate(want)][offset:], r["query"]
