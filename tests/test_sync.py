import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.functions import chunking, keys
from corpusmill.operators import sync
from corpusmill.sources import browser, files
from corpusmill.streaming import watch


def chunk(row, item, ordinal, hash_, title="t", source="file", path="/a/b.txt"):
    return (row, f"{source}:{item}:{ordinal}", item, source, title, "text", "text", ordinal, hash_, path, "txt", "{}", 1, 2)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [chunk((3 << 56) | 1, "x", 0, "h0"), chunk((3 << 56) | 2, "x", 1, "h1"), chunk((3 << 56) | 3, "x", 2, "h2"), chunk((5 << 56) | 1, "y", 0, "k0", path="/a/c.txt"), chunk((5 << 56) | 2, "z", 0, "z0", source="chrome", path=None)]
    return spark.createDataFrame(rows, schema.CHUNK).cache()


def test_diff_of_equal_tables_keeps_all(stored):
    assert {r.action for r in sync.chunk_diff(stored, stored).collect()} == {"keep"}
    same = sync.apply_diff(stored, stored)
    assert sorted(map(tuple, same.collect()), key=str) == sorted(map(tuple, stored.collect()), key=str)


def test_diff_actions(spark, stored):
    fresh = spark.createDataFrame([chunk(None, "x", 0, "h0"), chunk(None, "x", 1, "new"), chunk(None, "x", 3, "h3"), chunk(None, "w", 0, "w0")], schema.CHUNK)
    got = {(r.item_id, r.ordinal): (r.action, r.row_id) for r in sync.chunk_diff(stored, fresh).collect()}
    top = 3 << 56
    assert got == {("x", 0): ("keep", top | 1), ("x", 1): ("replace", top | 2), ("x", 2): ("delete", top | 3), ("x", 3): ("insert", None), ("w", 0): ("insert", None)}
    new = {(r.item_id, r.ordinal): r for r in sync.apply_diff(stored, fresh).collect()}
    assert set(new) == {("x", 0), ("x", 1), ("x", 3), ("y", 0), ("z", 0), ("w", 0)}
    assert new["x", 1].hash == "new" and new["x", 1].row_id == top | 2
    assert len({r.row_id for r in new.values()}) == 6
    again = sync.apply_diff(sync.apply_diff(stored, fresh), fresh)
    assert {(r.item_id, r.ordinal, r.row_id) for r in again.collect()} == {(k[0], k[1], r.row_id) for k, r in new.items()}


def test_deletes(spark, stored):
    assert {r.item_id for r in sync.delete_subtree(stored, "/A/b.txt").collect()} == {"y", "z"}
    assert {r.item_id for r in sync.delete_subtree(stored, "\\a\\").collect()} == {"z"}
    assert {r.item_id for r in sync.delete_items(stored, stored.where("item_id = 'x'")).collect()} == {"y", "z"}
    listed = spark.createDataFrame([("/a/c.txt", 1, 1, False)], schema.CANDIDATE)
    assert {r.item_id for r in sync.prune_missing(stored, listed, "/a").collect()} == {"y", "z"}


def test_decisions(spark):
    sec = 1_000_000_000
    c = [("/a/new.txt", 5, 200 * sec, False), ("/a/old.txt", 5, 50 * sec, False), ("/a/same.txt", 5, 50 * sec, False), ("/a/named.txt", 5, 50 * sec, False), ("/a/Moved.txt", 6, 50 * sec, False), ("/a/pic.png", 5, 200 * sec, False), ("/a/big.txt", 1 << 20, 200 * sec, False), ("/a/dir", None, 200 * sec, True)]
    f = [("/a/same.txt", 5, 50 * sec, "content:1", 1), ("/a/named.txt", 5, 50 * sec, "path:1", 1), ("/A/moved.txt", 5, 50 * sec, "content:1", 1), ("/a/same.txt", 4, 50 * sec, "content:0", 0)]
    cands, known = spark.createDataFrame(c, schema.CANDIDATE), spark.createDataFrame(f, schema.FINGERPRINT)
    got = {r.path: r.action for r in sync.decisions(cands, known, 100).collect()}
    assert got == {"/a/new.txt": "index_content", "/a/old.txt": "skip", "/a/same.txt": "skip", "/a/named.txt": "index_content", "/a/Moved.txt": "index_content", "/a/pic.png": "index_path", "/a/big.txt": "index_path", "/a/dir": "index_path"}
    assert {r.path: r.action for r in sync.decisions(cands, known, 100, strict=False).collect()}["/a/old.txt"] == "index_content"
    assert {r.path for r in sync.backfill(cands, known).collect()} == {"/a/new.txt", "/a/old.txt", "/a/named.txt", "/a/Moved.txt", "/a/big.txt"}
    assert tuple(sync.summary(sync.decisions(cands, known, 100)).first()) == (8, 6, 2, 3)


def test_walk_predicates(spark):
    paths = {
        "/home/u/a.txt": True, "/home/u/.hidden": False, "/home/u/~$x.docx": False, "/home/u/node_modules/a.js": False, "/home/u/docs/a.md": False, "/home/u/x.tmp": False, "/home/u/Thumbs.db": False, "C:\\Windows\\a.txt": False, "C:\\Users\\u\\a.txt": True,
        "C:\\Users\\u\\AppData\\Local\\Google\\Chrome\\User Data\\x.txt": False, "/home/u/skin_blue/a.txt": False, "/home/u/plain/a~": False,
    }
    df = spark.createDataFrame([(p, 1, 1, False) for p in paths], schema.CANDIDATE)
    assert {r.path for r in files.admitted(df).collect()} == {p for p, ok in paths.items() if ok}


def test_marks_and_items(spark):
    items = spark.createDataFrame([("a", "chrome", "x", 10), ("b", "chrome", " ", 11), ("c", "chrome", "y", 5), ("d", "edge", "z", 1)], "id string, source string, content string, updated_at bigint")
    marks = spark.createDataFrame([("chrome", 5)], "source string, mark bigint")
    assert {r.id for r in sync.new_items(items, marks).collect()} == {"a", "d"}
    assert {r.id for r in sync.new_items(items, marks.limit(0), top=1).collect()} == {"a", "d"}
    assert {tuple(r) for r in sync.watermarks(items, marks).collect()} == {("chrome", 11), ("edge", 1)}


def test_chunks_cover_the_text(spark):
    text = "An English sentence. " * 120 + "中文字符测试"
    df = spark.createDataFrame([("i", "file", "t", text), ("j", "file", "t", "a" * 1024), ("k", "file", "t", "  "), ("l", "file", "t", None), ("m", "file", "t", "x" * 3000)], "id string, source string, title string, content string")
    by = {}
    for r in chunking.split_items(df).orderBy("ordinal").collect():
        by.setdefault(r.id, []).append(r)
    assert set(by) == {"i", "j", "m"} and len(by["j"]) == 1
    assert all(len(r.content) <= 1024 for rs in by.values() for r in rs)
    assert [r.ordinal for r in by["i"]] == list(range(len(by["i"])))
    assert all(r.content in text for r in by["i"]) and by["i"][-1].content.endswith("中文字符测试")
    assert [len(r.content) for r in by["m"]] == [1024, 1024, 1024, 228]
    streamed = {(r.id, r.ordinal, r.hash) for r in chunking.split_items(df, stream=True).collect() if r.id == "i"}
    assert streamed == {(r.id, r.ordinal, r.hash) for r in by["i"]}


def test_keys(spark):
    r = spark.range(1).select(keys.fnv1a32(F.lit("ab")), keys.fnv1a32(F.lit("")), keys.fnv1a32(F.lit("é")), keys.webkit_to_unix(F.lit(0).cast("bigint")), keys.webkit_to_unix(keys.unix_to_webkit(F.lit(1_900_000_000).cast("bigint")))).first()
    assert tuple(r) == (0x4D2505CA, 2166136261, _fnv("é"), 0, 1_900_000_000)


def _fnv(s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_firefox(spark):
    places = spark.createDataFrame([(1, "https://a.test", "A", 5_000_000, 2), (2, "https://b.test", None, None, 1)], "id int, url string, title string, last_visit_date bigint, visit_count int")
    assert [(r.id, r.updated_at) for r in browser.firefox_history(places).collect()] == [("https://a.test", 5)]
    marks = spark.createDataFrame([(1, None, 1, 7_000_000), (2, "own", 1, 8_000_000), (1, "x", 2, 9_000_000)], "fk int, title string, type int, dateAdded bigint")
    assert {(r.id, r.title, r.updated_at) for r in browser.firefox_bookmarks(marks, places).collect()} == {("bookmark:https://a.test", "A", 7), ("bookmark:https://b.test", "own", 8)}


def test_change_events(spark, tmp_path):
    t = lambda s: dt.datetime(2031, 1, 1, 0, 0, s)
    rows = [(t(0), "/a", 1), (t(0), "/a", 4), (t(1), "/a", 2), (t(0), "/b", 16)]
    e = spark.createDataFrame(rows, "ts timestamp, path string, op int")
    assert {(r.tick.second, r.path, r.action) for r in watch.actions(watch.gathered(e)).collect()} == {(0, "/a", "remove"), (1, "/a", "change")}
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "0 seconds")
    listener = watch.Progress()
    spark.streams.addListener(listener)
    q = stream.writeStream.outputMode("append").format("memory").queryName("ticks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.path, r.ops) for r in spark.table("ticks").collect()} <= {("/a", 5), ("/a", 2), ("/b", 16)}
    spark.streams.removeListener(listener)


def test_long_texts_are_cut_in_one_pass():
    import time

    whole = "A word and another one. " * 1_000_000
    began = time.time()
    parts = list(chunking.cut(whole))
    assert time.time() - began < 20 and all(len(p) <= chunking.SIZE for _, p in parts)
    assert [n for n, _ in parts] == list(range(len(parts))) and whole.rstrip().endswith(parts[-1][1])
