import json
import os
import threading
import time

import pytest

from corpusmill.engine import Engine, SearchRequest
from corpusmill.operators import rank


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "tree"
    (d / "design").mkdir(parents=True)
    (d / "node_modules" / "react").mkdir(parents=True)
    (d / "note.txt").write_text("the quarterly report of the unique-needle project")
    (d / "design" / "plan.md").write_text("# plan\nreact guide for the hall")
    (d / "node_modules" / "react" / "x.js").write_text("react")
    (d / "empty.txt").write_text("")
    (d / "table.xlsx").write_text("")
    (d / "bad.txt").write_bytes(b"caf\xc3\xa9 \xff ok")
    return d


def titles(r):
    return [x["title"] for x in r.results]


def test_index_search_incremental_delete(spark, tmp_path, tree):
    e = Engine(spark, str(tmp_path / "state"))
    assert e.search(SearchRequest("x")).results == []
    first = e.index_path(str(tree))
    assert first["indexed"] == 6  # four files with a name or text, one rich, one folder; nothing below node_modules
    assert e.index_path(str(tree))["indexed"] == 0
    assert titles(e.search(SearchRequest("unique-needle"))) == ["note.txt"]
    assert "design" in titles(e.search(SearchRequest("design")))
    assert titles(e.search(SearchRequest("table")))[:1] == ["table.xlsx"]
    assert titles(e.search(SearchRequest("empty")))[:1] == ["empty.txt"]
    assert titles(e.search(SearchRequest("cafe"))) == ["bad.txt"]
    time.sleep(1.1)
    (tree / "later.txt").write_text("a later needle")
    assert e.index_path(str(tree))["indexed"] >= 1
    assert set(titles(e.search(SearchRequest("needle")))) == {"note.txt", "later.txt"}
    os.remove(tree / "later.txt")
    assert "later.txt" in titles(e.search(SearchRequest("needle")))
    e.prune_missing(str(tree))
    assert titles(e.search(SearchRequest("needle"))) == ["note.txt"]
    e.delete_path(str(tree / "design"))
    assert "plan.md" not in titles(e.search(SearchRequest("plan")))
    assert e.watched_paths() == [str(tree)]
    out = json.loads(e.call(json.dumps({"type": "request", "id": "1", "method": "search", "params": {"query": "needle"}})))
    assert out["type"] == "response" and out["id"] == "1" and out["result"]["total"] == 1 and "error" not in out
    assert json.loads(e.call('{"type": "request", "id": "2", "method": "nothing"}'))["error"] == {"code": "core_error", "message": "unknown method: nothing"}
    assert json.loads(e.call('{"type": "request", "id": "3", "method": "search", "params": {"query": "\\"a"}}'))["error"]["code"] == "core_error"
    assert json.loads(e.call('{"id": "4", "method": "health"}'))["error"]["message"] == "invalid request envelope" and e.call("no json") is None
    assert json.loads(e.call('{"type": "request", "id": "5", "method": "index_path"}'))["error"]["message"] == "path is required"
    assert json.loads(e.call('{"type": "request", "id": "6", "method": "cancel_index"}'))["result"] == {"ok": True, "canceled": False}
    assert json.loads(e.call('{"type": "request", "id": "7", "method": "index_progress"}'))["result"]["active"] is False
    e.optimize()
    assert titles(e.search(SearchRequest("needle"))) == ["note.txt"]


def test_watch_stream_applies_changes(spark, tmp_path, tree):
    e = Engine(spark, str(tmp_path / "state"))
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join(json.dumps({"ts": "2031-01-01 00:00:00", "path": str(tree / n), "op": o}) for n, o in (("note.txt", 1), ("note.txt", 2))))
    events = spark.readStream.schema("ts timestamp, path string, op int").json(str(feed))
    e.watch(events, str(tmp_path / "cp"), once=True).awaitTermination()
    assert titles(e.search(SearchRequest("needle"))) == ["note.txt"] and e.warm_up() == 1
    (feed / "2.json").write_text(json.dumps({"ts": "2031-01-01 00:00:02", "path": str(tree / "note.txt"), "op": 4}))
    e.watch(events, str(tmp_path / "cp"), once=True).awaitTermination()
    assert titles(e.search(SearchRequest("needle"))) == []
    for _ in range(50):  # events of streams come a little later
        if e.streams.rows >= 3:
            break
        time.sleep(0.1)
    assert e.streams.rows >= 3 and e.streams.phase == "idle"
    assert len(e.index.manifest()["segments"]) > 1
    t = e.optimize_every(0.1)
    for _ in range(200):
        if len(e.index.manifest()["segments"]) == 1:
            break
        time.sleep(0.1)
    e.close()
    t.join(30)
    assert len(e.index.manifest()["segments"]) == 1 and not t.is_alive()


def test_browsers(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "state"))
    t = lambda s: (s + 11_644_473_600) * 1_000_000
    urls = spark.createDataFrame([("https://a.test/x", "Alpha page", t(1000), 3), ("https://a.test/y", None, t(2000), 1)], "url string, title string, last_visit_time bigint, visit_count bigint")
    tree = json.dumps({"roots": {"bar": {"type": "folder", "children": [{"type": "url", "name": "Beta", "url": "https://b.test", "date_added": str(t(1500))}, {"type": "folder", "children": [{"type": "url", "url": ""}]}]}}})
    marks = spark.createDataFrame([(tree,), ("broken",), (None,)], "tree string")
    assert e.sync_browsers({"chrome": urls}, bookmarks={"chrome": marks}) == {"chrome": 3}
    assert e.sync_browsers({"chrome": urls}, bookmarks={"chrome": marks}) == {"chrome": 0}
    assert titles(e.search(SearchRequest("alpha"))) == ["Alpha page"]
    assert titles(e.search(SearchRequest("beta", source="chrome"))) == ["Beta"]
    assert e.search(SearchRequest("beta", source="edge")).total == 0


def test_pause_holds_backfills_only(spark, tmp_path):
    d = tmp_path / "one"
    d.mkdir()
    (d / "note.txt").write_text("needle")
    e = Engine(spark, str(tmp_path / "state"))
    e.pause_content_index()
    failed = []

    def run():
        try:
            e.backfill(str(d))
        except RuntimeError as x:
            failed.append(str(x))

    t = threading.Thread(target=run)
    t.start()
    t.join(2)
    assert t.is_alive() and e.progress.phase == "paused"
    e.cancel_index()
    t.join(30)
    assert failed == ["cancelled"] and e.progress.phase == "idle"
    e._cancelled.clear()
    t = threading.Thread(target=e._wait_while_paused)
    t.start()
    t.join(1)
    assert t.is_alive()
    e.resume_content_index()
    t.join(30)
    assert not t.is_alive()
    e.pause_content_index()
    assert e.index_path(str(d), watch_it=False)["indexed"] >= 1 and not e.records.read().isEmpty()


def test_indexing_and_sync_jobs_carry_their_tags(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "state"))
    seen = []
    monkeypatch.setattr(e, "_index_path", lambda *a: seen.append(spark.getTags()) or {})
    monkeypatch.setattr(e, "_sync_browsers", lambda h, d, b: seen.append(spark.getTags()) or {n: t.count() for n, t in h.items()})
    e.index_path(str(tmp_path))
    spark.range(3).write.parquet(str(tmp_path / "urls"))
    call = json.dumps({"type": "request", "id": "1", "method": "sync_browsers", "params": {"histories": {"chrome": str(tmp_path / "urls")}}})
    assert json.loads(e.call(call))["result"] == {"chrome": 3}
    assert json.loads(e.call('{"type": "request", "id": "2", "method": "sync_browsers"}')) == {"type": "response", "id": "2", "result": {}}
    assert [{t.rsplit("-", 1)[1] for t in tags} for tags in seen] == [{"index"}, {"sync"}, {"sync"}] and not spark.getTags()


def test_fingerprints_are_those_of_the_chunks(spark, tmp_path):
    import hashlib

    d = tmp_path / "two"
    d.mkdir()
    (d / "a.txt").write_text("the river <b>runs</b>")
    (d / "b.bin").write_bytes(b"x")
    e = Engine(spark, str(tmp_path / "state"))
    e.index_path(str(d))
    hashes = {r.path: r.hash for r in e.chunks().collect()}
    want = {p: kind + hashlib.sha1(hashes[p].encode()).hexdigest() for p, kind in ((str(d / "a.txt"), "content:"), (str(d / "b.bin"), "path:"))}
    assert {r.path: r.content_hash for r in e.records.read().collect()} == want and hashes[str(d / "a.txt")] == hashlib.sha256(b"the river runs").hexdigest()


def test_a_page_at_the_limit_tells_of_more(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for i in range(230):
        (d / f"plan{i}.txt").write_text(f"the plan number {i}")
    e = Engine(spark, str(tmp_path / "state"))
    assert e.index_path(str(d))["indexed"] == 230
    page = e.search(SearchRequest("plan", limit=200))
    assert len(page.results) == 200 and page.has_more
    last = e.search(SearchRequest("plan", limit=200, offset=200))
    assert len(last.results) == 30 and not last.has_more
    assert not {r["row_id"] for r in page.results} & {r["row_id"] for r in last.results}


def test_rich_files_are_extracted_or_found_by_name(spark, tmp_path):
    d = tmp_path / "rich"
    d.mkdir()
    (d / "a.docx").write_bytes(b"PK zeppelin")
    (d / "b.docx").write_bytes(b"broken")
    (d / "c.docx").write_bytes(b"x" * (65 << 10))

    def extract(path, data):
        if data.startswith(b"broken"):
            raise ValueError("no archive")
        return data.decode().removeprefix("PK ")

    e = Engine(spark, str(tmp_path / "state"), extractor=extract)
    assert e.index_path(str(d))["indexed"] == 3
    assert titles(e.search(SearchRequest("zeppelin"))) == ["a.docx"] and set(titles(e.search(SearchRequest("docx")))) == {"a.docx", "b.docx", "c.docx"}
    assert e.backfill(str(d))["indexed"] == 1  # beyond the limit of the first pass
    plain = Engine(spark, str(tmp_path / "plain"))
    plain.index_path(str(d))
    assert titles(plain.search(SearchRequest("zeppelin"))) == [] and "a.docx" in titles(plain.search(SearchRequest("docx")))


def test_changes_are_applied_in_one_version(spark, tmp_path, tree):
    e = Engine(spark, str(tmp_path / "state"))
    e.index_path(str(tree))
    before = e.index.versions()[-1]
    (tree / "note.txt").write_text("a changed needle")
    (tree / "new").mkdir()
    (tree / "new" / "deep.txt").write_text("a deep needle")
    os.remove(tree / "design" / "plan.md")
    rows = [(str(tree / "note.txt"), "change"), (str(tree / "new"), "change"), (str(tree / "design"), "remove"), (str(tree / "nothing"), "change"), (str(tree / "x.tmp"), "change")]
    e.apply_changes(spark.createDataFrame(rows, "path string, action string"))
    assert e.index.versions()[-1] == before + 1
    assert set(titles(e.search(SearchRequest("needle")))) == {"note.txt", "deep.txt"} and titles(e.search(SearchRequest("quarterly"))) == []
    assert titles(e.search(SearchRequest("design"))) == []


def test_volume_roots_are_listed_by_names_then_backfilled(spark, tmp_path, tree, monkeypatch):
    from corpusmill import engine

    assert all(map(engine.is_volume_root, ("C:", "d:\\", "E:/", "/"))) and not engine.is_volume_root("C:/Users")
    monkeypatch.setattr(engine, "is_volume_root", lambda p: p == str(tree))
    e = Engine(spark, str(tmp_path / "state"), backfill_delay=0)
    e.index_path(str(tree))
    e._backfills[-1].join(120)
    assert titles(e.search(SearchRequest("unique-needle"))) == ["note.txt"] and e.progress.kind == "content" and e.progress.last_error == ""


def test_resync_after_a_restart(spark, tmp_path, tree):
    e = Engine(spark, str(tmp_path / "state"))
    e.index_path(str(tree))
    time.sleep(1.1)
    (tree / "offline.txt").write_text("an offline needle")
    again = Engine(spark, str(tmp_path / "state"))
    assert again.resync()[str(tree)]["indexed"] >= 1
    assert "offline.txt" in titles(again.search(SearchRequest("needle")))
    tree.rename(tmp_path / "elsewhere")
    again.resync()
    assert again.watched_paths() == [] and titles(again.search(SearchRequest("needle"))) == []


def test_browser_sync_takes_every_new_record(spark, tmp_path, monkeypatch):
    from corpusmill.sources import browser

    monkeypatch.setattr(browser, "HISTORY_TOP", 2)
    t = lambda s: (s + 11_644_473_600) * 1_000_000
    urls = spark.createDataFrame([(f"https://a.test/{i}", f"Page{i}", t(1000 + i), 1) for i in range(5)], "url string, title string, last_visit_time bigint, visit_count bigint")
    places = spark.createDataFrame([(1, "https://f.test", "Fox", 5_000_000, 2)], "id int, url string, title string, last_visit_date bigint, visit_count int")
    marks = spark.createDataFrame([(1, "Fern", 1, 7_000_000)], "fk int, title string, type int, dateAdded bigint")
    e = Engine(spark, str(tmp_path / "state"))
    assert e.sync_browsers({"chrome": urls, "firefox": places}, bookmarks={"firefox": (marks, places)}) == {"chrome": 5, "firefox": 2}
    assert titles(e.search(SearchRequest("page0"))) == ["Page0"] and titles(e.search(SearchRequest("fern"))) == ["Fern"]
    newest = Engine(spark, str(tmp_path / "newest"), complete=False)
    assert newest.sync_browsers({"chrome": urls}) == {"chrome": 2}


def test_stores_and_roots_of_a_user(tmp_path):
    from corpusmill.sources import browser, files

    for p in ("Google/Chrome/User Data/Default/History", "Microsoft/Edge/User Data/Default/Bookmarks", "Mozilla/Firefox/Profiles/x.default/places.sqlite"):
        (tmp_path / p).parent.mkdir(parents=True)
        (tmp_path / p).write_text("")
    (tmp_path / "Documents").mkdir()
    found = browser.profiles(str(tmp_path))
    assert set(found["histories"]) == {"chrome", "firefox"} and set(found["bookmarks"]) == {"edge"}
    assert files.default_roots(str(tmp_path)) == [str(tmp_path / "Documents")]


def test_profiles():
    p = rank.profile("rpc.php")
    assert p.filename and p.file and not p.bare
    assert rank.profile("design folder").folder and rank.profile("texas").bare and rank.profile("https://x.y").url
    assert rank.profile("clark").noisy and not rank.profile("react").noisy
