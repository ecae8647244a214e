import random

import pytest

from corpusmill.operators import incremental as inc

CAND = "path string, size bigint, mod_time_ns bigint, is_dir boolean, content_hash string, part string"
FP = "path string, size bigint, mod_time_ns bigint, content_hash string, updated_at bigint, h string"
ITEM = "id string, source string, title string, content string, preview string, metadata string, created_at bigint, updated_at bigint, arrived_at bigint, mark string"
RUN = "run_id bigint, adapter_id string, started_at timestamp, finished_at timestamp, status string, read_upto bigint"


def norm(p):
    return p.replace("\\", "/").lower()


def brute_files(cands, fps):
    out = set()
    for c in cands:
        if c[3] or c[0] is None:
            continue
        mine = [f for f in fps if f[0] is not None and norm(f[0]) == norm(c[0])]
        top = max(((-1 if f[4] is None else f[4]) for f in mine), default=None)
        same = any(f[3] is not None and f[3] == c[4] for f in mine if (-1 if f[4] is None else f[4]) == top)
        if not same:
            out.add(("file", c[0]))
    return out


def test_files_against_brute_force(spark):
    rng = random.Random(3)
    paths = [f"/d{i % 7}/F{i}" for i in range(60)]
    spell = lambda p: rng.choice([p, p.lower(), p.replace("/", "\\"), p.upper()])
    cands = [(spell(rng.choice(paths)), rng.choice([None, 1]), 5, rng.random() < 0.1, rng.choice([None, "a", "b", "c"]), "x") for _ in range(150)]
    fps = [(rng.choice([None, *map(spell, paths)]), 1, 2, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2, 3]), "h") for _ in range(200)]
    c, f = spark.createDataFrame(cands + cands[:20], CAND), spark.createDataFrame(fps + fps[:30], FP)
    got = [("file", r.path) for r in inc.changed_files(c, f).select("path").distinct().collect()]
    assert set(got) == brute_files(cands, fps) and len(got) == len(set(got))


def test_items(spark):
    rows = [
        ("1", "chrome", "t", "c", None, None, 0, 10, 50, "k"),  # covered
        ("1", "chrome", "t", "c", None, None, 0, 10, 150, "k"),  # delivered again: same version
        ("2", "chrome", None, "c", None, None, 0, None, 150, "k"),  # new
        ("3", "chrome", "a", "c", None, None, 0, 20, 90, "k"),
        ("3", "chrome", "b", "c", None, None, 0, 15, 160, "k"),  # an older version that came late
        ("4", "edge", "a", "c", None, None, 0, 20, 1, "k"),  # adapter without a successful run
        ("5", "chrome", "a", "c", None, None, 0, 20, 90, "k"),
        ("5", "chrome", "z", "c", None, None, 0, 20, 101, "k"),  # tie within one second: the later arrival
    ]
    import datetime as dt

    t = lambda d: dt.datetime(2031, 1, d)
    runs = [(1, "chrome", t(1), None, "success", 40), (2, "chrome", t(3), None, "success", 100), (2, "chrome", t(3), None, "success", 100), (3, "chrome", t(9), None, "failed", 500), (4, "edge", t(2), None, "running", 9)]
    got = {(r.source, r.id) for r in inc.changed_items(spark.createDataFrame(rows, ITEM), spark.createDataFrame(runs, RUN)).collect()}
    assert got == {("chrome", "2"), ("edge", "4"), ("chrome", "5")}


def test_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert inc.found_rows(e(CAND), e(FP), e(ITEM), e(RUN)).count() == 0


def test_two_hashes_of_one_path_are_told_apart(spark):
    c = spark.createDataFrame([("/a/F", 1, 1, False, "x", "p"), ("/a/f", 1, 1, False, "y", "p")], CAND)
    f = spark.createDataFrame([("/a/f", 1, 1, "x", 1, "h"), ("/a/f", 1, 1, "y", 2, "h")], FP)
    assert {r.path for r in inc.changed_files(c, f).collect()} == {"/a/F"}


def test_only_partitions_that_differ_are_moved(spark, monkeypatch):
    """What is compared row by row falls with the share of unchanged partitions."""
    moved = []
    newest = inc.newest_fingerprints
    monkeypatch.setattr(inc, "newest_fingerprints", lambda f: moved.append(f.count()) or newest(f))
    n = 4000
    fps = spark.range(n).selectExpr("concat('/d/', id) as path", "1L as size", "1L as mod_time_ns", "concat('content:', id) as content_hash", "1L as updated_at")
    for share in (1, 10, 100, 1000):
        c = spark.range(n).selectExpr("concat('/d/', id) as path", "1L as size", "1L as mod_time_ns", "false as is_dir", f"if(id % {share} = 0, 'content:new', concat('content:', id)) as content_hash")
        assert inc.changed_files(c, fps).count() == n // share
    assert moved[0] == n and moved[3] < moved[2] < moved[1] and moved[2] < 0.25 * n and moved[3] < 0.15 * n


def test_state_survives_a_failed_run_without_skipping_or_repeating(spark, tmp_path):
    state = inc.PartitionedState(spark, str(tmp_path / "state"), ["k"], partitions=8)
    df = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "k int, v string")
    seen = []

    def step(part):
        seen.append(part.count())
        return part

    rows = lambda d: sorted((r.k, r.v) for r in d.collect())
    state.run(df, step)
    assert seen == [40] and rows(state.read()) == rows(df)
    state.run(df, step)
    assert seen[-1] == 0 and rows(state.read()) == rows(df)
    changed = spark.createDataFrame([(i, "new" if i == 7 else f"v{i}") for i in range(1, 41)], "k int, v string")

    def fails(part):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        state.run(changed, fails)
    assert rows(state.read()) == rows(df)
    state.run(changed, step)
    assert 0 < seen[-1] < 40 and rows(state.read()) == rows(changed)
    state.run(changed, step)
    assert seen[-1] == 0
    # All rows of a partition go, and a transform may give none.
    few = changed.where("k < 3")
    state.run(few, step)
    assert rows(state.read()) == rows(few)
    state.run(few.limit(0), lambda p: p)
    assert rows(state.read()) == []


def test_crash_after_the_data_changes_nothing(spark, tmp_path, monkeypatch):
    """Data of a run is written, its manifest is not; the source then goes back to what it was."""
    a = spark.createDataFrame([(i, f"a{i}") for i in range(20)], "k int, v string")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(20)], "k int, v string")
    rows = lambda d: sorted((r.k, r.v) for r in d.collect())
    state = inc.PartitionedState(spark, str(tmp_path / "state"), ["k"], partitions=4)
    state.run(a, lambda p: p)
    writer = type(a.write)
    parquet = writer.parquet

    def crash(self, path, *x, **y):
        if "manifests" in path:
            raise RuntimeError("lost")
        return parquet(self, path, *x, **y)

    monkeypatch.setattr(writer, "parquet", crash)
    with pytest.raises(RuntimeError):
        state.run(b, lambda p: p)
    monkeypatch.undo()
    assert rows(state.read()) == rows(a)
    assert state.run(a, lambda p: p).count() == 0 and rows(state.read()) == rows(a)
    state.run(b, lambda p: p)
    state.vacuum()
    assert rows(state.read()) == rows(b) and len(list((tmp_path / "state" / "data").glob("run=*"))) == 1


def test_partitions_follow_the_table(spark, tmp_path):
    state = inc.PartitionedState(spark, str(tmp_path / "state"), ["k"])
    df = spark.range(50).selectExpr("id as k", "id * 2 as v")
    state.run(df, lambda p: p)
    big = spark.range(5000).selectExpr("id as k", "id * 2 as v")
    state.run(big, lambda p: p)
    assert state.read().count() == 5000 and state.manifest().agg({"of": "max"}).first()[0] == inc.partitions_of(big)
    assert 0 < state.run(big.where("k != 7"), lambda p: p).count() <= 1
