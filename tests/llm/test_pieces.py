import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pieces

TYPES = "row_id bigint, source string, item_id string, ordinal int, content string, file_type string, row_id2 string"


def rebuilt(parts, overlap):
    return parts[0] + "".join(p[overlap:] for p in parts[1:])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,。，x", min_size=1, max_size=400), st.integers(8, 60), st.integers(0, 30))
def test_within_size_overlapping_and_whole(text, size, overlap):
    overlap = min(overlap, size // 2)
    parts = pieces.split_text(text, size, overlap)
    assert all(len(p) <= size for p in parts)
    whole = parts[0]
    for a, b in zip(parts, parts[1:]):
        w = min(overlap, len(a))
        assert b.startswith(a[-w:] if w else "")
        whole += b[w:]
    assert whole == text


def test_cuts_at_the_strongest_boundary():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    assert pieces.split_text(text, 35, 0) == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven."]
    assert pieces.split_text("x" * 100, 40, 10) == ["x" * 40] * 3 or all(len(p) <= 40 for p in pieces.split_text("x" * 100, 40, 10))


def test_overlap_repair_keeps_what_is_repeated():
    before = "One long way to the old mill by the river"
    assert pieces.split_text("the old mill by the river is closed.", 80, 8, before) == ["he river is closed."]
    assert pieces.split_text("e river is closed.", 80, 8, before) == ["he rivere river is closed."]  # too short to be told from an accident
    assert pieces.split_text(" river is closed.", 80, 6, before) == [" river is closed."]  # the whole overlap


def test_an_accidental_repeat_is_kept():
    assert pieces.split_text("apple", 100, 20, "banana") == ["bananaapple"]
    assert pieces.split_text("-" * 30 + "x", 100, 5, "y" + "-" * 40) == ["-" * 30 + "x"]  # only the overlap itself is taken off


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefgh .\n", min_size=0, max_size=120), st.text(alphabet="abcdefgh .\n", min_size=0, max_size=120), st.integers(10, 60), st.integers(0, 30))
def test_nothing_is_lost_behind_another_piece(before, text, size, overlap):
    overlap = min(overlap, size // 2)
    parts = pieces.split_text(text, size, overlap, before)
    lead = min(overlap, len(before))
    whole = parts[0][lead:] + "".join(b[min(overlap, len(a)) :] for a, b in zip(parts, parts[1:]))
    k = len(text) - len(whole)
    assert whole == text[k:] and k >= 0
    assert k == 0 or before.endswith(text[:k]) and (k == overlap or k >= pieces.REPEAT)


def brute(rows, conf):
    out = set()
    for r in rows:
        if r[4] is None:
            continue
        size, over = conf.get(r[5], conf["default"])
        if len(r[4]) > size:
            out.add((r[0], "oversized"))
        for p in rows:
            if over and p[4] is not None and None not in (r[1], r[2], r[3]) and (p[1], p[2]) == (r[1], r[2]) and p[3] == r[3] - 1 and r[4][:over] != p[4][-over:]:
                out.add((r[0], "overlap"))
    return out


def test_faults_against_brute_force_and_consecutive_ordinals(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        content = None if rng.random() < 0.05 else "".join(rng.choice("ab. \n") for _ in range(rng.randrange(0, 60)))
        rows.append((i, rng.choice(["file", "chrome", None]), rng.choice(["x", "y", "z", None]), rng.choice([None, *range(40)]), content, rng.choice([None, "md", "csv", "??"]), "clash"))
    rows += [(1000 + r[0], *r[1:]) for r in rows[:30]]
    conf = {"default": (30, 4), "md": (20, 6), "csv": (25, 0)}
    df = spark.createDataFrame(rows, TYPES)
    s = spark.createDataFrame([(k, *v) for k, v in conf.items()], "file_type string, chunk_size int, chunk_overlap int")
    assert {tuple(r) for r in pieces.found_rows(df, s).collect()} == brute(rows, conf)
    got = pieces.all_pieces(df, s).collect()
    size = {r[0]: conf.get(r[5], conf["default"])[0] for r in rows}
    assert all(len(r.content) <= size[r.row_id] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source, r.item_id), []).append(r.ordinal)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_empty_tables_and_missing_settings(spark):
    df = spark.createDataFrame([], TYPES)
    s = spark.createDataFrame([], "file_type string, chunk_size int, chunk_overlap int")
    assert pieces.found_rows(df, s).count() == 0 and pieces.all_pieces(df, s).count() == 0
    one = spark.createDataFrame([(1, "file", "x", 0, "word " * 500, None, None)], TYPES)
    assert [tuple(r) for r in pieces.found_rows(one, s).collect()] == [(1, "oversized")]
    assert all(len(r.content) <= pieces.DEFAULT[0] for r in pieces.all_pieces(one, s).collect())
