import pytest

from corpusmill.llm import residue

CASES = [
    "Dear {{first_name}},\nKind regards, %Your Name%",
    "We met in June and the minutes were long. Minutes of [company], written by @@fecha@@. Then we went home and wrote it all down.",
    "Sehr geehrte Person ____ (Betrag),\nvielen Dank",
    "Please enable JavaScript to view this page.",
    "Menu\nLogin\nHelp\n404 – the page you asked for could not be found.\nPowered by Abc-12",
    "<html><head><title>x</title></head><body><p class=msg>Votre session a expiré, reconnectez-vous.</p></body></html>",
    "Wiring diagram\n\nLorem ipsum dolora situm. Text goes here. Nullor lorem fermen dolora faucem adipor porto.",
    "登录已过期，请重新登录。\n© Momo team",
    "asdf asdf qwer jkl asdf Content coming soon.",
]
PROPER = [
    'I got "502 bad gateway" again while I sent the list to Ann. Then it went through.',
    "The old portal asked people to enable JavaScript. Since May the app shows the list without scripts.",
    "func f(n int) error {\n\treturn errors.New(\"not found\")\n}\nbuf := make(map[string]*item, n<<2)",
    "path: ${HOME}/data\nother: ${HOME}/x",
    "{{Infobox place\n| name = Xan\n}} [[Category:notes]]",
    "Home | Search | Contact\nThe committee met on Tuesday and agreed to paint the hall.",
    "Please fill in [x] for yes and [ ] for no: list [x], hours [ ].",
    "2031-02-04 ERROR GET /a returned 404 after 7 ms",
    None, "", "  \n ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "c") for i, t in enumerate(CASES + PROPER)]
    n = len(rows)
    rows += [(n + i, f"How to write a letter: put {{{{first_name}}}} where the name goes, Ann{i} said in room {i}.", "c") for i in range(5)]
    rows += [(n + 5, "ordinary words, " * 20000, "c"), (0, CASES[0], "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, name string")


def test_cases_and_decoys(docs):
    assert sorted(r.doc_id for r in residue.found_rows(docs).collect()) == list(range(len(CASES)))
    assert residue.kept_rows(docs).count() == docs.count() - len(CASES) - 1


def test_learned_notice(spark):
    known = "Access denied."
    rows = [(i, f"{known} The lift to floor {i} is closed for guests.") for i in range(6)]
    rows += [(10, "The lift to floor 9 is closed for guests."), (11, "Ann wrote a long letter about lifts.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id for r in residue.found_rows(df).collect()}
    assert 11 not in got and got <= {*range(6), 10}


def test_empty(spark):
    assert residue.found_rows(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_copies_close_no_slot(spark):
    left = "We met in May. Dear {{first_name}}, the hall is open."
    quoted = "How to write a template: put {{first_name}} where the name goes."
    rows = [(i, left) for i in range(4)] + [(10 + i, f"Room {i} is clean. Minutes of [company], room {i}.") for i in range(4)] + [(20, quoted)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in residue.found_rows(df).collect()} == {0, 1, 2, 3, 10, 11, 12, 13}


def test_long_notice_teaches(spark):
    page = "Access denied. The gate keeper {n} is asleep. Nobody may pass before ray {n} wakes... Knock again at {n}."
    rows = [(i, page.replace("{n}", str(i))) for i in range(6)] + [(10, "Ann wrote a long letter about lifts.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in residue.found_rows(df).collect()} == set(range(6))


def test_slots_are_induced_without_seeds(spark):
    brackets = ["{{%s}}", "[[%s]]", "<<%s>>", "@@%s@@", "${%s}", "%%%s%%"]
    rows = [(i, f"Report of the keeper {brackets[i % 6] % 'zorblax'}, room {i}. All is well.") for i in range(12)]
    rows += [(20, "We met in May. The wall is green and {{zorblax}} is not."), (21, "Report of the keeper ______, room 3.")]  # the name elsewhere, a blank in the slot
    rows += [(30 + i, f"path: ${{ROOT}}/{i}\nuse {{other{i}}} = 1") for i in range(5)] + [(40, "We met in June. ______ is a line."), (41, "Only {{once}} here and there.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = lambda **k: {r.doc_id for r in residue.found_rows(df, **k).collect()}
    assert found(seeds=False) == {*range(12), 20, 21}
    assert found(seeds=False, learn=False) == set()


def test_filled_records_show_the_slot(spark):
    rows = [(i, f"Dear guest number {i}, welcome.") for i in range(4)] + [(10, "Dear guest number ______, welcome."), (11, "Dear friend ______, welcome.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in residue.found_rows(df, seeds=False).collect()} == {10}


def test_pages_in_several_frames_are_notices_without_seeds(spark):
    gate = "The gate keeper is asleep at {n}. Knock again."
    frames = ["{}", "Menu\nLogin\n{}", "<p>{}</p>", "{}\n© Ann team", "Home | Search\n{}"]
    rows = [(i, f.format(gate.replace("{n}", str(i)))) for i, f in enumerate(frames)]
    rows += [(10 + i, f"Knock again. The roof leaks, room {i}.") for i in range(3)]  # reached from its neighbour, but that stands elsewhere as well
    rows += [(20, "The roof leaks, room 5."), (21, "The roof leaks, room 6."), (22, "Ann wrote that the gate keeper is asleep.")]
    rows += [(30 + i, f.format("A long tale of the hall. " * 30)) for i, f in enumerate(frames)]  # syndicated text
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in residue.found_rows(df, seeds=False).collect()} == set(range(5))
    assert residue.found_rows(df, seeds=False, learn=False).count() == 0


def test_long_line_with_many_places(spark):
    df = spark.createDataFrame([(1, "{a} " * 50000 + "{{first_name}}")], "doc_id bigint, text string")
    assert [r.doc_id for r in residue.found_rows(df).collect()] == [1]
