import pytest

from corpusmill.llm import markup

CASES = [
    ("<p>One <b>two</b></p>", ["html"]),
    ("Fish &amp; chips", ["html"]),
    ("ends here.</p> The heating", ["html"]),
    ("## Head\n\ntext", ["markdown"]),
    ("see [the plan](notes/a.md) now", ["markdown"]),
    ("| a | n |\n|---|--:|\n| x | 1 |", ["markdown"]),
    ("```\n<p>code</p>\n\\section{x}\n```\n", ["markdown"]),
    ("== Head ==\n[[Page|text]] '''bold'''", ["wiki"]),
    ('{| class="wikitable"\n! a !! n\n|-\n| x || 1\n|}', ["wiki"]),
    ("\\section{A}\n\\begin{verbatim}\n<p>x</p>\n\\end{verbatim}", ["latex"]),
    ("where $\\alpha_{5} \\le 9908$ holds", ["latex"]),
    ("<p>x</p>\n\n**bold** words", ["html", "markdown"]),
    ("use my_file_name_260 or __init__ as the name", []),
    ("Cost: $1806 to $7111 per box, see C:\\temp\\new\\801", []),
    ("path \\\\nas\\share\\sum\\alpha\\61", []),
    ("From: Ann <ann@post.example>", []),
    ('fmt.Fprintf(w, "<td>%s</td>", rows[i])\nbuf := make(map[string]*item, n<<2)', []),
    ("# a comment about things.\n\ndef f(a):\n    return a ** 2", []),
    ("rate is <5 % of 203, >2 % of the rest; R&D, Q&A", []),
    ("- item one\n* item two\n1. three", []),
    ("", []), (None, []), ("   ", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_kinds(text, want):
    assert markup.kinds_of(text) == want


def test_clean_keeps_structure():
    got = markup.clean("<h2>Title</h2><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table><pre>x &lt; y\nz</pre>")
    assert got.startswith("## Title") and "- one\n- two" in got and "a | b" in got and "```\nx < y\nz\n```" in got
    got = markup.clean("\\section{A}\n\\begin{equation}\n x^2\n\\end{equation}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\begin{tabular}{lr}\na & b \\\\\n\\hline\n\\end{tabular}")
    assert "# A" in got and "\\[x^2\\]" in got and "- one" in got and "a | b" in got and "begin" not in got
    got = markup.clean("== Head ==\n[[Page|text]] '''bold'''\n{| class=\"w\"\n! a !! n\n|-\n| x || 1\n|}")
    assert "# Head" in got and "text bold" in got and "a | n" in got and "x | 1" in got
    got = markup.clean("Title\n=====\n\n**bold** [a](b/c)\n\n| a | n |\n|---|--:|\n| x | 1 |")
    assert got.startswith("# Title") and "bold a" in got and "x | 1" in got and "---" not in got


def test_expressions_fold_and_align():
    e = markup.expression("<li>a</li><li>b</li><li>c</li>", markup.tokens("<li>a</li><li>b</li><li>c</li>"))
    assert e == (("+", "h<li", "#", "h</li"),)
    w = markup.align(("h<p", "#", "h</p"), ("h<p", "#", "h<br", "#", "h</p"))
    assert markup.written(w).startswith("h<p #PCDATA") and ")?" in markup.written(w)
    assert markup.align(w, ("h<p", "#", "h</p")) == w


def test_rows_and_wrappers(spark):
    rows = [(i, "file", f"C:\\d\\f{i}.x" if i % 2 else None, t, "clash") for i, (t, _) in enumerate(CASES)] + [(0, "file", None, CASES[0][0], "c")]
    df = spark.createDataFrame(rows, "row_id bigint, source string, path string, content string, markup string")
    want = {(i, k) for i, (_, ks) in enumerate(CASES) for k in ks}
    assert {tuple(r) for r in markup.found_rows(df).collect()} == want
    assert {r.row_id for r in markup.cleaned(df).collect()} == {i for i, _ in want}
    w = {r.host: r for r in markup.wrappers(df).collect()}
    assert set(w) == {"", "C:/d"} and sum(r.rows for r in markup.wrappers(df).collect()) >= len({i for i, _ in want}) + 1
    e = df.limit(0)
    assert markup.found_rows(e).count() == markup.wrappers(e).count() == markup.cleaned(e).count() == 0


def test_reference_links():
    text = "see [the plan][1] now\n\n[1]: https://a.example/x\n"
    assert markup.kinds_of(text) == ["markdown"] and markup.clean(text) == "see the plan now"
    assert markup.kinds_of("see [1] and [20] in the footnotes, key=[3, 4], a[i][j]") == []


def test_long_streams_fold_whole():
    assert markup.fold(tuple("abcdefghijklmnopq") * 3) == (("+", *"abcdefghijklmnopq"),)
    assert markup.fold(tuple("aab" * 4)) == (("+", ("+", "a"), "b"),)
    long = tuple(f"x{i}" for i in range(3000))
    assert markup.align(long, long[:10] + long[11:])[10] == ("?", "x10") and len(markup.align(long, long)) == 3000


def test_wrappers_decide_what_a_row_leaves_open(spark):
    pages = [f"<p>Case {i}</p><ticket>room {i}</ticket><p>end</p>" for i in range(40)]
    rows = [(i, "file", f"/d/f{i}", t) for i, t in enumerate(pages)]
    rows += [(100, "file", "/d/cut", "room 7</ticket> and more"), (101, "file", "/e/cut", "room 7</ticket> and more"), (102, "file", "/e/xml", "<stock><item>1</item></stock>")]
    rows += [(200 + i, "file", f"/m/{i}", f"## Head\n\n> said {i}\n\n[a](b/c.md)") for i in range(3)] + [(210, "file", "/m/q", "> said 9"), (211, "file", "/n/q", "> said 9")]
    df = spark.createDataFrame(rows, "row_id bigint, source string, path string, content string")
    own = {(r.row_id, r.markup) for r in markup.found_rows(df, decide=False).collect()}
    found = {(r.row_id, r.markup) for r in markup.found_rows(df).collect()}
    assert found - own == {(100, "html"), (210, "markdown")} and not own - found
    clean = {r.row_id: r.clean for r in markup.cleaned(df).collect()}
    assert clean[100] == "room 7 and more" and clean[210] == "said 9" and not {101, 102, 211} & set(clean)
    assert "ticket" not in clean[3]


def test_wrapper_is_the_same_however_the_table_is_split(spark):
    rows = [(i, "file", "/d/f", "<ul>" + "<li>a</li>" * (i % 7) + "<br>" * (i % 3) + "</ul>" + "<p>x</p>" * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id bigint, source string, path string, content string")
    one, many = ({tuple(r) for r in markup.wrappers(df.repartition(n)).collect()} for n in (1, 7))
    assert one == many and sum(r[1] for r in one) == 300
