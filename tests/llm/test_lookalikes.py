import pytest

from corpusmill.llm import lookalikes

CASES = {
    "Ｌｏｋａｌｅ Steuerbescheid": "Lokale Steuerbescheid",
    "genealógico": "genealógico",
    "Ab͏lage­ordner": "Ablageordner",
    "Moil-68 Schulungsplan": "Moil-68 Schulungsplan",
    "tеѕt prοtοcοl": "test protocol",
    "План пoeздки": "План поездки",
    "Nächste ВРКОК Werkstattzettel": "Nächste BPKOK Werkstattzettel",
    "﻿Vorläuﬁge Kartei": "Vorläufige Kartei",
    "Kaly河⽥市林": "Kaly河田市林",
    "﻿": "",
}
PROPER = [
    "加密的，就把它交给；看法不同：一个说？", "Wi-Fi мост", "On the box: «Осторожно, стекло»", "The α-value and the Δt", "\U0001f469‍\U0001f33e ✔️ ❤️",
    "می‌خواهم", "10⁶ m² ½ № 7 ª 3º", "“Well – that’s it”", "Größere Übergabe, Ștefana, Nguyễn", "Отчёт о проверке хор со всеми", "line\n\ttab", "Είσοδος", "", "   ", None,
]


@pytest.fixture(scope="module")
def result(spark):
    texts = [*CASES, *PROPER]
    rows = [(i, t, "BÃ¼cher Plan" if i == 0 else None, "clash") for i, t in enumerate(texts)] + [(0, texts[0], None, "clash")]
    df = spark.createDataFrame(rows, "row_id bigint, content string, title string, token string")
    tables = [(df, "row_id", "content", "content"), (df, "row_id", "title", "title")]
    found = {tuple(r) for r in lookalikes.found_rows(tables).collect()}
    fixed = {(r.field, r.row_id): r.normalized for r in lookalikes.normalized(tables).collect()}
    return found, fixed


def test_cases_found_and_normalized(result):
    found, fixed = result
    assert fixed == {("content", i): want for i, want in enumerate(CASES.values())}
    assert found == set(fixed)


def test_wrong_encoding_is_left_to_its_operator(result):
    assert ("title", 0) not in result[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id bigint, content string")
    assert lookalikes.found_rows([(df, "row_id", "content", "content")]).count() == 0
    assert lookalikes.normalized([(df, "row_id", "content", "content")]).count() == 0


def test_classes_of_the_collation_choose_what_occurs(spark):
    texts = ["genealógico y largo", "genealógico", "Ab​lage", "Die Ablage", "ráro", "РНКС 访谈"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, content string")
    rows = lambda **k: {r.row_id for r in lookalikes.found_rows([(df, "row_id", "content", "content")], **k).collect()}
    assert rows() == {1, 2, 4, 5}
    assert rows(spell=False) == {1, 2, 5}  # no composed form of the fifth occurs
    assert rows(spell=False, collation="UTF8_BINARY") == {5}


def test_look_alikes_are_those_of_unicode(spark):
    table = lookalikes.twins()
    assert {"а": "a", "Ѕ": "S", "ё": "ë", "ԝ": "w"}.items() <= table["cyrillic"].items() and "г" not in table["cyrillic"]
    assert table["greek"]["ο"] == "o" and "α" not in table["greek"] and table["armenian"]["օ"] == "o"


def test_words_of_twins_only(spark):
    texts = ["gate с 1 2 3", "ВЕН 2031 ------------------------ hall", "ΑΒΕ gate", "сор", "Wi-Fi с Anna дома", "а с сор", "size Α and Β"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, content string")
    got = {r.row_id: r.normalized for r in lookalikes.normalized([(df, "row_id", "content", "content")]).collect()}
    assert got == {0: "gate c 1 2 3", 1: "BEH 2031 ------------------------ hall", 2: "ABE gate"}


def test_very_long_values(spark):
    texts = ["слово и дело. " * 20000 + "ｗｉｄｅ", "plain words here " * 20000 + "с ВЕН", "- 1 " * 50000 + "ВЕН gate"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, content string")
    assert {r.row_id for r in lookalikes.found_rows([(df, "row_id", "content", "content")]).collect()} == {0, 1, 2}
