import pytest

from corpusmill.llm import encoding

TEXTS = [
    "Größere Übergabe für Müller, geprüft in Zürich",
    "L'été déjà passé à Évreux, français",
    "Вчера старый ноутбук потерял записи",
    "没有人复制过沙溪市的下载列表，所以又翻译了一遍",
    "“Well – that’s it”, said Ann",
]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "cp1250", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_round_trip(wrong, text):
    sloppy = "".join(bytes([b]).decode(wrong) if _has(b, wrong) else chr(b) for b in text.encode())
    fixed, found = encoding.repair(sloppy)
    assert found and fixed == text


def _has(b, name):
    try:
        bytes([b]).decode(name)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("text", TEXTS)
def test_ordinary_text_is_left_alone(text):
    assert encoding.repair(text) == (text, False)


def test_nested_layers_and_places():
    nested = "Bücher".encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(f"vorher größer {nested} nachher") == ("vorher größer Bücher nachher", True)


def test_other_families():
    assert encoding.repair("План поездки".encode("cp1251").decode("cp1252")) == ("План поездки", True)
    assert encoding.repair("临时的税务摘要".encode("gbk").decode("latin-1")) == ("临时的税务摘要", True)
    assert encoding.repair("归档的水表数据表".encode().decode("gbk", "replace"))[1]


def test_lost_characters_count():
    assert encoding.repair("Seg�n el informe")[1] and encoding.repair("ListÃ?n telefÃ³nico") == ("Listín telefónico", True)
    assert encoding.repair("¿Cómo? NÃO É?") == ("¿Cómo? NÃO É?", False)


def test_cyrillic_read_as_cyrillic():
    text = "Вчера домашний сервер потерял 8115 минут. Печатный список был отправлен."
    for read, meant in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "iso8859_5"), ("cp1251", "cp866")):
        assert encoding.repair(text.encode(meant).decode(read, "replace"))[1], (read, meant)
    assert encoding.repair("принтер готов. " + text.encode("koi8_r").decode("cp1251")) == ("принтер готов. " + text, True)
    for proper in ("План СССР и США МХММ", "Zwischen ХХТХ 17. Februar", "СРОЧНО ПРОЧИТАТЬ ВСЕМ", "ООО «Ромашка» и ИП"):
        assert encoding.repair(proper) == (proper, False)


def test_any_number_of_layers():
    text = "größer und schöner für alle"
    for n in range(1, 8):
        garbled = text
        for _ in range(n):
            garbled = garbled.encode().decode("latin-1")
        assert encoding.repair(garbled) == (text, True)


def test_other_double_bytes_and_utf16():
    assert encoding.repair("東京都の日本語のひらがな".encode("euc_jp").decode("latin-1"))[1]
    assert encoding.repair("안녕하세요반갑습니다".encode("euc_kr").decode("latin-1"))[1]
    assert encoding.repair("a plan".encode("utf-16-le").decode("latin-1")) == ("a plan", True)
    assert encoding.repair("a plan".encode("utf-16-le").decode("utf-16-be")) == ("a plan", True)
    assert encoding.repair("锟斤拷锟斤拷 plan")[1] and not encoding.repair("三斤 plan")[1]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "a", "k"), (2, "", "BÃ¼cher", None), (2, "", "BÃ¼cher", None), (3, "x" * 50000 + " Ã¼ber", None, "k")], "row_id bigint, content string, title string, key string")
    assert {tuple(r) for r in encoding.found_rows(df).collect()} == {(2, "title"), (3, "content")}
    assert encoding.repaired_values(df, "row_id", ["content", "title"]).count() == 3
    assert encoding.found_rows(df.limit(0)).count() == 0
