import random

import pytest

from corpusmill.llm import tokens

PATH = f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}"


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_same_as_the_public_tokenizer(public):
    rng = random.Random(5)
    letters = "aeinst  \n\tÄß'.,0189—中文字日é😀|<>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(400)]
    texts += ["<|endoftext|>", "a" * 5000, " " * 3000, "don't  we'll\n\n x", "\u0000‍", "中" * 700]
    e = tokens.encoder(PATH)
    for t in texts:
        assert e.encode(t) == public.encode(t, add_special_tokens=False).ids


def test_piece_is_rank_merging():
    e = tokens.encoder(PATH)
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdeinorstu") for _ in range(rng.randrange(1, 25)))
        assert e.piece(w) == e.merge(w.encode())


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "   ", None), (3, "hi", "k")], "doc_id bigint, text string, key string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_table(df).collect())
    assert got[:2] == [(1, []), (2, [])] and len(got) == 4 and got[2][1] and got[3][1]
    assert tokens.encode_table(df.limit(0)).count() == 0
    assert [r.n_tokens for r in tokens.count_table(df, ["doc_id", "key"]).orderBy("doc_id", "n_tokens").collect()][:2] == [0, 0]
