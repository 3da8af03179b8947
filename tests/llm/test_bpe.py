import os
import random

import pytest

from eventloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}.tiktoken"), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


FIXED = [
    "a", "  ", " \n  x", "a   b", "a  \n b ", "x \t y", "it's we'LL 'd", "<|endoftext|>", "日本語のテキスト 123", "😀👩‍💻 ok", "\x00\x1c\x85\xa0", "é", "a\r\nb\r\n", "ab" * 4000, " " * 3000, "=" * 500, "0123456789" * 60,
]


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(reference, text):
    assert bpe.encoder().encode(text) == reference(text)
    assert bpe.encoder().count(text) == len(reference(text))


def test_random_texts(reference):
    rnd = random.Random(4)
    signs = [chr(i) for i in range(0x250)] + list(" \n\t'  日本😀") * 8
    for _ in range(4000):
        s = "".join(rnd.choice(signs) for _ in range(rnd.randrange(40)))
        assert bpe.encoder().encode(s) == reference(s)
    for letters in ("ab ", "etaoinshr", "01"):
        for _ in range(40):
            s = "".join(rnd.choice(letters) for _ in range(600))
            assert bpe.encoder().encode(s) == reference(s)


def test_ids_of_null_empty_repeated(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "two words", 0), (3, "two words", 0), (None, "x", 0)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.token_ids(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [11545, 2456]), (3, [11545, 2456]), (None, [87])], key=str)
    assert bpe.token_ids(df.limit(0)).count() == 0


def test_documents_match(spark, reference):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in bpe.token_ids(docs).collect():
        assert list(r.ids) == (reference(texts[r.doc_id]) if texts[r.doc_id] else [])
