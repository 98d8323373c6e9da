import public_tokenizers as P
import pytest
from helpers import edge_docs, edge_rows, no_docs
from tokenizers import Tokenizer

from xmcforge.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_counts_equal_the_library(spark, tokenizer):
    got = count_tokens(edge_docs(spark), P.path("word_bpe_49k.json"), slice_bytes=1000).collect()
    want = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t, *_ in edge_rows()]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)


def test_special_strings_and_normal_forms(spark, tokenizer):
    texts = ["a<|endoftext|>b <|startoftext|>", "it's we're I'LL", "é ́x", "ΑΣ ΣΑΣ", "İstanbul", " a b", "12 345", "!?!"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.n_tokens for r in count_tokens(df, P.path("word_bpe_49k.json")).collect()}
    assert got == {t: len(tokenizer.encode(t, add_special_tokens=False)) for t in texts}


def test_empty_table_and_clashing_columns(spark):
    assert count_tokens(no_docs(spark), P.path("word_bpe_49k.json")).count() == 0
    df = spark.createDataFrame([("a b", "x", 1.5)], "text string, n_tokens string, n_bytes double")
    assert count_tokens(df, P.path("word_bpe_49k.json")).first().asDict() == {"text": "a b", "n_bytes": 3, "n_tokens": 2}
