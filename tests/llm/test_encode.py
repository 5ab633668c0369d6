import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import encode as E
from lodestar.llm import lexicon as L

pytestmark = pytest.mark.skipif(not os.path.exists(f"{E.TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def ranks():
    return E.load_ranks(f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_merges_as_the_public_tokenizer(text):
    import tiktoken

    r = E.load_ranks(f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken") if not hasattr(test_merges_as_the_public_tokenizer, "r") else test_merges_as_the_public_tokenizer.r
    test_merges_as_the_public_tokenizer.r = r
    enc = getattr(test_merges_as_the_public_tokenizer, "enc", None) or tiktoken.Encoding("own", pat_str=E.PIECES, mergeable_ranks=r, special_tokens={})
    test_merges_as_the_public_tokenizer.enc = enc
    import regex

    assert [i for p in regex.findall(E.PIECES, text) for i in E.merge(p.encode(), r)] == enc.encode_ordinary(text)


def test_whole_texts(spark, public):
    texts = ["", None, " ", "\n\n  x", "Hello world's don't", "<|endoftext|> is text", "日本語😀👩🏽‍💻", "e\u0301 é", "a" * 20_000, "tevezi.exe " * 3000, "  \u2003\u00a0 z", "١٢٣ 𝔘", "Hello"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'mine' as ids").repartition(3)
    got = {r.doc_id: list(r.ids) for r in E.encode_corpus(df).collect()}
    want = public.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == {i: w.ids for i, w in enumerate(want)}


def test_empty_table(spark):
    out = E.encode_corpus(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "ids"] and out.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(min_size=1, max_size=6), max_size=20))
def test_automaton(tmp_path_factory, words, others):
    import numpy as np

    words = sorted(words)
    p = tmp_path_factory.mktemp("lex") / "a"
    p.write_bytes(L.compile_lexicon([(w, [i, i + 1]) for i, w in enumerate(words)]))
    lex = L.Lexicon(str(p))
    asked = [*words, *others]
    n = np.array([len(w) for w in asked], np.int64)
    ranks = lex.ranks(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(n) - n, n)
    assert ranks.tolist() == [words.index(w) if w in set(words) else -1 for w in asked]
    for i in range(len(words)):
        assert lex.ids[lex.starts[i] : lex.starts[i + 1]].tolist() == [i, i + 1]


def test_automaton_shares_suffixes():
    a = L.build(sorted(x.encode() + b"ation" for x in ["n", "st", "r", "el"]))
    assert len(a["final"]) < 12
