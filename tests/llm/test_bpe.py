from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import bpe, packing

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabularies are not there")
tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def engines():
    ranks = bpe.load_ranks(PATH)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "  a", "a  ", "I'll've 'S", "x" * 5000, "=" * 700 + "a" * 50, "日本語のテキスト", "é ﬁ Ⅷ ½²", "<|endoftext|>", "a\x0bb\x1c\x85 　c", "\U0001f468‍\U0001f4bb" * 30, "Грермубылис", "​zero﻿", " 's 's"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(engines, text: str) -> None:
    own, other = engines
    assert own.encode(text) == other.encode_ordinary(text)
    fresh = bpe.Encoder(own.ranks)
    fresh.learn(set(fresh.find(text)))
    assert fresh.encode(text) == other.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=80))
def test_any_text_and_round_trip(engines, text: str) -> None:
    own, other = engines
    ids = own.encode(text)
    back = {v: k for k, v in own.ranks.items()} if not hasattr(own, "back") else own.back
    own.back = back
    assert b"".join(back[i] for i in ids).decode() == text
    if text.isascii():
        assert ids == other.encode_ordinary(text)


def test_long_words_merge_like_short_ones(engines) -> None:
    own, _ = engines
    for word in (b"abababab" * 12, b"internationalisation" * 5, bytes(range(33, 120))):
        bounds = bpe._merge_long(word, own.ranks)
        assert bounds == bpe.merge(word[:128], own.ranks) if len(word) <= 128 else b"".join(bounds) == word


def test_rows(spark) -> None:
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (3, None), (None, "a")], "id bigint, text string")
    got = sorted(((r.id, list(r.ids)) for r in bpe.encode_texts(df, "id", "text").collect()), key=str)
    assert got == sorted([(1, [31373, 995]), (2, []), (3, []), (3, []), (None, [64])], key=str)
    assert bpe.encode_texts(df.limit(0), "id", "text").count() == 0


def test_counts_of_all_tokenizers(spark) -> None:
    sentencepiece = pytest.importorskip("sentencepiece")
    texts = [t for t in ODD if t] + [" ▁a  b▁", "Hello  world"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {(r.id, r.tokenizer): r.tokens for r in packing.token_counts(df, "id", "text", ["byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k"]).collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{bpe.TOKENIZERS}/piece_bpe_32k.model")
    for i, t in enumerate(texts):
        assert got[i, "piece_bpe_32k"] == len(pieces.encode(t)) and got[i, "word_bpe_49k"] >= 0
