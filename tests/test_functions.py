from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from larkspur.functions import sketch, urls
from larkspur.functions import text as tx


def one(spark, column, value: str | None):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_tokenisers(spark) -> None:
    assert one(spark, tx.index_terms, "The Café's naïve A-1 plan, x") == ["cafe", "naive", "plan"]
    assert one(spark, tx.query_terms, "Café x") == ["cafe", "x"]
    assert one(spark, tx.words, "Ünï 12-b") == ["ünï", "12", "b"]
    assert one(spark, tx.words, None) == [] and one(spark, tx.index_terms, "") == []
    assert one(spark, tx.quoted_phrases, 'a "b c" "" "d\n"') == ["b c"]
    assert one(spark, tx.capitalised_spans, "Acme Corp met Acme Corp and Bob") == ["Acme Corp", "Bob"]
    assert one(spark, tx.name_tokens, "Horizon-Lab horizon!") == ["horizon", "lab"]
    assert one(spark, lambda c: tx.bigrams(tx.words(c)), "a b c") == ["a b", "b c"] and one(spark, lambda c: tx.bigrams(tx.words(c)), "a") == []


def test_normalisers(spark) -> None:
    assert one(spark, tx.entity_key, " The  Horizon--Lab - ") == "horizon-lab"
    assert one(spark, tx.token_key, " Works_At ") == "worksat"
    for word, stem in {"parties": "party", "running": "runn", "makers": "mak", "tied": "ti", "cats": "cat", "bob's": "bob", "as": "as", "boxes": "box", "played": "play"}.items():
        assert one(spark, tx.stem, word) == stem
    assert one(spark, tx.squeezed, " a \n b ") == "a b" and one(spark, lambda c: tx.preview(c, 6), "abcdefghij") == "abcde…"
    assert one(spark, tx.punctuated, "go") == "go." and one(spark, tx.punctuated, "go!") == "go!" and one(spark, tx.capitalised, "élan") == "Élan"
    assert one(spark, tx.list_items, "a, b\na") == ["a", "b"]
    assert one(spark, tx.syllables, "make") == 1 and one(spark, tx.syllables, "banana") == 3
    assert one(spark, tx.latest_year, "in 1999 and 2021, not 20215") == 2021 and one(spark, tx.latest_year, None) is None


def test_snippets(spark) -> None:
    text = "Short one. " + "The merger of both energy firms was approved by the regulator in spring. " + "x" * 400 + "."
    assert one(spark, lambda c: tx.snippet(c, ["merger", "energy"]), text).startswith("The merger")
    assert one(spark, lambda c: tx.highlighted(c, ["ab"]), "<AB> & ab") == "&lt;<mark>AB</mark>&gt; &amp; <mark>ab</mark>"
    assert one(spark, lambda c: tx.snippet(c, ["x"]), None) is None


def brute_simhash(tokens: list[str]) -> str:
    if not tokens:
        return "0" * 16
    votes = [0] * 64
    for t in tokens:
        bits = f"{int(hashlib.sha256(t.encode()).hexdigest()[:16], 16):064b}"
        votes = [v + (1 if b == "1" else -1) for v, b in zip(votes, bits)]
    return f"{int(''.join('1' if v >= 0 else '0' for v in votes), 2):016x}"


def test_simhash_and_distance(spark) -> None:
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["z"])]
    out = {r.id: r.simhash for r in sketch.simhash64(spark.createDataFrame(rows, "id bigint, t array<string>"), "id", F.col("t")).collect()}
    assert out == {i: brute_simhash(t or []) for i, t in rows}
    pair = spark.createDataFrame([("ffffffffffffffff", "fffffffffffffff0"), ("x", "ffffffffffffffff"), ("0000000000000001", "8000000000000000")], "a string, b string")
    assert [r.d for r in pair.select(sketch.hamming(F.col("a"), F.col("b")).alias("d")).collect()] == [4, 64, 2]
    assert one(spark, sketch.valid_hex16, " ABCDEF0123456789 ") == "abcdef0123456789" and one(spark, sketch.valid_hex16, "0" * 16) is None
    assert one(spark, sketch.content_digest, " A  b ") == hashlib.sha256(b"a b").hexdigest() and one(spark, sketch.content_digest, None) == ""


def test_urls(spark) -> None:
    assert one(spark, urls.canonical, "HTTPS://Www.A.example:8080/P/?b=2&UTM_source=x&a=1#f") == "https://www.a.example:8080/P?a=1&b=2"
    assert one(spark, urls.canonical, " ") is None and one(spark, urls.canonical, None) is None
    assert one(spark, urls.domain, "http://www2.A.example:80/x") == "a.example" and one(spark, urls.domain, None) == ""
    assert one(spark, urls.seed, "a.example/x") == "https://a.example/x" and one(spark, urls.seed, "nonsense") is None
    assert one(spark, urls.useful, "https://a.example/privacy/x") is False and one(spark, urls.useful, "https://a.example/news") is True
    assert one(spark, urls.readable_domain, "daily.news.example.com") == "Daily News Example"
