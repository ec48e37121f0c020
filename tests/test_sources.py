from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.functions import similarity
from larkspur.sources import readers, sinks

HTML = """<html lang="en"><head><title> A &amp; B </title><meta property="og:image" content="i.png"><meta name="description" content="d"><link rel="canonical" href="/c#x"></head>
<body><nav><p>menu</p></nav><p>One <b>two</b>
three</p><p></p><p>four<script>x()</script></p><a href="../up?q=1#f">u</a><a href="mailto:a@b">m</a><a href="//o.example/x">o</a><a href="#t">t</a></body></html>"""


def test_pages(spark) -> None:
    df = spark.createDataFrame([(HTML, "https://a.example/d/e/"), (None, None), ("", "x"), ("<p>open", "")], "h string, u string")
    first, *rest = [r.p for r in df.select(readers.page_of("h", "u").alias("p")).collect()]
    assert (first.title, first.paragraphs, first.lang, first.image, first.description, first.canonical) == ("A & B", ["One two three", "four"], "en", "i.png", "d", "https://a.example/c")
    assert first.links == ["https://a.example/d/up?q=1", "https://o.example/x"]
    assert [r.paragraphs for r in rest] == [[], [], ["open"]]


def test_articles(spark, tmp_path) -> None:
    (tmp_path / "a.jsonl").write_text('{"id": 1, "ts": 2, "title": "t", "lede": "l", "url": "u", "source": "s", "lang": "EN", "simhash": "AB"}\n\nnot json\n{"id": 0, "ts": 2, "title": "t", "lede": "l", "url": "u", "source": "s", "lang": "en"}\n{"id": 3, "ts": 2, "title": "t"}\n')
    rows = readers.read_articles(spark, str(tmp_path)).collect()
    assert [(r.id, r.lang, r.entities, r.simhash) for r in rows] == [(1, "en", [], "ab")]


def test_whole_files(spark, tmp_path) -> None:
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r.k for r in readers.read_json(spark, str(tmp_path), "k int").collect()] == [1]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>a</title><link>u</link><pubDate>d</pubDate></item><item><title>b</title></item></channel></rss>")
    assert [(r.title, r.url) for r in readers.read_feed(spark, str(tmp_path / "f.xml")).collect()] == [("a", "u")]
    assert readers.read_texts(spark, str(tmp_path / "a.json")).first().text == '{"k": 1}'


def test_pdf(spark, tmp_path) -> None:
    body = zlib.compress(rb"BT (Hello \(you\)) Tj [(W) -20 (orld\041)] TJ ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\nstream\n" + body + b"\nendstream\nendobj\n")
    assert [r.text for r in readers.read_pdfs(spark, str(tmp_path)).collect()] == ["Hello (you) World!"]
    assert readers.pdf_text(None) == readers.pdf_text(b"no") == ""


def test_versions_and_shards(spark, tmp_path) -> None:
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, id int")
    sinks.write_sharded(df, str(tmp_path / "s"), "term", ["term"])
    got = sinks.read_shard(spark, str(tmp_path / "s"), ["a", "c"], "term")
    assert sorted(r.id for r in got.collect()) == [1, 3] and "PartitionFilters: [" in got._jdf.queryExecution().toString()
    store = sinks.Versions(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        store.current()
    store.publish(df, "one")
    store.publish(df.where("id > 1"), "two")
    assert store.names() == ["one", "two"] and store.current().count() == 2
    with pytest.raises(ValueError):
        store.publish(df, "two")
    sinks.export_csv(df.withColumn("l", F.array("term", "term")), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("term = 'a'").first().l == "a;a"


def test_similarity(spark) -> None:
    df = spark.createDataFrame([("World", "Word"), ("", ""), (None, "a"), ("same", "same")], "a string, b string")
    got = [round(r.s, 3) for r in df.select(similarity.similar_text("a", "b").alias("s")).collect()]
    assert got == [88.889, 0.0, 0.0, 100.0]
    assert similarity.sound_key("Phone") == "FN" and similarity.sound_key(None) == "" and similarity.sound_key("Smith") == "SM0"
    assert similarity.sound_key("Knight") == similarity.sound_key("Night")
    assert df.select(similarity.metaphone("a")).count() == 4
