from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from larkspur.operators import crawl, dedupe, model, refine, reports
from larkspur.sources import readers
from larkspur.sources.tables import Rounds, exists, scratch, spread, written


def values(spark, texts: list, column) -> list:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", column(F.col("text")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def test_sound_sentences(spark) -> None:
    cases = {
        "The company approved the merger.": True, "the company approved the merger.": False, "The company approved the merger": False, "Because the company approved it.": False, "Because rates rose, the company waited.": True,
        "Markets.": False, "Running quickly home.": False, "They said they waited they moved.": False, "Die Firma wächst schnell.": True, "": False, "(The team won the game.)": True,
    }
    assert values(spark, [*cases, None], refine.sound) == [*cases.values(), False]


def test_lines(spark) -> None:
    cases = {
        "": True, "Published 12:30 GMT": True, "updated 3 hours ago": True, "1,204 views": True, "12:30": True, "Revision 4": True, "+120 words": True, "high · 0.8": True, "· · ·": True, "see https://a.example/x": True,
        "Home News Sports": True, "Science sports": True, "Alden Orla": False, "The market moved": False, "He was paid for it in 3 parts": False, "qwe rty": True, "login": True,
    }
    assert values(spark, [*cases, None], refine.meaningless) == [*cases.values(), True]
    bars = {"home news menu": True, "home and a new menu for all of us here": False, "home 2 news": False, "": True, "home. news.": False, "the home": False}
    assert values(spark, [*bars, None], refine.navigation_cluster) == [*bars.values(), True]


def test_meaningful(spark) -> None:
    cases = {"The company approved the merger.": True, "- demand is growing": True, "home\nlogin": False, "": False, "one two three was here at night": True, "x1 x2 x3 x4 x5 is": False}
    assert values(spark, [*cases, None], refine.meaningful) == [*cases.values(), False]


def test_neighbours_and_contexts(spark) -> None:
    row = spark.range(1).select(refine.neighbours(F.array(F.lit("a"), F.lit("b"))).alias("n"), refine.context(F.split(F.lit("a b c d e f g h i j"), " "), F.lit(1)).alias("c"), refine.context(F.split(F.lit("a b c d e f g h i j"), " "), F.lit(9)).alias("d")).first()
    assert [tuple(x) for x in row.n] == [(None, "a", "b"), ("a", "b", None)] and row.c == list("abcdef") and row.d == list("ghij")


def test_short_forms(spark) -> None:
    long = "First one. " + "word " * 100
    assert values(spark, [None, " a ", long], reports.first_sentence) == ["", "a", "First one.…"]
    assert values(spark, [None, "a b", "x" * 300, "ab, " * 100], lambda t: reports.truncated(t, 10)) == ["", "a b", "x" * 10 + "…", "ab, ab…"]
    assert values(spark, ["WORD", "Word", "word", "x1", None], lambda t: reports.case_like(F.lit("other"), t)) == ["OTHER", "Other", "other", "other", "other"]
    assert values(spark, ["A a  bb BB c", "", None], reports.asked_words) == [["bb"], [], []]


def test_short_forms_that_end_at_the_end_of_a_line(spark) -> None:
    # The cut falls behind a line's end, so the word before it is whole; a line's end is no end of the text.
    texts = [f"ab cd ef.{end}more" for end in ("\n", "\r", "\u2028")] + ["ab cd ef\r\nmore", "ab cd \u2028"]
    assert values(spark, texts, lambda t: reports.truncated(t, 10)) == ["ab cd ef…", "ab cd ef…", "ab cd…", "ab cd ef…", "ab cd \u2028"]
    assert values(spark, ["ab \u2028" + "c" * 10, "ab cd \u2028"], lambda t: reports.first_sentence(t, 4)) == ["ab \u2028…", "ab c…"]


def test_scores(spark) -> None:
    df = spark.createDataFrame([("active", 4000, 12, "p", "t"), (None, None, None, None, " "), ("closed", 900, 6, "", "t")], "s string, n int, p int, a string, b string")
    assert [r.q for r in df.select(reports.source_quality(*[F.col(c) for c in "snpab"]).alias("q")).collect()] == [87.0, 63.0, 65.0]
    assert [r.f for r in spark.createDataFrame([(2025,), (2021,), (1990,), (None,), (2030,)], "y int").select(reports.freshness(F.col("y"), 2025).alias("f")).collect()] == [1.0, 0.5, 0.0, 0.5, 1.0]
    signals = spark.createDataFrame([(1.0, None), (0.0, 3.0)], "a double, b double")
    assert tuple(reports.signal_averages(signals, ["a", "b"]).first()) == (0.5, 1.0) and tuple(reports.signal_averages(signals.limit(0), ["a", "b"]).first()) == (0.5, 0.5)
    facts = spark.createDataFrame([("object", "owns", "acme"), ("subject", "owns", "acme"), ("subject", "owns", None), ("object", None, "acme"), ("subject", None, " ")], "r string, x string, c string")
    assert [r.d for r in facts.select(reports.described(F.col("r"), F.col("x"), F.col("c")).alias("d")).collect()] == ["Receives “owns” from acme.", "Links to acme via “owns”.", "Links via “owns”.", "Connected to acme.", None]
    counts = spark.createDataFrame([(1, "Rate", 2), (1, "rate", 5), (1, "home", 9), (1, "ab", 9), (1, "cost", 5), (1, None, 3)], "k int, t string, n int")
    assert [(r.rank, r.token.lower(), r["count"]) for r in reports.keywords(counts, "k", "t", "n").orderBy("rank").collect()] == [(1, "cost", 5), (2, "rate", 5)]


def test_queue_history_and_cache(spark) -> None:
    rows = [("a", 3, 0.5, 1), ("a", 1, 0.9, 2), ("b", None, 0.1, 3), ("c", 3, 0.50001, 0), ("d", 3, 0.7, 9), (None, 1, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, due int, p double, q int")
    assert [r.key for r in crawl.queue(df, F.col("k"), "due", "p", "q").orderBy("place").collect()] == ["b", "d", "c", "a"]
    assert crawl.queue(df.limit(0), F.col("k"), "due", "p", "q").count() == 0
    assert [r.q for r in crawl.newest(df, "due", "q", 2).collect()] == [0, 1]
    cache = crawl.SearchCache(spark, scratch(spark, "cache"), 2)
    assert cache.fetch("x", "2025-01-01 00:00:00") is None
    for i, at in enumerate(("2025-01-01 00:00:00", "2025-01-01 01:00:00", "2025-01-01 02:00:00", "2025-01-01 03:00:00")):
        cache.store(f"k{i % 3}", str(i), at)
    assert cache.fetch("k0", "2025-01-01 04:00:00") == "3" and cache.fetch("k1", "2025-01-01 04:00:00") is None and cache.fetch("k2", "2025-01-03 04:00:00") is None
    assert cache.fingerprint(" q ", {"b": 1, "a": 2}, 3) == cache.fingerprint("q", {"a": 2, "b": 1}, 3)


def test_models_are_kept_with_their_version(spark) -> None:
    path = scratch(spark, "model")
    assert model.load(spark, path, ({"a": 1.0}, 0.5)) == ({"a": 1.0}, 0.5)
    name = model.save(spark, path, {"a": 0.25}, -1.0)
    assert name == model.version({"a": 0.25}, -1.0) and model.load(spark, path) == ({"a": 0.25}, -1.0)


def test_readers(spark, tmp_path) -> None:
    pages = ["<p>One <b>two</b></p><P class=x> &amp; three&nbsp;</P><p> </p>", "no paragraphs", None]
    assert values(spark, pages, readers.fallback_paragraphs) == [["One two", "& three"], [], []]
    (tmp_path / "news.json").write_text(json.dumps([{"title": "t", "url": "u", "published_at": "p"}, {"title": "", "url": "u", "published_at": "p"}, {"url": "u"}]))
    assert [r.title for r in readers.read_news(spark, str(tmp_path / "news.json")).collect()] == ["t"]
    (tmp_path / "market.json").write_text(json.dumps({"companies": [{"symbol": "ab", "name": "old"}, {"symbol": "AB", "name": "new", "price": 1.5, "news": [{"title": "n"}]}, {"symbol": " "}]}))
    companies, news = readers.read_market(spark, str(tmp_path / "market.json"))
    assert [(r.symbol, r["name"], r.price) for r in companies.collect()] == [("AB", "new", 1.5)] and [(r.symbol, r.title) for r in news.collect()] == [("AB", "n")]
    (tmp_path / "words.txt").write_text("Alpha\n\nbeta \nalpha\n")
    assert sorted(r.word for r in readers.read_lexicon(spark, str(tmp_path / "words.txt")).collect()) == ["alpha", "beta"]
    (tmp_path / "graph.json").write_text(json.dumps({"triples": [{"subject": "a", "relation": "r", "object": "b"}], "sources": [{"url": "u", "topics": ["x"]}]}))
    held = readers.read_graph(spark, str(tmp_path / "graph.json"))
    assert held["triples"].count() == 1 and "topics" not in held["sources"].columns and held["synonyms"].count() == 0
    (tmp_path / "history.json").write_text(json.dumps([{"url": "u", "preview": "abc"}, {"url": ""}, {"url": "v", "revision": 3}]))
    assert sorted((r.url, r.revision, r.character_count, r.links) for r in readers.read_history(spark, str(tmp_path / "history.json")).collect()) == [("u", 1, 3, []), ("v", 3, 0, [])]


@pytest.mark.parametrize("seed", [1, 2])
def test_results_collapse_in_score_order(spark, seed: int) -> None:
    import random

    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i, float(rng.randint(0, 5)), None if i % 11 == 0 else f"{rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))):016x}") for i in range(80)]
    kept: list = []
    for i, _, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        near = next((k for k in kept if s and k[1] and bin(int(k[1], 16) ^ int(s, 16)).count("1") <= 4), None)
        if near:
            near[2] += 1
        else:
            kept.append([i, s, 0])
    got = dedupe.collapsed(spark.createDataFrame(rows, "id int, score double, s string"), "id", "score", "s").collect()
    assert sorted((r.id, r.collapsed) for r in got) == sorted((i, n) for i, _, n in kept)


def test_rounds_keep_the_last_table(spark) -> None:
    rounds = Rounds(spark, "rounds")
    first = rounds.next(spark.range(3))
    path = rounds.path
    second = rounds.next(first.where("id > 0"))
    assert second.count() == 2 and not exists(spark, path) and exists(spark, rounds.path)
    assert written(second, "kept").count() == 2 and spread(spark, 10, 100) == 4 and spread(spark, 10**9, 1000) == 10_000 and spread(spark, 10**12, 1000) > 10_000


def test_crawl_stays_on_its_host_and_within_its_limit(spark) -> None:
    from larkspur.functions import urls
    from larkspur.operators import links

    edges = spark.createDataFrame([("https://a.example/", "https://a.example/x"), ("https://a.example/x", "https://a.example/y"), ("https://a.example/", "https://b.example/"), ("https://b.example/", "https://b.example/z")], "s string, d string")
    same = links.crawled(edges, "s", "d", ["https://a.example/"], 3, urls.host, 10)
    assert [(r.node, r.depth) for r in same.orderBy("place").collect()] == [("https://a.example/", 0), ("https://a.example/x", 1), ("https://a.example/y", 2)]
    assert links.crawled(edges, "s", "d", ["https://a.example/"], 3, urls.host, 10, across=True).count() == 5
    assert links.crawled(edges, "s", "d", ["https://a.example/"], 1, urls.host, 1).count() == 1


def test_sinks(spark) -> None:
    from larkspur.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    path = scratch(spark, "text")
    sinks.export_text(df, path, F.concat(F.lit("line "), "t"))
    assert [r.value for r in spark.read.text(path).collect()] == ["line a"]
    assert sinks.chosen(df, ["t", "x", "t"]).columns == ["t"] and sinks.chosen(df, ["x"]).columns == ["n", "t"]


def test_news_search(spark) -> None:
    from larkspur.operators import news

    asked = news.profile('"rate cut" banks', {"banks": ["credit houses", "lenders"]})
    assert asked.terms == ["rate", "cut", "banks"] and asked.phrases == {"rate cut": 1.0, "credit houses": 0.85}
    assert asked.weights["lenders"] == 0.85 and asked.weights["credit"] == 0.7 and asked.weights["bank"] == 0.82 and asked.bigrams == ["rate cut", "cut banks"]
    rows = [
        (1, "The rate cut helps banks", ["Banks"], ["Central Bank"], 80.0, "2025-01-01 00:00:00", "article", True, "a.example"), (2, "Nothing of it", None, None, 95.0, None, "page", False, "b.example"),
        (3, None, None, None, None, None, None, None, None), (4, "A bankz paragraph", [], [None, "Banka"], 40.0, "2024-01-01 00:00:00", "error", True, "a.example"),
    ]
    docs = spark.createDataFrame(rows, "id bigint, text string, topics array<string>, entities array<string>, quality double, fetched_at string, content_type string, ingest boolean, domain string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    now = "2025-01-01 02:00:00"
    found = {r.id: r for r in news.search(docs, "id", asked, now).collect()}
    assert set(found) == {1, 4} and found[1].weight > found[4].weight and abs(found[1].weight - found[1].match - 80 - 12 - 12) < 1e-5 and abs(found[4].match - 1.5 - 1.2) < 1e-5
    # Without a query: 80 + 12 + 12, 95 + 4, 0, and 40 - 12.
    assert [(r.id, r.weight) for r in news.search(docs, "id", news.profile(""), now).collect()] == [(1, 104.0), (2, 99.0), (4, 28.0), (3, 0.0)]
    for name, wanted, ids in (("content_type", "error", {4}), ("source", "a.example", {1, 4}), ("ingestion", "ingested", {1, 4}), ("quality", "70_89", {1}), ("recency", "past_day", {1})):
        assert {r.id for r in news.search(docs, "id", asked, now, filters={name: wanted}).collect()} == ids
    with pytest.raises(ValueError):
        news.search(docs, "id", asked, now, filters={"colour": "red"})
    assert news.search(docs.limit(0), "id", asked, now).count() == 0
