from __future__ import annotations

import re

from pyspark.sql import functions as F

from larkspur.functions import text as tx
from larkspur.operators import analysis


def test_key_phrases_against_plain_python(spark) -> None:
    texts = [(1, "The central bank approved the merger. The central bank of records\nrecords records"), (2, None), (3, "a of"), (4, "")]
    scores: dict[str, float] = {}
    for part in re.split(r"[.!?]+\s+|[.!?]+$|\n+", texts[0][1]):
        run: list[str] = []
        for w in [*re.findall(r"[^\W_]+", part.lower()), "of"]:
            if len(w) <= 2 or w in tx.STOPWORDS:
                phrase = " ".join(run)
                if len(phrase) >= 4:
                    score = (1 + min(0.9, (len(run) - 1) * 0.35)) * (1 + min(0.6, (len(set(run)) - 1) * 0.2)) + 0.05 * sum(len(x) >= 7 for x in run)
                    scores[phrase] = scores.get(phrase, 0) + score
                run = []
            else:
                run.append(w)
    best = max(scores.values())
    expected = [(1, i + 1, p, round(s / best, 6)) for i, (p, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0])))]
    df = spark.createDataFrame(texts, "id bigint, text string")
    got = [(r.id, r.rank, r.phrase, r.score) for r in analysis.key_phrases(df, "id", "text", tx.STOPWORDS).orderBy("id", "rank").collect()]
    assert got == expected


def test_acronyms(spark) -> None:
    df = spark.createDataFrame([(1, "National Energy Board (NEB) met. NEB (some other body) said. GDP stands for gross domestic product. XY (z)"), (2, None), (3, "")], "id bigint, text string")
    got = {r.acronym: (r.expansion, r.confidence) for r in analysis.acronyms(df, "id", "text").collect()}
    assert got["NEB"] == ("National Energy Board", 0.95) and got["GDP"] == ("gross domestic product", 0.92) and "XY" not in got


def test_sections(spark) -> None:
    text = "Alpha energy prices rise\n\nenergy prices fall again\n\n\n\nCompletely different matter\r\n\r\nmatter different indeed"
    df = spark.createDataFrame([(1, text), (2, None), (3, " "), (None, "x")], "id bigint, text string")
    got = sorted(((r.id, r.section, r.paragraphs) for r in analysis.sections(df, "id", "text").collect()), key=str)
    assert got == sorted([(1, 0, 2), (1, 1, 2), (None, 0, 1)], key=str)


def test_near_duplicates_of_texts(spark) -> None:
    pairs = [("Same text", "same  TEXT", True), ("a" * 30, "a" * 30 + "b" * 10, True), ("a" * 30, "a" * 30 + "b" * 40, False), ("the merger of both energy firms", "merger of both the energy firms", True), ("one thing", "another matter", False), (None, "x", False), ("", "", False), ("abcdefghijklmnopqrstuvwxy", "abcdefghijklmnopqrstuvwxz", True)]
    df = spark.createDataFrame(pairs, "a string, b string, e boolean")
    assert all(r.e == r.g for r in df.select("e", analysis.near_duplicate(F.col("a"), F.col("b")).alias("g")).collect())


def test_rules(spark) -> None:
    rules = [("x", ["one"]), ("y", ["two", "ONE".lower()])]
    df = spark.createDataFrame([("One",), ("two",), (None,), ("z",)], "t string")
    assert [(r.a, r.b) for r in df.select(analysis.first_match(F.col("t"), rules).alias("a"), analysis.all_matches(F.col("t"), rules).alias("b")).collect()] == [("x", ["x", "y"]), ("y", ["y"]), (None, []), (None, [])]


def test_streams_in_one_file_and_in_folders(spark, tmp_path) -> None:
    from larkspur.streaming import jobs

    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 01:00:00", "a"), (1, "2024-01-01 02:00:00", "b"), (2, "2024-01-02 00:00:00", "a"), (1, "2024-01-03 00:00:00", "a")]
    df = spark.createDataFrame(rows, "k bigint, at string, d string").withColumn("at", F.col("at").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    stream = jobs.stream_of(spark, str(tmp_path), "t")
    found = jobs.to_table(jobs.versions(stream, "k", "at", "d"), "v").groupBy("k").agg(F.max("revision").alias("n")).collect()
    assert {r.k: r.n for r in found} == {1: 3, 2: 1}
    snap = jobs.to_snapshot(jobs.stream_of(spark, str(tmp_path), "t"), ["k"], [-F.unix_micros("at")], "s")
    assert {(r.k, r.d) for r in snap.collect()} == {(1, "a"), (2, "a")}
    first = jobs.to_table(jobs.first_of_digest(jobs.stream_of(spark, str(tmp_path), "t"), "at", F.col("d")), "f")
    assert sorted(r.d for r in first.collect()) == ["a", "b"]


def test_text_expressions_read_the_whole_text(spark) -> None:
    from pyspark.sql import functions as F

    from larkspur.plans.analysis_queries import expression_columns

    text = "x" * 90 + ", Caf\u00e9 Noir, the end"
    row = spark.createDataFrame([(text, 5)], "text string, n_chars int").select(*[c.alias(n) for n, c in expression_columns().items()]).first()
    assert row.fold == text.replace("\u00e9", "e") and row.entity == text.lower() and row.name.endswith("noir the end")
    assert row.spans == "Caf\u00e9 Noir" and row["items"] == "x" * 90 + "|Caf\u00e9 Noir|the end" and row.highlight.endswith("<mark>the</mark> end")
    assert row.punctuated == text + "." and row.capitalised == "X" + text[1:]


def test_fuzzy_pairs_wherever_the_edits_are(spark, tmp_path) -> None:
    from larkspur.plans.text_queries import levenshtein_fuzzy_join

    spark.createDataFrame([("Alpine Gold",)], "name string").write.parquet(f"{tmp_path}/companies.parquet")
    spark.createDataFrame([("elpine olpine lpine apline alpine fold bold silver gol",)], "title string").write.parquet(f"{tmp_path}/market_news.parquet")
    rows = {(r.term, r.known, r.distance) for r in levenshtein_fuzzy_join(spark, str(tmp_path)).collect()}
    assert rows == {("elpine", "alpine", 1), ("olpine", "alpine", 1), ("lpine", "alpine", 1), ("apline", "alpine", 2), ("fold", "gold", 1), ("bold", "gold", 1)}
