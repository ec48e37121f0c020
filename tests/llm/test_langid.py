from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import langid

SAMPLES = {
    "en": ["the regulator approved the merger of both firms in the spring", "shares of the company moved ten percent after the report", "workers went home early when the plant was closed", "analysts say that a second round may follow this year"],
    "de": ["die aufsicht genehmigte den zusammenschluss beider firmen im frühjahr", "die aktien der firma bewegten sich nach dem bericht um zehn prozent", "die beschäftigten gingen früh nach hause als das werk schloss", "fachleute meinen eine zweite runde ist in diesem jahr möglich"],
    "fr": ["le régulateur a approuvé la fusion des deux entreprises au printemps", "le titre de la société a varié de dix pour cent après le rapport", "les salariés sont rentrés chez eux quand l’usine a fermé", "les analystes disent qu’un second tour est possible cette année"],
}


def test_code_lengths_are_those_of_the_context_trees() -> None:
    models = langid.Models({"a": ["abracadabra"], "b": ["banana band"]})

    def bits(train: str, text: str) -> float:
        pad = " " * langid.ORDER
        counts = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
        data = pad + train
        for k in range(langid.ORDER + 1):
            for i in range(k, len(data)):
                counts[k][data[i - k : i]][data[i]] += 1
        total, data = 0.0, pad + text
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER, -1, -1):
                c = counts[k].get(data[i - k : i])
                if not c:
                    continue
                n, t = sum(c.values()), len(c)
                if data[i] in c:
                    total -= math.log2(c[data[i]] / (n + t))
                    break
                total -= math.log2(t / (n + t))
            else:
                total += 8
        return total

    texts = ["abra", "bandana", "xyz", "a b", "é"[:0] + "ananas"]
    got = models.code_lengths(texts)
    expected = np.array([[bits("abracadabra", t), bits("banana band", t)] for t in texts])
    assert np.allclose(got, expected, atol=1e-3)


def test_held_out_sentences() -> None:
    models = langid.Models({g: t[:3] * 3 for g, t in SAMPLES.items()})
    best = [models.languages[i] for i in models.code_lengths([t[3] for t in SAMPLES.values()]).argmin(axis=1)]
    assert best == list(SAMPLES)


def test_wrong_labels_are_outvoted(spark) -> None:
    rng = random.Random(1)
    rows = []
    for i in range(300):
        true = rng.choice(list(SAMPLES))
        label = rng.choice(list(SAMPLES)) if rng.random() < 0.15 else true
        text = rng.choice(SAMPLES[true]) + f" number {rng.randint(1, 999)}."
        rows.append((i, text.capitalize(), label, true))
    df = spark.createDataFrame(rows, "id bigint, text string, label string, true string")
    models = langid.train(df, "id", "text", F.col("label"), list(SAMPLES))
    found = {r.id: (r.lang, r.confidence) for r in langid.language_segments(df, "id", "text", models).collect()}
    right = sum(found[i][0] == true for i, _, _, true in rows)
    assert right >= 0.98 * len(rows) and all(0.3 < c <= 1.0 for _, c in found.values())


@pytest.mark.parametrize(
    ("text", "count"),
    [
        (None, 0), ("", 0), ("  ", 0), ("PLEZUK 43.4 +42.0% | PLINWELX 8.4 -2.4%", 0), ("By Thea Trelworth, Flarstirholton Mentioned: Abc, Def.", 0), ("The vote was put off until the … Mentioned: Abc", 0),
        ("The vote was put off. The plant closed early on Friday. (Reporting by A B)", 2), ("Saturnino D. Mube told reporters the plan was off.", 1), ("Das Werk kostet nun 3,3 Mio. € und damit mehr als geplant.", 1),
        ("The vote was put off in Bonn.Le titre a varié mardi matin.", 2), ("LE PROJET COÛTERA PLUS CHER QUE PRÉVU.", 1), ("Read more", 0),
    ],
)
def test_sentences(text: str | None, count: int) -> None:
    assert len(langid.sentences(text)) == count


def test_segments_and_labels(spark) -> None:
    models = langid.Models({g: [s + "." for s in t] * 3 for g, t in SAMPLES.items()})
    mixed = ". ".join(s.capitalize() for s in (SAMPLES["en"][0], SAMPLES["en"][1], SAMPLES["de"][2], SAMPLES["en"][3])) + "."
    df = spark.createDataFrame([(1, mixed), (1, mixed), (2, None), (3, "")], "id bigint, text string")
    rows = sorted((r.id, r.seg, r.lang, r.n_sentences) for r in langid.language_segments(df, "id", "text", models).collect())
    assert rows == sorted([(1, 0, "en", 2), (1, 1, "de", 1), (1, 2, "en", 1)] * 2)
    names = {"en": "en", "eng": "en", "english": "en", "pt": "pt", "português": "pt"}
    labels = spark.createDataFrame([(" EN-gb ",), ("pt_BR",), ("Português",), ("xx",), (None,), ("",)], "l string")
    assert [r.c for r in labels.select(langid.label_code(F.col("l"), names).alias("c")).collect()] == ["en", "pt", "pt", None, None, None]


def test_every_article_has_a_language(spark) -> None:
    models = langid.Models({g: [s + "." for s in t] * 3 for g, t in SAMPLES.items()})
    rows = [(1, SAMPLES["de"][0], None), (2, SAMPLES["en"][0], " "), (3, None, ". ".join((SAMPLES["de"][1], SAMPLES["de"][2])) + "."), (4, None, SAMPLES["en"][1]), (5, None, None), (6, "12", "42.0 %")]
    df = spark.createDataFrame(rows, "id bigint, title string, lede string")
    found = {r.id: (r.lang, r.confidence) for r in langid.article_languages(df, "id", "title", "lede", models).collect()}
    assert {i: g for i, (g, _) in found.items()} == {1: "de", 2: "en", 3: "de", 4: "en", 5: None, 6: None}
    assert all((c is None) == (g is None) and (c is None or 0.3 < c <= 1.0) for g, c in found.values())
