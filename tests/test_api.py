from __future__ import annotations

import math

from pyspark.sql import functions as F

from larkspur import api

NOW = "2024-01-10 00:00:00"
ROWS = [
    (1, "2024-01-09 00:00:00", "Merger of banks", "The merger was approved by Horizon Lab after talks.", "u1", "Wire", "EN", ["Horizon Lab"], "00000000000000ff"),
    (2, "2024-01-09 01:00:00", "Merger of banks", "The merger was approved by Horizon Lab after talks!", "u2", "Desk", "en", None, "00000000000000fe"),
    (3, "2023-12-01 00:00:00", "Energy prices", "Prices rose; a merger is off.", "u3", "Wire", "en", [], ""),
    (4, "2024-01-08 00:00:00", "Énergie", "La fusion des banques.", "u4", "Wire", "fr", [], None),
    (4, "2024-01-08 00:00:00", "Énergie", "La fusion des banques.", "u4", "Wire", "fr", [], None),
    (5, None, None, None, None, None, None, None, None),
    (None, NOW, "merger", "merger", "u", "s", "en", [], None),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "id bigint, at string, title string, lede string, url string, source string, lang string, entities array<string>, simhash string").withColumn("at", F.col("at").cast("timestamp"))


def test_search(spark, tmp_path) -> None:
    built = api.build_index(frame(spark), spark.createDataFrame([("wire", 0.9)], "source string, trust double"))
    assert built.docs.count() == 5 and built.docs.where("simhash IS NULL").count() == 0
    rows = api.search(built, 'Merger "approved by" Horizon Lab', NOW).collect()
    assert [r.id for r in rows] == [1, 3] and "<mark>merger</mark>" in rows[0].snippet
    n, avg = 5, built.stats.first().avg_length
    lengths = {r.id: max(1, r.length) for r in built.docs.collect()}
    df = {"merger": 3, "approved": 2, "horizon": 2, "lab": 2}
    wtf = {"merger": 5, "approved": 2, "horizon": 2, "lab": 2}
    bm25 = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[1] / avg)) for t, f in wtf.items())
    assert abs(rows[0].score - (bm25 + 0.2 * math.exp(-1440 / 4320) + 0.15 * 0.9 + 0.05 + 0.1)) < 1e-5
    assert [r.id for r in api.search(built, "merger", NOW, collapse=False).collect()] == sorted([1, 2, 3], key=lambda i: -{r.id: r.score for r in api.search(built, "merger", NOW, collapse=False).collect()}[i])
    assert [r.id for r in api.search(built, "merger", NOW, since="7d", sources=("Desk",)).collect()] == [2]
    assert [r.id for r in api.search(built, "ÉNERGIE", NOW, lang="FR").collect()] == [4]
    assert api.search(built, "the of", NOW).count() == api.search(built, "merger", NOW, page=9).count() == api.search(built, "nowhere", NOW).count() == 0
    facets = {(r.facet, r.value): r.n for r in built.facets(NOW).collect()}
    assert facets["source", "Wire"] == 3 and facets["lang", "en"] == 3 and facets["date", "24h"] == 2 and facets["date", "7d"] == 3
    built.save(str(tmp_path / "i"))
    kept = api.open_index(spark, str(tmp_path / "i"), "merger energy")
    assert [tuple(r)[:2] for r in api.search(kept, "merger energy", NOW).collect()] == [tuple(r)[:2] for r in api.search(built, "merger energy", NOW).collect()]


def test_empty_index(spark) -> None:
    empty = api.build_index(frame(spark).limit(0))
    assert api.search(empty, "merger", NOW).count() == 0 and empty.facets(NOW).count() == 0


def test_saved_documents_are_found_by_their_shard(spark, tmp_path) -> None:
    built = api.build_index(frame(spark))
    built.save(str(tmp_path / "i"))
    assert sorted(r.id for r in api.hydrated(spark, str(tmp_path / "i"), [1, 3, 99]).collect()) == [1, 3] and api.hydrated(spark, str(tmp_path / "i"), []).count() == 0
    norms = {r.id: r.length_norm for r in built.meta().collect()}
    assert len(norms) == 5 and norms[5] < norms[1]
    assert {r.id: r.minutes for r in built.recency(NOW).collect()}[1] == 1440
