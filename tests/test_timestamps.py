from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SMALL
from larkspur.operators import timestamps
from larkspur.operators.timestamps import InstantDictionary, normalise_timestamps
from larkspur.sources.tables import scratch

SOURCES = "source_id int, name string, aliases array<string>, home_tz string, date_order string"
ROWS = "id bigint, t string, s string, epoch_us string, form string"


def test_rows_keep_and_values_resolve(spark) -> None:
    sources = spark.createDataFrame([(1, "Ledger", ["LDG", " "], "America/New_York", "MDY"), (2, None, None, None, None), (3, "ledger", [], "Asia/Tokyo", "YMD")], SOURCES)
    rows = spark.createDataFrame([(1, "03/04/2024 12:00", " ledger ", "x", "f"), (1, "03/04/2024 12:00", " ledger ", "x", "f"), (2, "03/04/2024 12:00", None, None, None), (3, None, "LDG", None, None), (None, "1704164645", "ldg", None, None), (5, "", "", "", "")], ROWS)
    out = normalise_timestamps(rows, "t", "s", sources, InstantDictionary(spark, scratch(spark, "d")), out="at").collect()
    assert sorted(((r.id, r.at, r.epoch_us) for r in out), key=str) == sorted([(1, 1709571600000000, "x"), (1, 1709571600000000, "x"), (2, None, None), (3, None, None), (None, 1704164645000000, None), (5, None, "")], key=str)
    empty = normalise_timestamps(rows.limit(0), "t", "s", sources, InstantDictionary(spark, scratch(spark, "d")))
    assert empty.count() == 0


def test_dictionary_parses_only_what_is_new(spark) -> None:
    keys = spark.createDataFrame([("1704164645", "", ""), ("1704164645", "", ""), (None, "", "")], "_raw string, _home string, _order string")
    dictionary = InstantDictionary(spark, scratch(spark, "d"))
    assert dictionary.entries().count() == 0
    dictionary.update(keys)
    dictionary.update(keys.unionByName(spark.createDataFrame([("TBD", "", "")], keys.schema)))
    assert sorted(r._raw for r in dictionary.entries().collect()) == ["1704164645", "TBD"]
    assert dictionary.entries().where(F.col("_epoch_us").isNull()).count() == 1


def test_a_lasting_dictionary_is_used_by_later_runs(spark) -> None:
    path = scratch(spark, "lasting")
    spark.conf.set(timestamps.DICTIONARY, path)
    try:
        first = sorted(map(tuple, timestamps.p3_found(spark, SMALL).collect()))
        held = spark.read.parquet(path).count()
        assert sorted(map(tuple, timestamps.p3_found(spark, SMALL).collect())) == first and first
        # The second run added nothing.
        assert spark.read.parquet(path).count() == held == InstantDictionary(spark, path).entries().count()
    finally:
        spark.conf.unset(timestamps.DICTIONARY)
