from __future__ import annotations

import pytest

from larkspur.operators.relations import relations, verb_template

TEMPLATES = [verb_template("works_at", ["works", "worked"], ["at", "for"]), verb_template("founded", ["founded", "created"])]


@pytest.mark.parametrize(
    ("sentence", "expected"),
    [
        ("A whale is a large mammal", {("whale", "isa", "large mammal")}), ("Horizon Laboratory (Horizon Lab) opened", {("horizon laboratory", "synonym", "horizon lab")}), ("Bob Stone aka The Rock", {("bob stone", "synonym", "rock")}),
        ("Alpha: a new engine", {("alpha", "tagline", "new engine")}), ("Ann works at Beta Corp", {("ann", "works_at", "beta corp")}), ("Ann founded Beta", {("ann", "founded", "beta")}),
        ("The Lab (LB) is a centre", {("lab", "synonym", "lb"), ("lab (lb)", "isa", "centre")}), ("same is same", set()), ("x" * 200 + " is a y", set()), ("", set()), (None, set()), ("no relation", set()),
    ],
)
def test_relations(spark, sentence: str | None, expected: set) -> None:
    df = spark.createDataFrame([(1, sentence)], "id int, s string")
    assert {(r.subject, r.relation, r.object) for r in relations(df, "s", TEMPLATES).collect()} == expected
