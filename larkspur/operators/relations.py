"""Relations stated by sentences: aliases, is-a, other names, labels, and verb templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as tx

# Patterns of two groups and the confidence of what they say.
ALIAS = r"([\p{L}0-9][^()]+?)[ \t\n\x0B\f\r]*\(([^()]*[A-Za-z][^()]*)\)"
IS_A = (r"(?is)^(.+?)[ \t\x0B\f]+is[ \t\x0B\f]+(?:an?[ \t\x0B\f]+)?([\p{L}\p{N}_ \t\x0B\f\-]+)$", "isa", 0.83)
ALSO = (r"(?is)^(.+?)[ \t\x0B\f]+(?:aka|also known as|known as|nicknamed|alias(?:[ \t\x0B\f]+of)?|goes by|synonym of)[ \t\x0B\f]+(.+)$", "synonym", 0.85)
LABEL = (r"(?s)^(.*?[\p{L}].*?)(?:[ \t\x0B\f]*:[ \t\x0B\f]*|[ \t\x0B\f]+[\-–—][ \t\x0B\f]+)(.*[\p{L}].*)$", "tagline", 0.62)
#: Words and bytes that a subject and an object may have.
SUBJECT, OBJECT = (8, 80), (12, 120)


def verb_template(relation: str, verbs: list[str], connectors: list[str] | None = None, confidence: float = 0.65) -> tuple[str, str, float]:
    """A pattern for subject, verb, connector, object, as a rule."""
    verb = "|".join(sorted(verbs, key=lambda v: (-len(v), v)))
    link = r"[ \t\x0B\f]+(?:" + "|".join(connectors) + ")" if connectors else ""
    return (rf"(?is)^(.+?)[ \t\x0B\f]+(?:{verb}){link}[ \t\x0B\f]+(.+)$", relation, confidence)


def _reasonable(span: Column, limits: tuple[int, int]) -> Column:
    words, size = limits
    return (span != "") & (F.size(F.split(span, " ")) <= words) & (F.octet_length(span) <= size)


def relations(sentences: DataFrame, sentence: str, templates: list[tuple[str, str, float]]) -> DataFrame:
    """The columns of sentences, with subject, relation, object and confidence, a row for each relation found.

    Aliases in brackets are synonyms and found besides; of is-a, other names,
    labels and the templates, in this order, the first that matches counts.
    Entities are normalised; spans that are empty, too long or equal on both
    sides say nothing.
    """
    text = F.trim(tx.text_of(F.col(sentence)))

    def said(pattern: str, relation: str, confidence: float, whole: Column = text) -> Column:
        return F.struct(tx.entity_key(F.regexp_extract(whole, pattern, 1)).alias("subject"), F.lit(relation).alias("relation"), tx.entity_key(F.regexp_extract(whole, pattern, 2)).alias("object"), F.lit(confidence).alias("confidence"))

    rules = [IS_A, ALSO, LABEL, *templates]
    first = reduce(lambda out, rule: out.when(text.rlike(rule[0]), said(*rule)), rules[1:], F.when(text.rlike(rules[0][0]), said(*rules[0])))
    aliases = F.transform(F.regexp_extract_all(text, F.lit(ALIAS), 0), lambda m: said(ALIAS, "synonym", 0.85, m))
    every = F.concat(aliases, F.array_compact(F.array(first)))
    found = sentences.withColumn("_r", F.explode(every)).select("*", "_r.*").drop("_r")
    return found.where(_reasonable(F.col("subject"), SUBJECT) & _reasonable(F.col("object"), OBJECT) & (F.col("subject") != F.col("object")))
