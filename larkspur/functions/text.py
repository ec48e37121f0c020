"""Tokenisers, normalisers and measures of text as Column expressions.

All accept null and empty text: null counts as empty unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the index leaves out.
STOPWORDS = (
    "the a an of and to in for on by with is are was were be as that from this at it or but if then into their they them he she his her "
    "over after before about than across has have had will can could should would just more most other also new its not we you your i me "
    "our us so no yes"
).split()


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the plain ASCII letters they fold to, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    kept = [(a, b) for a, b in pairs if b.isascii() and a != b]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


FOLD_FROM, FOLD_TO = _folding()


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fold(text: Column) -> Column:
    """Accented Latin letters as plain ones; other characters beyond ASCII are dropped."""
    return F.regexp_replace(F.translate(text_of(text), FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda w: w != "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null text gives an empty array."""
    return _split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+")


def ascii_words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing."""
    return _split(F.lower(text_of(text)), "[^a-z0-9]+")


def query_terms(text: Column) -> Column:
    """Folded, lower-cased runs of a-z and 0-9, one-letter ones included."""
    return _split(fold(F.lower(text_of(text))), "[^a-z0-9]+")


def index_terms(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """query_terms() without stopwords and terms of one character."""
    return F.filter(query_terms(text), lambda w: (F.length(w) > 1) & ~w.isin(stopwords))


def quoted_phrases(text: Column) -> Column:
    """Trimmed, non-empty phrases between straight quotation marks on one line."""
    return F.filter(F.transform(F.regexp_extract_all(text_of(text), F.lit('"([^"\\n]+)"'), 1), lambda x: F.trim(x)), lambda p: p != "")


def capitalised_spans(text: Column) -> Column:
    """Distinct runs of words that begin with A-Z."""
    return F.array_distinct(F.regexp_extract_all(text_of(text), F.lit(r"([A-Z][\p{L}0-9]+(?:\s+[A-Z][\p{L}0-9]+)*)"), 1))


def token_key(token: Column) -> Column:
    """Lower-cased, with nothing but 0-9, a-z and hyphens."""
    return F.regexp_replace(F.lower(F.trim(text_of(token))), "[^0-9a-z-]+", "")


def entity_key(name: Column) -> Column:
    """Lower-cased, blanks and hyphens collapsed, without a leading article and outer blanks and hyphens."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text_of(name)), r"\s+", " "), "-+", "-")
    plain = F.regexp_replace(F.regexp_replace(plain, "^[ -]+|[ -]+$", ""), "^(?:a|an|the) ", "")
    return F.regexp_replace(plain, "^[ -]+|[ -]+$", "")


def name_key(name: Column) -> Column:
    """Lower-cased, with nothing but a-z, 0-9, hyphens and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_of(name)), r"[^a-z0-9\s-]+", ""), r"\s+", " "))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(_split(name_key(name), r"[\s-]+"))


def stem(token: Column) -> Column:
    """Light stemming of an English token: a possessive goes first, then the first of -ies, -ing, -ers, -ied, -ed, -es, -s that leaves enough."""
    plain = F.regexp_replace(F.trim(text_of(token)), "'s$", "")
    n = F.length(plain)

    def without(k: int) -> Column:
        return plain.substr(F.lit(1), n - k)

    return (
        F.when(n <= 3, plain)
        .when((n > 4) & plain.endswith("ies"), F.concat(without(3), F.lit("y")))
        .when((n > 4) & plain.rlike("(?:ing|ers|ied)$"), without(3))
        .when(plain.rlike("(?:ed|es)$"), without(2))
        .when(plain.endswith("s"), without(1))
        .otherwise(plain)
    )


def sentences(text: Column) -> Column:
    """Trimmed, non-empty stretches between full stops, exclamation and question marks."""
    return F.filter(F.transform(F.split(text_of(text), "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


#: White space of all expressions: blank, tab, line and page ends.
SPACE = r"[ \t\n\x0B\f\r]+"


def squeezed(text: Column) -> Column:
    """Without outer white space, and with single blanks for inner runs of it."""
    return F.trim(F.regexp_replace(text_of(text), SPACE, " "))


def preview(text: Column, length: int = 320) -> Column:
    """The squeezed text, cut to the length with an ellipsis as its last character."""
    plain = squeezed(text)
    return F.when(F.length(plain) > length, F.concat(F.rtrim(F.substring(plain, 1, length - 1)), F.lit("…"))).otherwise(plain)


def punctuated(sentence: Column) -> Column:
    """Trimmed, with a full stop unless it ends in one, a question or an exclamation mark."""
    plain = F.trim(text_of(sentence))
    return F.when((plain == "") | plain.rlike("[.!?]$"), plain).otherwise(F.concat(plain, F.lit(".")))


def capitalised(sentence: Column) -> Column:
    plain = F.trim(text_of(sentence))
    return F.concat(F.upper(F.substring(plain, 1, 1)), plain.substr(F.lit(2), F.length(plain)))


def list_items(value: Column) -> Column:
    """Distinct, trimmed, non-empty items between commas and line ends."""
    return F.array_distinct(F.filter(F.transform(F.split(text_of(value), r"[\n,]+"), lambda x: F.trim(x)), lambda x: x != ""))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens, joined by a blank."""
    return F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat(F.element_at(tokens, i), F.lit(" "), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def syllables(word: Column) -> Column:
    """Vowel groups of a word's letters without a final e, at least one."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text_of(word)), "[^a-z]", ""), "e$", "")
    return F.greatest(F.lit(1), F.regexp_count(plain, F.lit("[aeiouy]+")))


def latest_year(text: Column) -> Column:
    """The latest year from 1900 to 2099 in the text; null if there is none."""
    runs = F.filter(F.split(text_of(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^(?:19|20)[0-9]{2}$"))
    return F.array_max(F.transform(runs, lambda y: y.cast("int")))


def type_token_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


def highlighted(text: Column, terms: list[str]) -> Column:
    """HTML-escaped, with the terms (any case) in <mark>."""
    plain = text_of(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    if not terms:
        return plain
    return F.regexp_replace(plain, "(?i)(" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + ")", "<mark>$1</mark>")


def snippet(text: Column, terms: list[str]) -> Column:
    """The sentence that fits best: two points for 40 to 320 characters, -1 above and -0.5 below, three for each term in it; the first of equals."""
    found = sentences(text)

    def score(s: Column) -> Column:
        n = F.length(s)
        band = F.when(n > 320, -1.0).when(n >= 40, 2.0).otherwise(-0.5)
        return sum([F.when(F.lower(s).contains(t), 3.0).otherwise(0.0) for t in terms], band)

    ranked = F.transform(found, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("before"), s.alias("s")))
    best = F.array_max(ranked)["s"]
    return F.when(F.length(best) > 320, F.concat(F.substring(best, 1, 317), F.lit("…"))).otherwise(best)


def elapsed_label(seconds: Column) -> Column:
    """Seconds, minutes, hours or days as a short label."""
    whole = [F.floor(seconds / k).cast("string") for k in (60, 3600, 86400)]
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago"))).when(seconds < 3600, F.concat(whole[0], F.lit("m ago"))).when(seconds < 86400, F.concat(whole[1], F.lit("h ago"))).otherwise(F.concat(whole[2], F.lit("d ago")))
