"""Languages of texts and of their single-language stretches.

Method: prediction by partial matching. For each language a variable-order
context tree over bytes (contexts of up to four) is counted on a bounded sample
of labelled texts and then frozen. A symbol's code length in a context is
-log2(count / (total + kinds)); a context that has not seen the symbol costs
its escape, -log2(kinds / (total + kinds)), and the next shorter context goes
on; below the empty context all bytes are equally likely. A sentence belongs to
the language with the shortest code; the confidence is that language's share
when each language weighs 2^-code length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.hashtable import find
from larkspur.llm.hashtable import table as table_of
from larkspur.sources.tables import table

ORDER = 4
#: Texts a language that the models are trained on, at most.
SAMPLE = 250
_BLOCK = 1 << 20

_LETTER = r"[^\W\d_]"
_NAME = rf"[«\"“]?[^\W\d_a-zа-яёß-ÿ][\w’'\-]*[»\"”]?"
# A label and names of one word each: Mentioned: A, B; C.
_LIST = re.compile(rf"{_LETTER}+[   ]?:\s*(?:{_NAME}(?:\s*[,;]\s*|(?=\s|\.|$)))+\.?")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
# The end of a sentence: not after an initial or a short form.
_END = re.compile(r"(?<![\s.][^\W\d_])(?<!^[^\W\d_])(?<!\bMio)(?<!\bMrd)(?<!\bDr)(?<!\bMr)(?<!\bMs)(?<!\bMrs)(?<!\bSt)[.!?]+[»\"”“’')]*(?=\s|$)")
# A full stop with the next sentence right behind it.
_GLUED = re.compile(r"(?<=[^\W\d_]{2}|.[%»”\"])\.(?=[«„“\"]?[^\W\d_a-zа-яёß-ÿ])")
_WORDS = re.compile(r"[^\W_]+")
_LEAST_WORDS = 4


def sentences(text: str | None) -> list[str]:
    """The whole sentences of a text, in order.

    A whole sentence ends with a full stop, question or exclamation mark and
    has at least four words, half of them without digits and, unless all is in
    capitals, two in small letters. By-lines, bracketed notes, lists of names
    behind a label, figures, and what precedes an ellipsis that cuts a sentence
    off are left out. Null, empty and blank texts have none.
    """
    if not text:
        return []
    if ":" in text or "(" in text or "[" in text:
        text = _LIST.sub(" ", _BRACKETS.sub(" ", text))
    out, start = [], 0
    text = _GLUED.sub(". ", text)
    for m in _END.finditer(text):
        piece = text[start : m.end()]
        start = m.end()
        piece = piece[piece.rfind("…") + 1 :].strip()
        words = _WORDS.findall(piece)
        if len(words) < _LEAST_WORDS or 2 * sum(map(str.isalpha, words)) < len(words):
            continue
        if piece.isupper() or sum(map(str.islower, words)) >= 2:
            out.append(piece)
    return out


class Models:
    """The frozen statistics of all languages, as tables of code lengths.

    For every n-gram that any language has seen there is the vector of all
    languages' code lengths of its last byte after the others; for every
    context the vector of their escapes.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        raw = [_bytes(texts[g])[0] for g in self.languages]
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        width = len(self.languages)
        lower_keys, lower = np.arange(256, dtype=np.uint64), np.full((256, width), 8.0, np.float32)
        for order in range(ORDER + 1):
            counted = [_grams(r, order) for r in raw]
            keys = np.unique(np.concatenate([k for k, _ in counted])) if counted else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            suffix = keys & np.uint64((1 << (8 * max(order, 1))) - 1)
            cost = lower[np.searchsorted(lower_keys, suffix)].copy()
            escape = np.zeros((len(contexts), width), np.float32)
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            for g, (k, n) in enumerate(counted):
                at, ctx = np.searchsorted(keys, k), np.searchsorted(contexts, k >> np.uint64(8))
                total = np.bincount(ctx, weights=n, minlength=len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                seen = kinds > 0
                escape[seen, g] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                cost[:, g] += escape[of, g]
                cost[at, g] = -np.log2(n / (total[ctx] + kinds[ctx]))
            self.grams.append(table_of(keys, cost))
            self.escapes.append(table_of(contexts, escape))
            lower_keys, lower = keys, cost
        self.unseen = np.full(width, 8.0, np.float32)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language, one row a text."""
        out = np.zeros((len(texts), len(self.languages)), np.float64)
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) < _BLOCK):
                size += len(texts[end])
                end += 1
            self._block(texts[start:end], out[start:end])
            start = end
        return out

    def _block(self, texts: list[str], out: np.ndarray) -> None:
        data, starts = _bytes(texts)
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        code = _codes(data, ORDER)
        padded = np.zeros(len(data), bool)
        for k in range(ORDER):
            padded[starts + k] = True
        todo = np.flatnonzero(~padded)
        for order in range(ORDER, -1, -1):
            gram = code[todo] & np.uint64((1 << (8 * (order + 1))) - 1)
            at = find(self.grams[order][0], gram)
            hit = at >= 0
            cost[todo[hit]] += self.grams[order][1][at[hit]]
            todo, gram = todo[~hit], gram[~hit]
            if not len(todo):
                break
            at = find(self.escapes[order][0], gram >> np.uint64(8))
            known = at >= 0
            cost[todo[known]] += self.escapes[order][1][at[known]]
        if len(todo):
            cost[todo] += self.unseen
        out += np.add.reduceat(cost, starts, axis=0)


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, lower-cased, each behind blanks that are its first context, and where each begins."""
    parts = [(" " * ORDER + t.lower()).encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    code = data.astype(np.uint64)
    wide = code.copy()
    for k in range(1, order + 1):
        code[k:] |= wide[:-k] << np.uint64(8 * k)
    return code


def _grams(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    code = _codes(data, order)[order:]
    return np.unique(code, return_counts=True)


def label_code(label: Column, names: dict[str, str]) -> Column:
    """The language code that a label names, ignoring case, outer white space and a region after - or _; else null."""
    if not names:
        return F.lit(None).cast("string")
    plain = F.lower(F.trim(F.regexp_replace(label, r"^\s+|\s+$", "")))
    known = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(known[plain], known[F.trim(F.regexp_extract(plain, r"^([^-_]*)", 1))])


def language_names(codes: DataFrame) -> dict[str, str]:
    """Lower-cased code, iso3, English and own name -> code, from the table of languages."""
    return {x.strip().lower(): r.code for r in codes.collect() for x in (r.code, r.iso3, r.english_name, r.own_name) if x}


def train(df: DataFrame, key: str, text: str, label: Column, languages: list[str], sample: int = SAMPLE) -> Models:
    """Models from at most sample texts a language whose label names it.

    Labels may be wrong and texts mixed: models of one half of the sentences
    assign the other half anew, three times over, and the final models are
    trained on the sentences whose assignments agree with their labels.
    """
    if not languages:
        return Models({})
    labelled = df.select(F.col(text).alias("_text"), label.alias("_code"), F.xxhash64(F.col(key)).alias("_hash")).where(F.col("_code").isin(languages) & F.col("_text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("_code").count().collect()}
    # A threshold on the hash keeps about 1.5 samples a language; the rest is cut exactly.
    share = F.create_map(*[F.lit(x) for g in languages for x in (g, float(min(1.0, 1.5 * sample / max(1, counts.get(g, 0)))))])
    few = labelled.where((F.col("_hash").bitwiseAND(0xFFFFFF) / float(0x1000000)) < share[F.col("_code")])
    rows = few.orderBy("_hash").limit(2 * sample * max(1, len(languages))).collect()
    texts: dict[str, list[str]] = {g: [] for g in languages}
    taken = dict.fromkeys(languages, 0)
    for r in rows:
        if taken[r["_code"]] < sample:
            taken[r["_code"]] += 1
            texts[r["_code"]].extend(sentences(r["_text"]))
    texts = {g: t for g, t in texts.items() if t}
    for _ in range(3):
        texts = _agreeing(texts)
    return Models(texts)


def _agreeing(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """The texts that models trained without them assign to their language; all of a language's if none."""
    fold = {g: [zlib.crc32(s.encode()) & 1 for s in t] for g, t in texts.items()}
    halves = [Models({g: [s for s, f in zip(t, fold[g]) if f == k] or t for g, t in texts.items()}) for k in (0, 1)]
    kept = {}
    for g, t in texts.items():
        best = [m.code_lengths(t).argmin(axis=1) for m in halves]
        kept[g] = [s for i, (s, f) in enumerate(zip(t, fold[g])) if halves[0].languages[best[1 - f][i]] == g] or t
    return kept


def language_segments(df: DataFrame, key: str, text: str, models: Models, keep: str | None = None) -> DataFrame:
    """One row per longest run of whole sentences in one language.

    Columns: key, keep if given (a further column of df), seg (from 0), lang,
    confidence, n_sentences, n_languages (of the whole text), text.

    Texts without a whole sentence, null and empty ones among them, give no
    row; rows that repeat stay repeated. Whole texts are read.
    """
    sent = df.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            # Without a labelled text there is no language to assign.
            found = [sentences(t.as_py()) if models.languages else [] for t in batch.column(1)]
            flat = [s for f in found for s in f]
            bits = models.code_lengths(flat)
            best = bits.argmin(axis=1).tolist() if len(flat) else []
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            i = 0
            for row, pieces in enumerate(found):
                end, seg = i + len(pieces), 0
                several = len(set(best[i:end]))
                while i < end:
                    j = i
                    while j < end and best[j] == best[i]:
                        j += 1
                    total = bits[i:j].sum(axis=0)
                    share = 1.0 / np.exp2(np.maximum(total.min() - total, -1000.0)).sum()
                    for column, value in zip(rows, (row, seg, models.languages[best[i]], float(share), j - i, several, " ".join(flat[i:j]))):
                        column.append(value)
                    i, seg = j, seg + 1
            at = pa.array(rows[0], pa.int32())
            through = [batch.column(c).take(at) for c in ((0, 2) if keep else (0,))]
            yield pa.RecordBatch.from_arrays([*through, *[pa.array(r, kind) for r, kind in zip(rows[1:], (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()))]], names)

    through = [key, keep] if keep else [key]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in through)
    names = [*through, "seg", "lang", "confidence", "n_sentences", "n_languages", "text"]
    return df.select(key, text, *through[1:]).mapInArrow(work, f"{kinds}, seg int, lang string, confidence double, n_sentences int, n_languages int, text string")


def article_languages(df: DataFrame, key: str, title: str, text: str, models: Models) -> DataFrame:
    """One row per record: key, lang and confidence, over the title and the whole sentences of the text together.

    A text without a whole sentence is read as it is. Both are null where
    there are no letters; rows that repeat stay repeated.
    """
    sent = df.sparkSession.sparkContext.broadcast(models)

    def parts(models: Models, title: str | None, text: str | None) -> list[str]:
        pieces = [title or "", *(sentences(text) or [text or ""])]
        return [p for p in pieces if any(map(str.isalpha, p))] if models.languages else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            found = [parts(models, t.as_py(), x.as_py()) for t, x in zip(batch.column(1), batch.column(2))]
            bits = models.code_lengths([p for f in found for p in f])
            langs: list[str | None] = []
            shares: list[float | None] = []
            i = 0
            for pieces in found:
                total = bits[i : i + len(pieces)].sum(axis=0)
                i += len(pieces)
                langs.append(models.languages[int(total.argmin())] if pieces else None)
                shares.append(float(1.0 / np.exp2(np.maximum(total.min() - total, -1000.0)).sum()) if pieces else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], [key, "lang", "confidence"])

    return df.select(key, title, text).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, lang string, confidence double")


def p1_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every article's language with its confidence."""
    articles = table(spark, folder, "raw_articles")
    names = language_names(table(spark, folder, "lang_codes"))
    models = train(articles, "id", "lede", label_code(F.col("lang"), names), sorted(set(names.values())))
    return article_languages(articles, "id", "title", "lede", models)


def p1_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every single-language stretch of every lede with its confidence."""
    articles = table(spark, folder, "raw_articles")
    names = language_names(table(spark, folder, "lang_codes"))
    models = train(articles, "id", "lede", label_code(F.col("lang"), names), sorted(set(names.values())))
    return language_segments(articles, "id", "lede", models)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    articles = table(spark, folder, "raw_articles")
    names = language_names(table(spark, folder, "lang_codes"))
    articles = articles.select("id", "lede", label_code(F.col("lang"), names).alias("named"))
    models = train(articles, "id", "lede", F.col("named"), sorted(set(names.values())))
    found = language_segments(articles, "id", "lede", models, "named")
    other = (F.col("n_languages") > 1) | F.col("named").isNull() | (F.col("named") != F.col("lang"))
    return found.where(other).select("id", "seg", "lang").distinct()
