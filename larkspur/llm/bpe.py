"""Encoding of texts with the rank files of public byte-level tokenizers.

Method: contiguous rank array. A short word's part boundaries and the ranks of
its adjacent pairs lie in two arrays; the least rank is sought by a scan, its
boundary deleted, and the ranks beside it refreshed. The words of a block that
have about the same number of bytes are rows of one array and merged in step,
one boundary of each row at a time. Long words, for which scanning would be
quadratic, keep the same order of merges with a heap.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import hashtable
from larkspur.sources.tables import table

TOKENIZERS = "/opt/tokenizers"
_NONE = 1 << 60
_LONG = 128
#: Bytes of a word up to which words are merged as rows of one array; characters of a block of texts, about.
_ROWS, _BLOCK = 48, 3_000_000
_WIDTHS, _PAD = (6, 10, 14, 18, 24, 48), (1 << 31) - 1
_CACHE_LIMIT = 300_000


def _class(*categories: str) -> str:
    """The members of Unicode categories as the inside of a character class."""
    out, first = [], None
    for code in range(sys.maxunicode + 2):
        inside = code <= sys.maxunicode and unicodedata.category(chr(code))[0] in categories
        if inside and first is None:
            first = code
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{code - 1:08x}")
            first = None
    return "".join(out)


@lru_cache(maxsize=1)
def splitter() -> re.Pattern[str]:
    """The tokenizers' public pattern, with the classes of letters, numbers and white space spelled out."""
    letter, number = _class("L"), _class("N")
    # The code points with the property White_Space.
    space = r"\t-\r \x85\xa0  -     　"
    # No contraction begins with a letter, a number or a blank, so it may be tried behind the frequent cases.
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of a word once no adjacent pair has a rank: always the least rank, of equal ones the leftmost."""
    if len(word) > _LONG:
        return _merge_long(word, ranks)
    get = ranks.get
    bounds = list(range(len(word) + 1))
    adjacent = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == _NONE:
            break
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            adjacent[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [word[a:b] for a, b in zip(bounds, bounds[1:])]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    n = len(word)
    right, left = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins there: its end; the part before
    get, heap = ranks.get, []
    for i in range(n - 1):
        if (r := get(word[i : i + 2])) is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if not alive[i] or right[i] != middle or not alive[middle] or right[middle] != end:
            continue
        right[i], alive[middle] = end, False
        if end < n:
            left[end] = i
            if (r := get(word[i : right[end]])) is not None:
                heapq.heappush(heap, (r, i, end, right[end]))
        if (before := left[i]) >= 0 and (r := get(word[before:end])) is not None:
            heapq.heappush(heap, (r, before, i, end))
    out, i = [], 0
    while i < n:
        out.append(word[i : right[i]])
        i = right[i]
    return out


class Encoder(dict):
    """Word -> ids, filled as words come; bounded by trim()."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.find = ranks, splitter().findall
        # Every pair of tokens whose bytes make a token, with that token's rank.
        pairs = [((ranks[token[:i]] << 32) | ranks[token[i:]], rank) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self.pairs, self.pair_ranks = hashtable.table(keys.view(np.uint64), np.append(values, _NONE))
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left << 32) | right).ravel().view(np.uint64)
        return self.pair_ranks[hashtable.find(self.pairs, keys)].reshape(left.shape)

    def learn(self, words: Iterable[str]) -> None:
        """Fills in the ids of words that are not known yet."""
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        ranks = self.ranks
        for word in words:
            raw = word.encode("utf-8", "replace")
            rank = ranks.get(raw)
            if rank is not None:
                self[word] = (rank,)
            elif len(raw) > _ROWS:
                self[word] = tuple([ranks[p] for p in merge(raw, ranks)])
            else:
                width = next(w for w in _WIDTHS if len(raw) <= w)
                some = by_size.setdefault(width, ([], []))
                some[0].append(word)
                some[1].append(raw)
        for width, (group, raws) in by_size.items():
            sizes = np.array([len(r) for r in raws])
            ids = np.full((len(raws), width), _PAD, np.int64)
            ids[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(raws), np.uint8)]
            self._merge_rows(group, sizes, ids)

    def _merge_rows(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Merges the rows of ids, of which the first sizes are parts and the rest padding that goes with nothing."""
        names = np.arange(len(words))
        adjacent = self._rank(ids[:, :-1], ids[:, 1:])
        while len(names):
            # A single part is done; so is a row without a rank.
            at = adjacent.argmin(axis=1) if adjacent.shape[1] else np.zeros(len(names), np.int64)
            rows = np.arange(len(names))
            least = adjacent[rows, at] if adjacent.shape[1] else np.full(len(names), _NONE)
            done = least == _NONE
            for name, found, size in zip(names[done].tolist(), ids[done].tolist(), sizes[done].tolist()):
                self[words[name]] = tuple(found[:size])
            names, ids, adjacent, at, least, sizes = names[~done], ids[~done], adjacent[~done], at[~done], least[~done], sizes[~done] - 1
            if not len(names):
                return
            rows, width = np.arange(len(names)), ids.shape[1]
            ids[rows, at] = least
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            column = np.arange(width - 2)
            adjacent = np.take_along_axis(adjacent, column + (column >= at[:, None]), axis=1)
            some = np.flatnonzero(at < width - 2)
            adjacent[some, at[some]] = self._rank(ids[some, at[some]], ids[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            adjacent[some, at[some] - 1] = self._rank(ids[some, at[some] - 1], ids[some, at[some]])

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw, ranks = word.encode("utf-8", "replace"), self.ranks
        rank = ranks.get(raw)
        ids = self[word] = (rank,) if rank is not None else tuple([ranks[p] for p in merge(raw, ranks)])
        return ids

    def trim(self) -> None:
        if len(self) > _CACHE_LIMIT:
            self.clear()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))


def _blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in runs of about _BLOCK characters."""
    block, size = [], 0
    for value in texts:
        block.append(value.as_py())
        size += len(block[-1] or "")
        if size > _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Columns key and ids: the token ids of each text, without special tokens.

    Null and empty texts have the ids []. Strings that look like special tokens
    are ordinary text. Rows that repeat stay repeated; whole texts are encoded,
    whatever their length; an empty table gives no rows.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(path))
        item, find = encoder.__getitem__, encoder.find
        for batch in batches:
            sizes, parts = [0], []
            for block in _blocks(batch.column(1)):
                encoder.trim()
                split = [find(t) if t else [] for t in block]
                encoder.learn(set(chain.from_iterable(split)).difference(encoder))
                for found in split:
                    ids = np.fromiter(chain.from_iterable(map(item, found)), np.int32)
                    parts.append(ids)
                    sizes.append(len(ids))
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"
    return df.select(F.col(key), F.col(text)).mapInArrow(work, schema)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")
