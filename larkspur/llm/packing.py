"""Filling containers of fixed capacity with documents, by their token counts.

Method: sum-of-squares online packing. A level array counts the open
containers of each fill level; a document goes to the level, or to a new
container, for which the sum of the squared counts after placing it is least.
Shards of documents are packed independently; the containers that a shard
leaves open are then packed together, as items of their fill, with those of
the other shards of their group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe import TOKENIZERS, load_ranks
from larkspur.sources.tables import table, written

#: Documents a shard, about; shards whose open containers are packed together.
SHARD, GROUP = 20_000, 64
_CACHE_LIMIT = 300_000
_SPACED = re.compile(r"[ ▁]+[^ ▁]*")


class _PieceCounts(dict):
    """Word with the blanks before it -> number of pieces. No piece goes on behind a blank, so counts of words add up."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode

    def __missing__(self, word: str) -> int:
        # A blank at the end of a text is a piece of its own.
        n = self[word] = len(self.encode(word[1:])) if len(word) > 1 else 1
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, _SPACED.findall(" " + text)))


def _counter(folder: str, name: str):  # noqa: ANN202
    """A function of a text that gives its number of tokens, without special tokens."""
    if name.startswith("piece_"):
        counts = _PieceCounts(f"{folder}/{name}.model")

        def pieces(text: str) -> int:
            if len(counts) > _CACHE_LIMIT:
                counts.clear()
            return counts.count(text)

        return pieces
    if name.startswith("word_"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(f"{folder}/{name}.json")
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    import tiktoken

    # The public pattern of the rank files; the engine's own classes.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=load_ranks(f"{folder}/{name}.tiktoken"), special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def token_counts(df: DataFrame, key: str, text: str, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """Columns key, tokenizer and tokens of each row; null and empty texts have 0 tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_counter(folder, t) for t in tokenizers]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for name, count in zip(tokenizers, counters):
                n = pa.array([count(t) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(texts), pa.string()), n], [key, "tokenizer", "tokens"])

    return df.select(key, text).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, tokenizer string, tokens bigint")


class Packer:
    """Online sum-of-squares packing of items of 1 to capacity into containers numbered from 0."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # open containers by fill; that of full ones stays 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels = np.zeros(0, np.int64)
        self.used = 0

    def place(self, size: int) -> int:
        """The container for an item; of equal choices the fullest."""
        counts, levels = self.counts, self.levels
        fits = levels[: np.searchsorted(levels, self.capacity - size, side="right")]
        best, change = 0, (2 * int(counts[size]) + 1 if size < self.capacity else 0)
        if len(fits):
            to = fits + size
            changes = 1 - 2 * counts[fits] + np.where(to < self.capacity, 2 * counts[to] + 1, 0)
            at = len(changes) - 1 - int(np.argmin(changes[::-1]))
            if changes[at] <= change:
                best = int(fits[at])
        if best:
            container = self.open[best].pop()
            self._count(best, -1)
        else:
            container = self.used
            self.used += 1
        if best + size < self.capacity:
            self.open[best + size].append(container)
            self._count(best + size, 1)
        return container

    def _count(self, level: int, by: int) -> None:
        self.counts[level] += by
        at = int(np.searchsorted(self.levels, level))
        if by > 0 and self.counts[level] == 1:
            self.levels = np.insert(self.levels, at, level)
        elif by < 0 and self.counts[level] == 0:
            self.levels = np.delete(self.levels, at)


_ROW = "spec_id int, shard bigint, local bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint, fill bigint"


def _pack_shard(part: pd.DataFrame) -> pd.DataFrame:
    """Packs one shard. fill is the final fill of the row's container if it stays open, else the capacity."""
    part = part.sort_values(["doc_id", "tokens"], kind="stable")
    capacity = int(part["capacity"].iloc[0])
    packer, rows, empty = Packer(capacity), [], []
    for doc, tokens in zip(part["doc_id"].tolist(), part["tokens"].tolist()):
        if tokens == 0:
            empty.append(doc)
            continue
        first = piece = 0
        # Only a document larger than a container is split: into full ones and a rest.
        while tokens - first > capacity:
            rows.append((packer.used, doc, piece, first, capacity))
            packer.used += 1
            first, piece = first + capacity, piece + 1
        rows.append((packer.place(tokens - first), doc, piece, first, tokens - first))
    # Documents without tokens take no space: they go to the shard's first container.
    rows.extend((0, doc, 0, 0, 0) for doc in empty)
    fill = np.full(max(1, packer.used), capacity, np.int64)
    for level in packer.levels.tolist():
        fill[packer.open[level]] = level
    if packer.used == 0:
        fill[0] = 0
    out = pd.DataFrame(rows, columns=["local", "doc_id", "piece", "first_token", "n_tokens"])
    return out.assign(spec_id=part["spec_id"].iloc[0], shard=part["shard"].iloc[0], fill=fill[out["local"].to_numpy()])[["spec_id", "shard", "local", "doc_id", "piece", "first_token", "n_tokens", "fill"]]


def _pack_open(part: pd.DataFrame) -> pd.DataFrame:
    """Packs the open containers of a group of shards, as items of their fill."""
    part = part.sort_values(["fill", "shard", "local"], ascending=[False, True, True], kind="stable")
    packer = Packer(int(part["capacity"].iloc[0]))
    home = [packer.place(f) if f else 0 for f in part["fill"].tolist()]
    return part.assign(home=home)[["spec_id", "shard", "local", "grp", "home"]]


def pack(items: DataFrame, specs: list[tuple[int, int, str]]) -> DataFrame:
    """Assigns every document to containers of each specification.

    items: columns doc_id, tokenizer, tokens; specs: (spec_id, capacity,
    tokenizer). Columns of the result: spec_id, container_id, doc_id, piece
    (from 0), first_token, n_tokens. Only documents larger than a container
    have several pieces. Documents without tokens are assigned to a container
    and take no space; rows that repeat are packed as often as they occur; no
    documents give no rows.
    """
    spark = items.sparkSession
    kinds = spark.createDataFrame(specs, "spec_id int, capacity bigint, tokenizer string")
    items = written(items, "tokens")
    shards = max(1, -(-items.count() // max(1, len({s[2] for s in specs})) // SHARD))
    # The specifications are a few rows of the caller's.
    sized = items.join(F.broadcast(kinds), "tokenizer").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    first = written(sized.select("spec_id", "capacity", "shard", "doc_id", "tokens").groupBy("spec_id", "shard").applyInPandas(_pack_shard, _ROW), "packed")
    still = first.join(F.broadcast(kinds), "spec_id").where("fill < capacity").select("spec_id", "capacity", "shard", "local", "fill", F.expr(f"shard div {GROUP}").alias("grp")).distinct()
    moved = still.groupBy("spec_id", "grp").applyInPandas(_pack_open, "spec_id int, shard bigint, local bigint, grp bigint, home bigint")
    own = F.shiftleft(F.col("shard"), 32) + F.col("local")
    return first.join(moved, ["spec_id", "shard", "local"], "left").select(
        "spec_id", F.coalesce(F.lit(1 << 62) + F.shiftleft(F.col("grp"), 32) + F.col("home"), own).alias("container_id"), "doc_id", "piece", "first_token", "n_tokens"
    )


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    specs = [(r.spec_id, r.capacity_tokens, r.tokenizer) for r in table(spark, folder, "container_specs").collect()]
    counts = token_counts(table(spark, folder, "documents"), "doc_id", "text", sorted({s[2] for s in specs}))
    return pack(counts, specs)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """How well each specification's containers are filled: spec_name, containers (of those with tokens), tokens, overfull (containers above their capacity), fill (tokens over the containers' capacity).

    packed: pack()'s rows; specs: spec_id, spec_name, capacity_tokens, a few rows. Without tokens the fill is null.
    """
    each = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("_n")).join(F.broadcast(specs.select("spec_id", "spec_name", "capacity_tokens")), "spec_id")
    used = each.groupBy("spec_name").agg(F.count_if(F.col("_n") > 0).alias("containers"), F.sum("_n").alias("tokens"), F.count_if(F.col("_n") > F.col("capacity_tokens")).alias("overfull"), F.max("capacity_tokens").alias("_c"))
    return used.select("spec_name", "containers", "tokens", "overfull", F.when(F.col("containers") > 0, F.round(F.col("tokens") / (F.col("containers") * F.col("_c")), 6)).alias("fill"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill(p7_packed(spark, folder), table(spark, folder, "container_specs"))
