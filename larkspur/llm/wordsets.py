"""Near-duplicate records by the Jaccard similarity of their word sets, exactly.

Method: universe-partition pigeonhole. The cost of a word is the number of sets
that hold it, estimated from above by a sketch of fixed size, and words are
ordered by it. Words up to LONGEST form the cheap part of the universe: each is
a segment of its own. Sets of sizes a and b with a similarity of 13/20 or more
share at least 13(a+b)/33 words; if they share a cheap word, their first shared
word in the order of cost is cheap and stands among the first a - 13a/20 + 1 of
either, which are indexed with their places: a pair counts where enough words
come behind the meeting point in both. No list of the cheap part is longer than LONGEST, at
any number of records.

If they share no cheap word, all of them differ, which leaves the dear part
7(a+b)/33 - c_a - c_b differences. The dear words are hashed into segments
whose number depends on the band of the smaller set's size. The smaller set
indexes the subset of its words in each segment, and these subsets with one
word deleted. The larger set is looked up with as many units of difference as
the pigeonhole asks for: none for a segment left out, one for a subset looked
up as it is, two for one looked up with its one-deletion neighbourhood, given
first where the frequencies of the words promise the shortest lists. The
fewest cheap words of a set in each band of sizes (a table of fixed length) say
what a partner must use up at least; records that cannot have a partner without
a shared cheap word are not in the dear part. Lists of more than BLOCK entries
are split into blocks on both sides.

Candidates pass a parity bitmap of 64 segments, whose set bits never exceed the
true difference, and are verified exactly on their word sets.

Records with equal word sets are one class throughout; classes are named by a
64-bit hash of the set.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.tables import spread, written

# The similarity as a fraction, and shared words as a share of both sizes.
NUMERATOR, DENOMINATOR = 13, 20
#: Words in more sets than this are dear.
LONGEST = 512
#: Lists of the dear part are split into blocks of this many entries.
BLOCK = 4096
#: Slots of the sketch of words: SLOTS_PER_RECORD for every record, between these bounds. The sketch, one byte a slot, is broadcast.
SLOTS_PER_RECORD, LEAST_SLOTS, MOST_SLOTS = 8, 1 << 16, 1 << 26
_SLICE = 1 << 12
#: Bytes of a class with its words, of an entry of the index and of a candidate, about.
CLASS_BYTES, ENTRY_BYTES = 480, 30
_WORD = re.compile(r"[^\W_]+")
_CACHE_LIMIT = 300_000
BANDS = 160


def word_list(*texts: str | None) -> list[str]:
    """Longest runs of letters and digits after NFC and lower-casing; null counts as empty."""
    return _WORD.findall(unicodedata.normalize("NFC", " ".join([t or "" for t in texts])).lower())


def word_set(*texts: str | None) -> set[str]:
    """The distinct words of the texts together."""
    return set(word_list(*texts))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    """Word -> 64-bit hash, kept for the words of the batch and those before it."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _flat(columns: list[list[str | None]], cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all records' words in a row, and the number of words of each record."""
    flat: list[int] = []
    sizes = []
    if len(cache) > _CACHE_LIMIT:
        cache.clear()
    for texts in zip(*columns):
        words = word_set(*texts)
        sizes.append(len(words))
        flat.extend([cache[w] for w in words])
    return np.array(flat, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def _tokens(columns: list[pa.Array], cache: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    return _flat([c.to_pylist() for c in columns], cache)


def listed(columns: list[pa.Array], _: _Hashes | None) -> tuple[np.ndarray, np.ndarray]:
    """As _tokens, of one column that holds the hashes of word sets already."""
    return columns[0].flatten().to_numpy(zero_copy_only=False).view(np.uint64), columns[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _classes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class hash and parity bitmap of each record with at least one word."""
    starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = np.add.reduceat(_mix(flat), starts)
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (flat & np.uint64(63)), starts)
    return _mix(sums + sizes[sizes > 0].astype(np.uint64)), bits


def _batches(batches: Iterator[pa.RecordBatch], key: str | None, texts: list[str], work: Callable, flatten: Callable = _tokens) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for batch in batches:
        flat, sizes = flatten([batch.column(t) for t in texts], cache)
        out = work(batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64) if key else None, flat, sizes)
        if out is not None:
            yield out


def classes_of(df: DataFrame, texts: list[str]) -> DataFrame:
    """Columns h and words (hashes of the words, 64 bits each), one row a class, written to the shared folder."""

    def emit(_: None, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        h, _ = _classes(flat, sizes)
        sizes = sizes[sizes > 0]
        _, first = np.unique(h, return_index=True)  # copies within the batch count once
        keep = np.zeros(len(h), bool)
        keep[first] = True
        offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
        values = flat[np.repeat(keep, sizes)].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["h", "words"])

    rows = df.select(*texts).mapInArrow(lambda b: _batches(b, None, texts, emit), "h bigint, words array<bigint>")
    n = spread(df.sparkSession, df.count(), CLASS_BYTES)
    return written(rows.repartition(n, "h").groupBy("h").agg(F.first("words").alias("words")), "classes")


def members(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Columns id and h (the class) of each record with at least one word; null keys are left out."""

    def emit(ids: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        h, _ = _classes(flat, sizes)
        return pa.RecordBatch.from_arrays([pa.array(ids[sizes > 0]), pa.array(h.view(np.int64))], ["id", "h"])

    source = df.select(F.col(key).cast("bigint").alias(key), *texts).where(F.col(key).isNotNull())
    return source.mapInArrow(lambda b: _batches(b, key, texts, emit), "id bigint, h bigint")


# ---- Costs of words -------------------------------------------------------------------------------------------------


def _level(counts: np.ndarray) -> np.ndarray:
    """A count as one byte: itself up to 64, then eight steps a doubling."""
    counts = np.asarray(counts, dtype=np.int64)
    steps = 64 + np.floor(8 * np.log2(np.maximum(counts, 64) / 64)).astype(np.int64)
    return np.where(counts <= 64, counts, np.minimum(steps, 255)).astype(np.uint8)


class Costs:
    """What each word costs: in how many sets it is, from above, as a level; and the number of sets."""

    def __init__(self, levels: np.ndarray, records: int, longest: int = LONGEST):
        self.levels, self.records, self.longest = levels, max(1, records), longest
        # The first level that may hold a count above the longest list allowed.
        self.dear = int(_level(np.array([longest]))[0]) + (1 if longest < 64 else 0)

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.levels[(words & np.uint64(len(self.levels) - 1)).astype(np.int64)]

    def is_dear(self, levels: np.ndarray) -> np.ndarray:
        return levels >= self.dear

    def share(self, levels: np.ndarray) -> np.ndarray:
        """The logarithm of the share of sets that hold a word of each level, about."""
        counts = np.where(levels <= 64, np.maximum(levels, 1), 64 * np.exp2((levels.astype(np.float64) - 64) / 8))
        return np.minimum(np.log(counts / self.records), 0.0)


def costs(classes: DataFrame, longest: int = LONGEST) -> Costs:
    """The sketch of the words of all classes (h, words). Its size has a fixed upper bound."""
    spark = classes.sparkSession
    records = classes.count()
    slots = 1 << min(int(math.log2(MOST_SLOTS)), max(int(math.log2(LEAST_SLOTS)), math.ceil(math.log2(max(1, records) * SLOTS_PER_RECORD))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, np.uint16)
        for batch in batches:
            flat, _ = listed([batch.column(0)], None)
            at, n = np.unique((flat & np.uint64(slots - 1)).astype(np.int64), return_counts=True)
            held[at] = np.minimum(held[at].astype(np.int64) + n, 65535)
        for begin in range(0, slots, _SLICE * 64):
            part = held[begin : begin + _SLICE * 64].reshape(-1, _SLICE)
            some = np.flatnonzero(part.any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some + begin // _SLICE), pa.array([part[i].tobytes() for i in some], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([_level(c).tobytes() for c in held.values()], pa.binary())], ["slice", "levels"])

    found = classes.select("words").mapInArrow(count, "slice bigint, counts binary").repartition("slice").mapInArrow(add, "slice bigint, levels binary")
    levels = np.zeros(slots, np.uint8)
    for row in found.toLocalIterator():
        levels[row["slice"] * _SLICE : (row["slice"] + 1) * _SLICE] = np.frombuffer(row["levels"], np.uint8)
    return Costs(levels, records, longest)


# ---- Sizes ----------------------------------------------------------------------------------------------------------


def _band(size: np.ndarray) -> np.ndarray:
    """Band of a size: each is about a quarter wider than the one before."""
    return np.minimum(np.floor(np.log(np.maximum(size, 1)) / np.log(1.25) + 1e-9).astype(np.int64), BANDS - 1)


#: The largest size that can be in each band.
_HIGH = np.floor(np.minimum(1.25 ** (np.arange(BANDS) + 1.0), 2.0**40)).astype(np.int64)


def _ceil(a: np.ndarray, b: int) -> np.ndarray:
    return -(-a // b)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most words in which sets of these sizes may differ."""
    return (DENOMINATOR - NUMERATOR) * (a + b) // (DENOMINATOR + NUMERATOR)


def _largest(a: np.ndarray) -> np.ndarray:
    """The size of the largest partner of a set of this size."""
    return a * DENOMINATOR // NUMERATOR


def _segments(band: np.ndarray) -> np.ndarray:
    """Into how many segments the dear words are hashed: two units each cover every difference that the band allows, and one more."""
    return _differ(_HIGH[band], _largest(_HIGH[band])) // 2 + 1


# ---- The cheap part -------------------------------------------------------------------------------------------------

ENTRY = T.StructType([T.StructField("key", T.LongType()), T.StructField("h", T.LongType()), T.StructField("bits", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("place", T.IntegerType())])


def _ordered(flat: np.ndarray, sizes: np.ndarray, costs: Costs) -> tuple[np.ndarray, ...]:
    """Row, word and level of every word, by row and then by cost, and its place in the row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    level = costs.of(flat)
    order = np.lexsort((flat, level, row))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    return row, flat[order], level[order], np.arange(len(flat)) - np.repeat(starts, sizes)


def _cheap(flat: np.ndarray, sizes: np.ndarray, costs: Costs) -> tuple[np.ndarray, ...]:
    """Keys, rows, sizes and places in the order of the entries of the cheap part."""
    row, word, level, place = _ordered(flat, sizes, costs)
    size = sizes[row]
    used = ~costs.is_dear(level) & (place <= size - _ceil(NUMERATOR * size, DENOMINATOR))
    return word[used], row[used], size[used], place[used]


def _entries(classes: DataFrame, costs: Costs, emit: Callable[..., tuple[np.ndarray, ...]], more: list[str] | None = None) -> DataFrame:
    """Rows of ENTRY from keys, rows, sizes and places that emit makes of the classes (h, words), with more columns (bigint) of the classes."""
    more = more or []
    sent = classes.sparkSession.sparkContext.broadcast(costs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = listed([batch.column(1)], None)
            if not len(flat):
                continue
            h = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            bits = np.bitwise_xor.reduceat(np.uint64(1) << (flat & np.uint64(63)), starts).view(np.int64)
            keys, rows, size, place = emit(flat, sizes, sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h[rows]), pa.array(bits[rows]), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), *[batch.column(2 + i).take(pa.array(rows)) for i in range(len(more))]], [*ENTRY.names, *more])

    schema = T.StructType([*ENTRY.fields, *[T.StructField(c, T.LongType()) for c in more]])
    return classes.select("h", "words", *more).where(F.size("words") > 0).mapInArrow(work, schema)


def cheap_entries(classes: DataFrame, costs: Costs, more: list[str] | None = None) -> DataFrame:
    """The entries (ENTRY) of the classes (h, words) in the cheap part of the index, with more columns of theirs."""
    return _entries(classes, costs, _cheap, more)


def _shared(a: Column, b: Column) -> Column:
    """The fewest words that sets of these sizes must share."""
    return F.floor((NUMERATOR * (a + b) + NUMERATOR + DENOMINATOR - 1) / (NUMERATOR + DENOMINATOR)).cast("int")


def fits(a: str, b: str) -> Column:
    """Whether sizes and bitmaps of two entries leave the similarity possible."""
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)) & (F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= n + m - 2 * _shared(n, m))


def first_shared(a: str, b: str) -> Column:
    """Whether two entries that meet in the cheap part could be similar if this were their first shared word: as many words must come behind it in both."""
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    return F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")) >= _shared(n, m)


# ---- The dear part --------------------------------------------------------------------------------------------------


def poorest(classes: DataFrame, costs: Costs) -> np.ndarray:
    """The fewest cheap words of a class in each band of sizes; a size no class has holds a number no set reaches."""
    sent = classes.sparkSession.sparkContext.broadcast(costs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(BANDS, 1 << 40)
        for batch in batches:
            flat, sizes = listed([batch.column(0)], None)
            sizes, c = sizes[sizes > 0], sent.value
            if len(sizes):
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                np.minimum.at(least, _band(sizes), np.add.reduceat((~c.is_dear(c.of(flat))).astype(np.int64), starts))
        some = np.flatnonzero(least < 1 << 40)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(least[some])], ["band", "least"])

    out = np.full(BANDS, 1 << 40)
    for r in classes.select("words").mapInArrow(work, "band bigint, least bigint").groupBy("band").agg(F.min("least").alias("least")).collect():
        out[r["band"]] = r["least"]
    return out


def can_be_dear(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two sets of these poorest() tables could be similar without a shared cheap word."""
    for a in np.flatnonzero(left < 1 << 40):
        for b in np.flatnonzero(right < 1 << 40):
            if left[a] + right[b] <= _differ(_HIGH[a], _HIGH[b]):
                return True
    return False


def _cheap_count(flat: np.ndarray, sizes: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is dear, and the number of cheap words of each row."""
    dear = costs.is_dear(costs.of(flat))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    return dear, np.add.reduceat((~dear).astype(np.int64), starts)


def _subsets(flat: np.ndarray, row: np.ndarray, dear: np.ndarray, rows: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, ...]:
    """For rows with their bands: the (row, segment) of every dear word, its mixed hash, and of every segment its row and sum.

    Segments of a row stand side by side, empty ones too.
    """
    segments = _segments(band)
    begin = np.concatenate([[0], np.cumsum(segments)[:-1]]).astype(np.int64)
    place = np.full(int(row.max()) + 1 if len(row) else 0, -1, np.int64)
    place[rows] = np.arange(len(rows))
    at = dear & (place[row] >= 0)
    word, of = flat[at], place[row[at]]
    mixed = _mix(word ^ _mix(band[of].astype(np.uint64) + np.uint64(1)))
    slot = begin[of] + (mixed % segments[of].astype(np.uint64)).astype(np.int64)
    sums = np.zeros(int(segments.sum()), np.uint64)
    np.add.at(sums, slot, mixed)
    owner = np.repeat(np.arange(len(rows)), segments)
    number = np.arange(len(sums)) - begin[owner]
    salt = _mix((number.astype(np.uint64) << np.uint64(8)) + band[owner].astype(np.uint64) + np.uint64(7))
    return at, slot, mixed, sums, owner, salt


_AS_IS, _DELETED = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _small(flat: np.ndarray, sizes: np.ndarray, costs: Costs, partners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of the smaller sets: the subset of each segment, and each with one word deleted."""
    dear, cheap = _cheap_count(flat, sizes, costs)
    band, most = _band(sizes), _largest(sizes)
    need = np.zeros(len(sizes), bool)
    for step in range(4):
        other = np.minimum(band + step, BANDS - 1)
        need |= (other <= _band(most)) & (cheap + partners[other] <= _differ(sizes, np.minimum(most, _HIGH[other])))
    rows = np.flatnonzero(need)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, slot, mixed, sums, owner, salt = _subsets(flat, row, dear, rows, band[rows])
    keys = np.concatenate([_mix(sums ^ salt ^ _AS_IS), _mix((sums[slot] - mixed) ^ salt[slot] ^ _DELETED)])
    of = rows[np.concatenate([owner, owner[slot]])]
    return keys, of, sizes[of], np.zeros(len(of), np.int64)


def _large(flat: np.ndarray, sizes: np.ndarray, costs: Costs, partners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys under which the larger sets are looked up: units of difference go first to the segments with the shortest lists."""
    dear, cheap = _cheap_count(flat, sizes, costs)
    row = np.repeat(np.arange(len(sizes)), sizes)
    low, high = _band(_ceil(NUMERATOR * sizes, DENOMINATOR)), _band(sizes)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(int((high - low).max()) + 1 if len(sizes) else 0):
        band = low + step
        budget = _differ(np.minimum(_HIGH[np.minimum(band, BANDS - 1)], sizes), sizes) - cheap - partners[np.minimum(band, BANDS - 1)]
        rows = np.flatnonzero((band <= high) & (budget >= 0))
        if not len(rows):
            continue
        at, slot, mixed, sums, owner, salt = _subsets(flat, row, dear, rows, band[rows])
        share = costs.share(costs.of(flat[at]))
        about = np.zeros(len(sums))
        np.add.at(about, slot, share)
        # A list's length, about: of the subset as it is, and of its longest one-deletion neighbour.
        longest = about.copy()
        np.maximum.at(longest, slot, about[slot] - share)
        unit_of, unit_slot, second = np.concatenate([owner, owner]), np.tile(np.arange(len(sums)), 2), np.repeat([0, 1], len(sums))
        order = np.lexsort((second, unit_slot, np.concatenate([about, longest]), unit_of))
        first = np.searchsorted(unit_of[order], np.arange(len(rows)))
        taken = order[np.arange(len(order)) - first[unit_of[order]] <= budget[rows][unit_of[order]]]
        units = np.bincount(unit_slot[taken], minlength=len(sums))
        one, two = np.flatnonzero(units >= 1), np.flatnonzero(units == 2)
        deleted = units[slot] == 2
        out.append((_mix(sums[one] ^ salt[one] ^ _AS_IS), rows[owner[one]]))
        out.append((_mix(sums[two] ^ salt[two] ^ _DELETED), rows[owner[two]]))
        out.append((_mix((sums[slot] - mixed)[deleted] ^ salt[slot][deleted] ^ _AS_IS), rows[owner[slot[deleted]]]))
    keys = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.uint64)
    of = np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64)
    return keys, of, sizes[of], np.zeros(len(of), np.int64)


def _split(small: DataFrame, large: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the number of a block pair: lists of more than block entries meet block by block."""
    lists = small.groupBy("key").agg(F.count("*").alias("_s")).join(large.groupBy("key").agg(F.count("*").alias("_l")), "key").where(F.greatest("_s", "_l") > block)
    hot = written(lists.select("key", F.ceil(F.col("_s") / block).cast("int").alias("_i"), F.ceil(F.col("_l") / block).cast("int").alias("_j")), "hot-keys")

    def salted(entries: DataFrame, own: str, other: str, first: bool) -> DataFrame:
        at = F.pmod(F.xxhash64("h"), F.coalesce(own, F.lit(1))).cast("int")
        rest = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return entries.join(hot, "key", "left").select(*ENTRY.names, at.alias("_x" if first else "_y"), rest.alias("_y" if first else "_x"))

    return salted(small, "_i", "_j", True), salted(large, "_j", "_i", False)


def dear_candidates(small: DataFrame, large: DataFrame, costs: Costs, poor_small: np.ndarray, poor_large: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Columns h_a and h_b: candidates without a shared cheap word, the first of small (h, words) and at most as large as the second, of large."""
    if not can_be_dear(poor_small, poor_large):
        return small.sparkSession.createDataFrame([], "h_a bigint, h_b bigint")
    indexed = written(_entries(small, costs, lambda f, s, c: _small(f, s, c, poor_large)), "dear-small")
    looked = written(_entries(large, costs, lambda f, s, c: _large(f, s, c, poor_small)), "dear-large")
    a, b = _split(indexed, looked, block)
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    near = (F.col("a.h") != F.col("b.h")) & (F.col("a.size") <= F.col("b.size")) & fits("a", "b")
    return a.join(b, same & near).select(F.col("a.h").alias("h_a"), F.col("b.h").alias("h_b")).distinct()


# ---- Pairs ----------------------------------------------------------------------------------------------------------


def pairs_of_classes(classes: DataFrame, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """Columns h_a < h_b: all pairs of the classes (h, words) with a similarity of 0.65 or more."""
    cost = costs(classes, longest)
    poor = poorest(classes, cost)
    # The exchange serves both sides: tests of one side alone would be pushed below it.
    entries = cheap_entries(classes, cost).repartition(spread(classes.sparkSession, cost.records, 16 * ENTRY_BYTES), "key")
    a, b = entries.alias("a"), entries.alias("b")
    met = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.h") < F.col("b.h")) & fits("a", "b") & first_shared("a", "b"))
    candidates = met.select(F.col("a.h").alias("h_a"), F.col("b.h").alias("h_b"))
    if can_be_dear(poor, poor):
        dear = dear_candidates(classes, classes, cost, poor, poor, block)
        candidates = candidates.union(dear.select(F.least("h_a", "h_b"), F.greatest("h_a", "h_b")))
    return verified(candidates.distinct(), classes, spread(classes.sparkSession, cost.records, CLASS_BYTES))


def class_pairs(df: DataFrame, texts: list[str], longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """Columns h_a < h_b: all pairs of different word sets with a similarity of 0.65 or more."""
    return pairs_of_classes(classes_of(df, texts), longest, block)


def verified(candidates: DataFrame, words: DataFrame, partitions: int, other: DataFrame | None = None) -> DataFrame:
    """The candidates (h_a, h_b) whose word sets reach the similarity; h_a is of words, h_b of other, or of words as well."""
    left = words.select("h", "words").repartition(partitions, "h")
    right = left if other is None else other.select("h", "words").repartition(partitions, "h")
    with_a = candidates.repartition(partitions, "h_a").alias("c").join(left.alias("a").hint("merge"), F.col("c.h_a") == F.col("a.h")).select("h_a", "h_b", F.col("a.words").alias("_a"))
    with_b = with_a.repartition(partitions, "h_b").alias("c").join(right.alias("b").hint("merge"), F.col("c.h_b") == F.col("b.h"))
    shared = F.size(F.array_intersect("_a", "b.words"))
    return with_b.where(DENOMINATOR * shared >= NUMERATOR * (F.size("_a") + F.size("b.words") - shared)).select("h_a", "h_b")
