"""Deduplication of new batches against all that came before.

Method: content-defined chunking. A rolling hash over the last WINDOW bytes of
a text in normal form (its words, lower-cased, one blank between) sets the
chunks' boundaries. A persistent table holds each chunk once, with the first
class of texts that had it, so looking up a text gives at most one row a chunk,
however many texts share it. Shared bytes are summed by pair of new and old
class; where they cover COVERAGE of the new text the old class is its witness,
if the word sets confirm it. Chunks that are new are appended.

A text may be similar to an old one without sharing a chunk with the first
owner of it: classes that chunks do not settle are looked up in the exact index
of wordsets, which the history holds as well. Exact copies, page addresses and
fingerprints are looked up by equality.

All tables of a history are bucketed by the key they are looked up by: a batch
is exchanged, the history never is. Every table holds a key once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import wordsets
from larkspur.llm.near_duplicates import TEXTS
from larkspur.sources.tables import empty, exists, release, remove, scratch, spread, table, written

#: Bytes the rolling hash looks at, and the mean length of a chunk in bytes (a power of two).
WINDOW, MEAN = 8, 32
#: Share of a text's bytes that an old text's chunks must cover for it to be compared as a witness.
COVERAGE = 0.15
# Parameters of an address that do not make it another page.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_cid", "mc_eid", "mkt_tok", "icid", "ref", "ref_", "cmpid", "clid"]


def page_address(url: Column) -> Column:
    """The address without what does not change the page; null for null and blank.

    Left out: scheme, case of the host, a leading www., the scheme's default
    port, the fragment, a slash at the path's end, order of parameters and the
    TRACKING parameters.
    """
    plain = F.regexp_replace(F.trim(F.regexp_replace(url, r"(?U)^\s+|\s+$", "")), r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(plain, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":(?:80|443)$", ""))
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/$", "")
    query = F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING)))
    return F.when(plain != "", F.concat_ws("\n", F.regexp_replace(host, r"^www\.", ""), path, F.array_join(kept, "&")))


def fingerprint(simhash: Column) -> Column:
    """The fingerprint without case and outer white space; null for null, blank and one repeated digit."""
    plain = F.lower(F.regexp_replace(simhash, r"(?U)^\s+|\s+$", ""))
    return F.when((plain != "") & ~plain.rlike(r"^(.)\1*$"), plain)


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes of every chunk of the texts in their order, and the number of chunks of each text.

    A chunk ends behind a byte at which the rolling hash of the WINDOW bytes up
    to it has log2(MEAN) zero bits; the window never reaches into another text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    rolling = np.zeros(len(data), np.uint64)
    for back in range(WINDOW):
        # Each byte is weighted by its distance from the window's end.
        rolling[back:] += data[: len(data) - back] * (np.uint64(0x9E3779B97F4A7C15) ** np.uint64(back + 1))
    cut = (place >= WINDOW - 1) & ((wordsets._mix(rolling) >> np.uint64(17)) & np.uint64(MEAN - 1) == 0)
    cut[ends[sizes > 0] - 1] = True
    stops = np.flatnonzero(cut)
    starts = np.concatenate([[0], stops[:-1] + 1])
    lengths = stops - starts + 1
    within = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
    hashes = wordsets._mix(np.add.reduceat(wordsets._mix(data + np.uint64(257) * (within + np.uint64(1))), starts))
    counts = np.diff(np.concatenate([[0], np.searchsorted(stops, ends - 1, side="right")]))
    return hashes, lengths, counts


def distinct_chunks(hashes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk once a text, with the bytes of all its places."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    row, hashes, lengths = row[order], hashes[order], lengths[order]
    if not len(row):
        return hashes, lengths, counts
    begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]))
    return hashes[begins], np.add.reduceat(lengths, begins), np.bincount(row[begins], minlength=len(counts))


_MARKS = "id bigint, h bigint, names array<binary>, batch bigint"
_CONTENTS = "h bigint, words array<bigint>, chunks array<bigint>, bytes array<int>, batch bigint"
#: Bytes of a record's row in the largest table of a history, about.
RECORD_BYTES = 600


def _valid(df: DataFrame, key: str, batch: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(batch).isNotNull())


def _sets(columns: list[list[str | None]], cache: wordsets._Hashes, normal: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all records' distinct words in a row, their number by record, and the classes of records with words; the normal forms go to a list if one is given."""
    flat: list[int] = []
    sizes = []
    if len(cache) > wordsets._CACHE_LIMIT:
        cache.clear()
    for values in zip(*columns):
        words = wordsets.word_list(*values)
        once = set(words)
        sizes.append(len(once))
        flat.extend([cache[w] for w in once])
        if normal is not None:
            normal.append(" ".join(words).encode())
    values, size = np.array(flat, np.uint64), np.array(sizes, np.int64)
    return values, size, wordsets._classes(values, size)[0].view(np.int64)


def marks(df: DataFrame, key: str, texts: list[str], url: str, simhash: str, batch: str) -> DataFrame:
    """Columns id, h (the class; null without words), names (digests of page address and fingerprint) and batch of each record with a key and a batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = wordsets._Hashes()
        for b in batches:
            _, size, h = _sets([b.column(1 + i).to_pylist() for i in range(len(texts))], cache, None)
            full = np.zeros(len(size), np.int64)
            full[size > 0] = h
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, mask=size == 0), b.column(1 + len(texts)), b.column(2 + len(texts))], ["id", "h", "names", "batch"])

    named = F.array_compact(F.array(*[F.unhex(F.md5(F.concat(F.lit(kind), v))) for kind, v in (("page ", page_address(F.col(url))), ("print ", fingerprint(F.col(simhash))))]))
    return _valid(df, key, batch).select(F.col(key).cast("bigint"), *texts, named.alias("_names"), F.col(batch).cast("bigint").alias("_batch")).mapInArrow(work, _MARKS)


def contents(df: DataFrame, key: str, texts: list[str], batch: str) -> DataFrame:
    """Columns h, words, chunks (distinct), bytes of each, and batch of each record with words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = wordsets._Hashes()
        for b in batches:
            normal: list[bytes] = []
            values, size, h = _sets([b.column(i).to_pylist() for i in range(len(texts))], cache, normal)
            some = size > 0
            hashes, lengths, counts = distinct_chunks(*chunks([t for t, x in zip(normal, some) if x]))
            offsets, at = (np.concatenate([[0], np.cumsum(n)]).astype(np.int32) for n in (size[some], counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(pa.array(at), pa.array(lengths.astype(np.int32))), b.column(len(texts)).filter(pa.array(some))],
                ["h", "words", "chunks", "bytes", "batch"])

    return _valid(df, key, batch).select(*texts, F.col(batch).cast("bigint").alias("_batch")).mapInArrow(work, _CONTENTS)


class History:
    """A persistent history of accepted records in a shared folder, one bucketed table for each way of looking up.

    classes (h, words, chunks, bytes, batch) by h: word sets, chunks of one
    text and the first batch that had them; chunks (chunk, h, batch) by chunk:
    the first class of each chunk; entries by key: the exact index of wordsets; names (k, batch) by k: digests
    of page addresses and fingerprints. Opening the folder again, also in another
    application, gives the same history. The costs of words are those at the
    last building of the index, which is built anew whenever the history has
    doubled since, so no list of the index outgrows its limit by more than the
    classes accepted since then.

    take() accepts one batch or several at once; their numbers must be greater
    than those of all batches accepted before.
    """

    _TABLES = {"classes": (_CONTENTS, "h"), "chunks": ("chunk bigint, h bigint, batch bigint", "chunk"), "entries": ("key bigint, h bigint, bits bigint, size int, place int, batch bigint", "key"), "names": ("k binary, batch bigint", "k")}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, longest: int = wordsets.LONGEST):
        self.spark, self.path, self.longest = spark, path.rstrip("/"), longest
        self.id = uuid.uuid4().hex[:12]
        held = spark.read.text(f"{self.path}/about").first() if exists(spark, f"{self.path}/about") else None
        about = json.loads(held[0]) if held else {}
        self.buckets = about.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.count, self.built, self.poor = about.get("count", 0), about.get("built", -1), np.array(about.get("poor", [1 << 40] * wordsets.BANDS))
        self.costs = None
        if held:
            parts = spark.read.parquet(f"{self.path}/costs").orderBy("part").collect()
            self.costs = wordsets.Costs(np.frombuffer(b"".join(r["levels"] for r in parts), np.uint8), self.built, longest)
        for name, (schema, by) in self._TABLES.items():
            spark.sql(f"CREATE TABLE {self._name(name)} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _name(self, name: str) -> str:
        return f"larkspur_{self.id}_{name}"

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(self._name(name))

    def _append(self, df: DataFrame, name: str, mode: str = "append") -> None:
        """Writes df, which is partitioned by the key into the table's buckets already, to the table."""
        by = self._TABLES[name][1]
        df.write.mode(mode).format("parquet").bucketBy(self.buckets, by).sortBy(by).option("path", f"{self.path}/{name}").saveAsTable(self._name(name))
        release(self.spark)

    def _bucketed(self, df: DataFrame, by: str) -> DataFrame:
        return df.repartition(self.buckets, by)

    def _held(self, name: str, by: str, wanted: DataFrame) -> DataFrame:
        """The rows of a table whose key is among the wanted distinct ones; the table is streamed, not exchanged."""
        return self._table(name).join(wanted.hint("shuffle_hash"), by)

    def take(self, marked: DataFrame, texts: DataFrame, ask: bool = True) -> DataFrame:
        """Accepts records by their marks() and contents(), and gives column id: those whose text, page or fingerprint a smaller batch has. Written.

        With ask false nothing is looked up, and the result is empty.
        """
        least = marked.agg(F.min("batch")).first()[0]
        if least is None:
            return empty(self.spark, "id bigint")
        fresh = self._accept(marked, texts, least)
        return self._seen(marked, fresh, least) if ask else empty(self.spark, "id bigint")

    def _accept(self, marked: DataFrame, texts: DataFrame, least: int) -> DataFrame:
        """Appends the records and gives the rows of classes that the history lacked."""
        own = self._bucketed(texts, "h").groupBy("h").agg(F.min_by(F.struct("words", "chunks", "bytes"), "batch").alias("_r"), F.min("batch").alias("batch")).select("h", "_r.*", "batch")
        named = self._bucketed(self._names(marked).groupBy("k").agg(F.min("batch").alias("batch")), "k")
        if self.built >= 0:
            own = own.join(self._table("classes").select("h").hint("merge"), "h", "left_anti")
            named = named.join(self._table("names").select("k").hint("merge"), "k", "left_anti")
        self._append(own.select("h", "words", "chunks", "bytes", "batch"), "classes")
        self._append(named.select("k", "batch"), "names")
        # A class is new if its first batch is.
        fresh = self._table("classes").where(F.col("batch") >= least)
        owned = self._bucketed(fresh.select("h", "batch", F.explode("chunks").alias("chunk")), "chunk").groupBy("chunk").agg(F.min(F.struct("batch", "h")).alias("_o")).select("chunk", "_o.h", "_o.batch")
        if self.built >= 0:
            owned = owned.join(self._table("chunks").select("chunk").hint("merge"), "chunk", "left_anti")
        self._append(owned.select("chunk", "h", "batch"), "chunks")
        self.count = self._table("classes").count()
        if self.count >= 2 * max(0, self.built):
            self._build()
        else:
            self._append(self._indexed(fresh), "entries")
            self.poor = np.minimum(self.poor, wordsets.poorest(fresh, self.costs))
        text = json.dumps({"buckets": self.buckets, "count": self.count, "built": self.built, "poor": self.poor.tolist()})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/about")
        return self._table("classes").where(F.col("batch") >= least)

    def _indexed(self, classes: DataFrame) -> DataFrame:
        """The entries of classes, in the index's buckets."""
        return self._bucketed(wordsets.cheap_entries(classes, self.costs, ["batch"]), "key")

    def _build(self) -> None:
        """The index of all accepted classes anew, in the order of their words' costs."""
        classes = self._table("classes")
        self.costs, self.built = wordsets.costs(classes, self.longest), self.count
        size = 1 << 20
        parts = [(i, self.costs.levels[i * size : (i + 1) * size].tobytes()) for i in range(-(-len(self.costs.levels) // size))]
        self.spark.createDataFrame(parts, "part int, levels binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/costs")
        self.poor = wordsets.poorest(classes, self.costs)
        self._append(self._indexed(classes), "entries", "overwrite")

    def _seen(self, marked: DataFrame, fresh: DataFrame, least: int) -> DataFrame:
        """Column id: the records that a smaller batch has, once all of them are accepted."""
        near = written(self.by_chunks(fresh), "settled")
        release(self.spark)
        near = near.union(self.by_index(fresh, near, least))
        # A record whose class is open is the first of its text: classes that are not fresh, and later batches of fresh ones, are copies.
        open_ = fresh.select("h", "batch").join(near, "h", "left_anti")
        found = marked.where("h IS NOT NULL").select("id", "h", "batch").join(open_, ["h", "batch"], "left_anti").select("id")
        named = self._names(marked)
        hits = self._held("names", "k", named.select("k").distinct()).select("k", F.col("batch").alias("_first"))
        out = written(found.union(named.join(hits, "k").where("_first < batch").select("id")).distinct(), "seen")
        release(self.spark)
        return out

    @staticmethod
    def _names(marked: DataFrame) -> DataFrame:
        return marked.select("id", "batch", F.explode("names").alias("k"))

    def by_chunks(self, fresh: DataFrame, coverage: float = COVERAGE) -> DataFrame:
        """Column h: the classes of fresh that one class of a smaller batch covers by its chunks, confirmed on the word sets."""
        own = fresh.select("h", "batch", F.aggregate("bytes", F.lit(0), lambda a, x: a + x).alias("_all"), F.explode(F.arrays_zip("chunks", "bytes")).alias("_c"))
        each = own.select(F.col("h").alias("h_a"), F.col("batch").alias("_batch"), "_all", F.col("_c.chunks").alias("chunk"), F.col("_c.bytes").alias("_n"))
        shared = self._table("chunks").join(each.hint("shuffle_hash"), "chunk").where("batch < _batch")
        covered = shared.groupBy("h_a", F.col("h").alias("h_b")).agg(F.sum("_n").alias("_s"), F.first("_all").alias("_all")).where(F.col("_s") >= coverage * F.col("_all"))
        return self._confirmed(covered.select("h_a", "h_b"), fresh)

    def by_index(self, fresh: DataFrame, settled: DataFrame, least: int) -> DataFrame:
        """Column h: the classes of fresh, but for the settled ones, that the exact index finds similar to a class of a smaller batch."""
        # Both sides are the bucketed table: nothing is exchanged.
        entries = self._table("entries")
        a, b = entries.alias("a"), entries.where(F.col("batch") >= least).hint("shuffle_hash").alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.batch") < F.col("b.batch")) & wordsets.fits("a", "b") & wordsets.first_shared("a", "b"))
        candidates = met.select(F.col("b.h").alias("h_a"), F.col("a.h").alias("h_b"))
        poor = wordsets.poorest(fresh, self.costs)
        if wordsets.can_be_dear(poor, self.poor):
            old = self._table("classes")
            larger = wordsets.dear_candidates(fresh, old, self.costs, poor, self.poor)
            smaller = wordsets.dear_candidates(old, fresh, self.costs, self.poor, poor).select(F.col("h_b").alias("h_a"), F.col("h_a").alias("h_b"))
            candidates = candidates.union(larger).union(smaller)
        open_ = candidates.distinct().join(settled.withColumnRenamed("h", "h_a"), "h_a", "left_anti")
        return self._confirmed(open_, fresh)

    def _confirmed(self, candidates: DataFrame, fresh: DataFrame) -> DataFrame:
        """Column h: the new classes of the candidates (new h_a, old h_b) of which the old is of a smaller batch and the word sets reach the similarity."""
        new = candidates.join(fresh.select(F.col("h").alias("h_a"), F.col("words").alias("_a"), F.col("batch").alias("_batch")), "h_a")
        both = self._table("classes").join(new.withColumnRenamed("h_b", "h").hint("shuffle_hash"), "h")
        shared = F.size(F.array_intersect("_a", "words"))
        reached = wordsets.DENOMINATOR * shared >= wordsets.NUMERATOR * (F.size("_a") + F.size("words") - shared)
        return both.where((F.col("batch") < F.col("_batch")) & reached).select(F.col("h_a").alias("h")).distinct()

    def close(self) -> None:
        """Takes the tables' names out of the session's catalogue; the files stay."""
        for name in self._TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")


def seen_before(df: DataFrame, key: str, texts: list[str], url: str, simhash: str, batch: str, buckets: int | None = None, longest: int = wordsets.LONGEST) -> DataFrame:
    """Column id: records of a batch from 1 on whose text, page or fingerprint a smaller batch has already.

    The batches are fed in their order to a history that starts empty: the
    first alone, then as many at once as do not outnumber what was accepted,
    so that the rounds are few. Texts are the same if their word sets have a
    similarity of 0.65 or more. Records with a null key or batch take no part.
    Null and blank addresses, placeholders of fingerprints and records without
    words match nothing in that respect. No rows give no rows.
    """
    spark = df.sparkSession
    where = scratch(spark, "marks")
    marks(df, key, texts, url, simhash, batch).write.partitionBy("batch").parquet(where)
    marked = spark.read.schema(_MARKS).parquet(where)
    counts = marked.groupBy("batch").count().orderBy("batch").collect()
    store = History(spark, scratch(spark, "history"), buckets or spread(spark, sum(r["count"] for r in counts), RECORD_BYTES), longest)
    found, accepted, early = empty(spark, "id bigint"), 0, sum(r["batch"] < 1 for r in counts) > 1
    while counts:
        take = 1
        while accepted and take < len(counts) and sum(r["count"] for r in counts[: take + 1]) <= accepted:
            take += 1
        group, counts = counts[:take], counts[take:]
        if accepted or counts:
            within = (group[0]["batch"], group[-1]["batch"])
            own = contents(df.where(F.col(batch).between(*within)), key, texts, batch)
            found = found.union(store.take(marked.where(F.col("batch").between(*within)), own, ask=accepted > 0))
        accepted += sum(r["count"] for r in group)
    if early:
        found = found.join(marked.where("batch >= 1").select("id"), "id", "left_semi")
    found = written(found.distinct(), "found")
    store.close()
    for path in (store.path, where):
        remove(spark, path)
    return found


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen_before(table(spark, folder, "raw_articles"), "id", TEXTS, "url", "simhash", "batch_no")
