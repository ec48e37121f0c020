from __future__ import annotations

import random

import numpy as np
import pytest

from larkspur.llm import history, near_duplicates, survivorship, wordsets
from larkspur.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed: int, shuffled: bool = True) -> list[tuple[int, str | None, str | None]]:
    """Texts with copies, edits of all sizes, frequent words, short and empty ones."""
    rng = random.Random(seed)
    rows: list[tuple[int, str | None, str | None]] = [(1, None, None), (2, "", " "), (3, "a", None), (4, "A", ""), (5, "a b", None), (6, "ﬁ Ⅷ", "é"), (7, "é", "ﬁ Ⅷ")]
    texts = []
    for i in range(10, 260):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(words) // 3))):
                at = rng.randrange(len(words)) if words else 0
                match rng.randint(0, 3):
                    case 0 if len(words) > 1:
                        del words[at]
                    case 1:
                        words.insert(at, rng.choice(WORDS))
                    case 2 if words:
                        words[at] = rng.choice(WORDS)
                    case _ if shuffled:
                        rng.shuffle(words)
                    case _:
                        words = words[at:] + words[:at]
        else:
            words = [rng.choice(WORDS[:12]) if rng.random() < 0.5 else rng.choice(WORDS) for _ in range(rng.choice([2, 5, 20, 40, 80]))]
        texts.append(words)
        rows.append((i, " ".join(words[:5]), " ".join(words[5:]).upper() or None))
    return rows


def brute(rows: list) -> set[tuple[int, int]]:
    sets = [(i, wordsets.word_set(t, x)) for i, t, x in rows]
    return {(min(i, j), max(i, j)) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and i != j and 20 * len(a & b) >= 13 * len(a | b)}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed: int) -> None:
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "id bigint, title string, lede string")
    assert {(r.id_a, r.id_b) for r in near_duplicates.similar_pairs(df, "id", ["title", "lede"]).collect()} == brute(rows)


@pytest.mark.parametrize(("longest", "block"), [(3, 4096), (0, 3), (8, 2)])
def test_pairs_with_a_dear_part(spark, longest: int, block: int) -> None:
    rows = corpus(3)
    df = spark.createDataFrame(rows, "id bigint, title string, lede string")
    classes = wordsets.classes_of(df, ["title", "lede"])
    costs = wordsets.costs(classes, longest)
    poor = wordsets.poorest(classes, costs)
    assert wordsets.can_be_dear(poor, poor)
    pairs = wordsets.pairs_of_classes(classes, longest, block)
    assert {(r.id_a, r.id_b) for r in near_duplicates.expanded(wordsets.members(df, "id", ["title", "lede"]), pairs).collect()} == brute(rows)


def test_the_sketch_never_counts_too_few(spark) -> None:
    rows = [(i, "common " + (f"half{i}" if i % 2 else "half"), None) for i in range(200)]
    classes = wordsets.classes_of(spark.createDataFrame(rows, "id bigint, title string, lede string").repartition(7), ["title", "lede"])
    costs = wordsets.costs(classes, 90)
    flat, _ = wordsets._flat([["common"], [None]], wordsets._Hashes())
    assert costs.of(flat)[0] >= wordsets._level(np.array([101]))[0] and costs.is_dear(costs.of(flat)).all() and costs.records == 101
    flat, _ = wordsets._flat([["half3"], [None]], wordsets._Hashes())
    assert not costs.is_dear(costs.of(flat)).any()


def test_levels_grow_with_counts() -> None:
    counts = np.arange(0, 70000)
    levels = wordsets._level(counts).astype(int)
    assert (np.diff(levels) >= 0).all() and levels[64] == 64 and levels[128] == 72


def test_empty_table_and_hot_copies(spark) -> None:
    df = spark.createDataFrame([], "id bigint, title string, lede string")
    assert near_duplicates.similar_pairs(df, "id", ["title", "lede"]).count() == 0
    hot = spark.createDataFrame([(i, "one two three four", "five six seven") for i in range(300)] + [(999, "one two three four", "five six eight")], "id bigint, title string, lede string")
    rows = near_duplicates.duplicate_classes(hot, "id", ["title", "lede"]).collect()
    assert len(rows) == 301 and {(r.size, r.links) for r in rows} == {(300, 1), (1, 1)}


def test_history_against_brute_force(spark) -> None:
    rng = random.Random(5)
    base = corpus(4, shuffled=False)
    urls = ["http://www.a.example/p/", "https://A.example:443/p?utm_source=x#f", "https://a.example/p?b=1&a=2", "a.example/p?a=2&b=1&REF=z", "https://a.example/P", None, " ", "https://a.example:8443/p"]
    canon = ["p", "p", "pab", "pab", "P", None, None, "port"]
    prints = ["AB" * 8, "ab" * 8 + " ", "0" * 16, None, "", "12" * 8]
    rows = []
    for i, t, x in base:
        u, s = rng.randrange(len(urls)) if rng.random() < 0.06 else 5, rng.choice(prints) if rng.random() < 0.05 else None
        rows.append((i, t, x, urls[u], s, rng.randint(0, 3), canon[u]))
    df = spark.createDataFrame([r[:6] for r in rows], "id bigint, title string, lede string, url string, simhash string, batch int")
    batch = {r[0]: r[5] for r in rows}
    expected = {max(p, key=batch.get) for p in brute(base) if batch[p[0]] != batch[p[1]]}
    for value in (lambda r: r[6], lambda r: (r[4] or "").strip().lower() if len(set((r[4] or "").strip().lower())) > 1 else None):
        expected |= {r[0] for r in rows if value(r) and any(value(q) == value(r) and q[5] < r[5] for q in rows)}
    assert {r.id for r in history.seen_before(df, "id", ["title", "lede"], "url", "simhash", "batch", 3).collect()} == expected
    # With a dear part and an index that is built anew.
    assert {r.id for r in history.seen_before(df, "id", ["title", "lede"], "url", "simhash", "batch", 3, 2).collect()} == expected


def test_components(spark) -> None:
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000)]
    parent = {n: n for e in edges for n in e}

    def root(n: int) -> int:
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    assert {r.node: r.root for r in connected_components(df, "a", "b").collect()} == {n: root(n) for n in parent}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_survivors(spark) -> None:
    from pyspark.sql import functions as F

    rows = [(1, 10, "abc", "2024-01-01", 0.5), (1, 11, "abcd", "2024-01-02", 0.9), (1, 12, "abcd", "2024-01-02", 0.9), (2, 20, "long text", "2024-01-01", 0.1), (2, 21, "x", "2024-01-03", 0.9), (3, 30, None, None, 0.0), (3, 31, "", None, 0.0), (3, 32, "y", None, 0.0)]
    df = spark.createDataFrame(rows, "g bigint, id bigint, v string, at string, trust double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {r.g: (r.id, r.value, r.best_in_all) for r in survivorship.survivors(df, "g", "id", "at", {"v": (F.length("v"), F.col("v"))}, F.col("trust")).collect()}
    assert got == {1: (11, "abcd", True), 2: (20, "long text", False), 3: (32, "y", True)}


def test_mixing_is_a_bijection_on_samples() -> None:
    x = np.arange(10000, dtype=np.uint64)
    assert len(np.unique(wordsets._mix(x))) == len(x)


def test_persistent_history_takes_batches_one_by_one(spark) -> None:
    from larkspur.sources.tables import scratch

    base = corpus(8, shuffled=False)
    rng = random.Random(9)
    batch = {r[0]: i * 4 // len(base) for i, r in enumerate(base)}
    rows = [(i, t, x, f"https://a.example/{rng.randint(0, 900)}", None) for i, t, x in base]
    url = {r[0]: r[3] for r in rows}
    expected = {max(p, key=batch.get) for p in brute(base) if batch[p[0]] != batch[p[1]]} | {i for i in url if any(url[j] == url[i] and batch[j] < batch[i] for j in url)}
    path, found = scratch(spark, "history"), set()
    for n in range(4):
        # Opened again for each batch.
        store = history.History(spark, path, 3)
        df = spark.createDataFrame([(*r, n) for r in rows if batch[r[0]] == n], "id bigint, title string, lede string, url string, simhash string, batch int")
        marked = history.marks(df, "id", ["title", "lede"], "url", "simhash", "batch")
        found |= {r.id for r in store.take(marked, history.contents(df, "id", ["title", "lede"], "batch")).collect()}
        store.close()
    assert found == expected
    again = history.History(spark, path)
    for name, key in (("classes", "h"), ("chunks", "chunk"), ("names", "k")):
        assert again._table(name).count() == again._table(name).select(key).distinct().count()


def test_chunks_end_where_their_own_bytes_say() -> None:
    rng = random.Random(3)
    text = " ".join(rng.choice(WORDS) for _ in range(300)).encode()
    hashes, lengths, counts = history.chunks([b"", text, b"x", b"new words before " + text])
    assert counts[0] == 0 and counts[2] == 1 and lengths[: counts[1]].sum() == len(text) and lengths.sum() == 2 * len(text) + 18
    one, other = hashes[: counts[1]], hashes[counts[1] + 1 :]
    assert len(set(one) & set(other)) >= len(one) - 2 and 16 < lengths.mean() < 64


def family(members: int) -> list[tuple[int, str, str]]:
    """Edited copies of one text, every chunk of which is common, among other texts."""
    rng = random.Random(11)
    base, rows = [f"base{k}" for k in range(60)], []
    for i in range(members):
        words = [f"own{i}x{k}" if k in edited else w for edited in [set(rng.sample(range(60), rng.randint(3, 9)))] for k, w in enumerate(base)]
        rows.append((i, " ".join(words[:5]), " ".join(words[5:])))
    return rows + [(members + i, f"other{i}", " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(100)]


def test_history_finds_a_large_family_of_edited_copies(spark) -> None:
    rows = family(400)
    # One member comes first, so that most need a witness that is not among the earliest.
    batch = {i: 0 if i == 0 else 1 + i % 3 for i, _, _ in rows}
    df = spark.createDataFrame([(*r, None, None, batch[r[0]]) for r in rows], "id bigint, title string, lede string, url string, simhash string, batch int")
    expected = {max(p, key=batch.get) for p in brute(rows) if batch[p[0]] != batch[p[1]]}
    assert len(expected) > 250
    assert {r.id for r in history.seen_before(df, "id", ["title", "lede"], "url", "simhash", "batch").collect()} == expected


def test_persistent_history_finds_a_large_family(spark) -> None:
    rows = family(400)
    batch = {i: i % 2 for i, _, _ in rows}
    expected = {max(p, key=batch.get) for p in brute(rows) if batch[p[0]] != batch[p[1]]}
    df = spark.createDataFrame([(*r, None, None, batch[r[0]]) for r in rows], "id bigint, title string, lede string, url string, simhash string, batch int")
    found = {r.id for r in history.seen_before(df, "id", ["title", "lede"], "url", "simhash", "batch", 4, 20).collect()}
    assert len(expected) > 150 and found == expected
