from __future__ import annotations

import random
from collections import defaultdict

from larkspur.llm import packing


def test_packer_never_overfills_and_stays_dense() -> None:
    rng = random.Random(2)
    for capacity in (1, 7, 100):
        packer, fill = packing.Packer(capacity), defaultdict(int)
        sizes = [rng.randint(1, capacity) for _ in range(3000)]
        for size in sizes:
            fill[packer.place(size)] += size
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(sizes)
        assert sum(sizes) >= 0.9 * capacity * len(fill)
        assert {k: v for k, v in fill.items() if v < capacity} == {c: level for level in packer.levels.tolist() for c in packer.open[level]}


def test_placement_is_the_least_sum_of_squares() -> None:
    rng = random.Random(4)
    packer = packing.Packer(20)
    for _ in range(400):
        size, before = rng.randint(1, 20), packer.counts.copy()

        def after(level: int) -> int:
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 20:
                n[level + size] += 1
            return int((n[1:20] ** 2).sum())

        choices = [0] + [h for h in range(1, 21 - size) if before[h]]
        packer.place(size)
        assert int((packer.counts[1:20] ** 2).sum()) == min(map(after, choices))


def test_every_document_is_assigned_once(spark) -> None:
    rng = random.Random(6)
    tokens = [rng.choice([0, 1, 5, 30, 99, 100, 101, 250]) for _ in range(500)]
    items = spark.createDataFrame([(i, "t", n) for i, n in enumerate(tokens)] + [(7, "t", tokens[7])], "doc_id bigint, tokenizer string, tokens bigint")
    old = packing.SHARD
    packing.SHARD = 60
    try:
        rows = packing.pack(items, [(1, 100, "t"), (2, 1000, "t")]).collect()
    finally:
        packing.SHARD = old
    for spec, capacity in ((1, 100), (2, 1000)):
        fill, parts = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.spec_id == spec:
                fill[r.container_id] += r.n_tokens
                parts[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity
        for i, n in enumerate(tokens):
            times = 2 if i == 7 else 1
            assert sum(p[2] for p in parts[i]) == n * times
            assert len(parts[i]) == times * max(1, -(-n // capacity))
        assert sum(fill.values()) >= 0.85 * capacity * len(fill)


def test_no_documents(spark) -> None:
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, tokenizer string, tokens bigint"), [(1, 10, "t")]).count() == 0
    only = packing.pack(spark.createDataFrame([(1, "t", 0), (2, "t", 0)], "doc_id bigint, tokenizer string, tokens bigint"), [(1, 10, "t")]).collect()
    assert {(r.doc_id, r.n_tokens) for r in only} == {(1, 0), (2, 0)}


def test_fill(spark) -> None:
    packed = spark.createDataFrame([(1, 10, 60), (1, 10, 40), (1, 11, 50), (1, 12, 0), (2, 9, 1001)], "spec_id int, container_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([(1, "small", 100), (2, "large", 1000)], "spec_id int, spec_name string, capacity_tokens int")
    assert {tuple(r) for r in packing.fill(packed, specs).collect()} == {("small", 2, 150, 0, 0.75), ("large", 1, 1001, 1, 1.001)}
