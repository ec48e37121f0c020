from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from larkspur.functions.sketch import valid_hex16
from larkspur.operators import cooccurrence as co
from larkspur.operators import dedupe, graph, index, links, merge, model, ranking, series


def test_bm25_against_brute_force(spark) -> None:
    docs = [(1, "energy merger energy"), (2, None), (3, ""), (4, "merger of the merger"), (5, "nothing")]
    df = spark.createDataFrame(docs, "id bigint, text string")
    texts = {i: t.split() for i, t in docs if t}
    avg, n, out = sum(map(len, texts.values())) / len(texts), len(texts), {}
    for i, w in texts.items():
        s = 0.0
        for t in ("energy", "merger"):
            f, d = w.count(t), sum(t in x for x in texts.values())
            s += math.log(1 + max((n - d + 0.5) / (d + 0.5), 1e-6)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(w) / avg)) if f else 0
        if s:
            out[i] = round(s, 6)
    assert {r.id: r.score for r in ranking.bm25_scores(df, "id", "text", ["energy", "merger"]).collect()} == out
    assert ranking.bm25_scores(df.limit(0), "id", "text", ["energy"]).count() == 0


def test_postings_and_lengths(spark) -> None:
    df = spark.createDataFrame([(1, "Big deal", "deal deal now"), (2, None, None)], "id bigint, title string, lede string")
    assert {(r.id, r.term): r.wtf for r in index.postings(df, "id", "title", "lede").collect()} == {(1, "big"): 3, (1, "deal"): 7, (1, "now"): 2}
    stats = index.corpus_stats(index.lengths(df, "id", "title", "lede")).first()
    assert (stats.n_docs, stats.avg_length) == (2, 3.0)


def test_close_pairs_and_greedy_resolution(spark) -> None:
    random.seed(1)
    base = [random.getrandbits(64) for _ in range(8)]
    rows = []
    for i in range(160):
        h = base[i % 8]
        for _ in range(random.choice([0, 0, 1, 2, 4])):
            h ^= 1 << random.randrange(64)
        rows.append((i, f"{h:016x}" if i % 17 else None, i % 3))
    df = spark.createDataFrame(rows, "id bigint, s string, day int").withColumn("s", valid_hex16(F.col("s")))
    nodes = dedupe.classes(df, "id", "s", "day")
    pairs = dedupe.close_pairs(nodes)
    close = {(a, b) for a, x, d in rows for b, y, e in rows if a < b and d == e and x and y and bin(int(x, 16) ^ int(y, 16)).count("1") <= 4}
    first = {}
    for i, x, d in rows:
        if x:
            first.setdefault((x, d), i)
    assert {(r.a, r.b) for r in pairs.collect()} == {p for p in close if set(p) <= set(first.values())}
    assert {r.size for r in nodes.collect()} >= {1} and sum(r.size for r in nodes.collect()) == sum(1 for _, x, _ in rows if x)
    assert {r.id for r in dedupe.suppressed(df, "id", "s", "day").collect()} == {b for _, b in close}
    dropped: set[int] = set()
    for i, *_ in rows:
        if any((j, i) in close and j not in dropped for j in range(i)):
            dropped.add(i)
    assert {r.dropped for r in dedupe.first_wins(pairs).collect()} == dropped & set(first.values())
    # Every later copy of a class is dropped.
    assert {i for i, x, d in rows if x and first[x, d] != i} <= dropped
    assert dedupe.first_wins(pairs.limit(0)).count() == 0


def test_cooccurrence_golden(spark) -> None:
    df = spark.createDataFrame([(1, ["1", "2", "3"]), (2, None), (3, ["x"]), (4, [])], "id bigint, w array<string>")
    got = {(r.target, r.context): r.weight for r in co.cooccurrence(df, "id", "w", 2).collect()}
    assert got == {("1", "2"): 1, ("1", "3"): 0.5, ("2", "1"): 1, ("2", "3"): 1, ("3", "2"): 1, ("3", "1"): 0.5}
    assert sum(got.values()) == 5
    linear = {(r.target, r.context): r.weight for r in co.cooccurrence(spark.createDataFrame([(1, ["a", "b", "c", "d"])], "id bigint, w array<string>"), "id", "w", 3, "linear", 0.25).collect()}
    assert linear["a", "b"] == 1.0 and linear["a", "c"] == 0.75


def test_cosine_pairs_golden(spark) -> None:
    rows = [("alpha", "x", 1.0), ("beta", "x", 2.0), ("gamma", "x", 1.0), ("gamma", "y", math.sqrt(3)), ("delta", "z", 1.0)]
    got = sorted((r.left, r.right, round(r.score, 6)) for r in co.cosine_pairs(spark.createDataFrame(rows, "r string, c string, v double"), "r", "c", "v", 0.5 - 1e-9).collect())
    assert got == [("alpha", "beta", 1.0), ("alpha", "gamma", 0.5), ("beta", "gamma", 0.5)]


def test_most_similar_is_the_head_of_all_pairs(spark) -> None:
    rng = random.Random(5)
    for words, kinds, k, least in ((60, 3, 7, 0.501), (25, 40, 12, 0.501), (25, 40, 300, 0.0), (12, 2, 500, 0.901)):
        # Few kinds of vectors: many words have equal ones, more of a kind than k; many kinds: hardly any.
        made = [{c: float(rng.randint(1, 3)) for c in rng.sample("abcdef", rng.randint(1, 4))} for _ in range(kinds)]
        held = {f"w{i:02d}": rng.choice(made) for i in range(words)}
        norm = {w: math.sqrt(sum(x * x for x in v.values())) for w, v in held.items()}
        every = [(w, x, sum(held[w][c] * held[x].get(c, 0.0) for c in held[w]) / norm[w] / norm[x]) for w in held for x in held if w < x]
        expected = sorted([p for p in every if p[2] >= max(least, 1e-9)], key=lambda p: (-round(p[2], 9), *p[:2]))[:k]
        df = spark.createDataFrame([(int(w[1:]), c, x) for w, v in held.items() for c, x in v.items()], "r bigint, c string, v double")
        names = spark.createDataFrame([(int(w[1:]), w) for w in held], "r bigint, n string")
        got = [(r.left, r.right, round(r.score, 9)) for r in co.most_similar(df, "r", "c", "v", names, k, least).collect()]
        assert got == [(a, b, round(s, 9)) for a, b, s in expected]
    assert co.most_similar(df.limit(0), "r", "c", "v", names, 5).count() == 0


def test_many_equal_vectors_are_compared_once(spark) -> None:
    # 20,000 words with one vector are 200 million pairs with a score of 1.
    names = spark.range(20_000).select("id", F.format_string("w%05d", "id").alias("n"))
    df = names.select("id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("c"), F.lit(2.0).alias("v"))
    assert [(r.left, r.right) for r in co.most_similar(df, "id", "c", "v", names, 3, 0.5).collect()] == [("w00000", f"w0000{i}") for i in (1, 2, 3)]


def test_graph(spark) -> None:
    said = spark.createDataFrame([("Ann Bee, who leads The Lab",), (None,), ("",), ("Lab (LB)",)], "s string")
    rules = [("leads", r"([A-Z]\w+ [A-Z]\w+), who leads (.+)", 0.9), ("alias", r"(\w+) \((\w+)\)", 0.7)]
    triples = graph.pattern_triples(said, "s", rules)
    assert {(r.subject, r.relation, r.object) for r in triples.collect()} == {("ann bee", "leads", "lab"), ("lab", "alias", "lb")}
    doubled = triples.unionAll(triples)
    assert {(r.subject, r.mentions) for r in graph.merged(doubled).collect()} == {("ann bee", 2), ("lab", 2)}
    auth = {r.entity: r.authority for r in graph.authority(triples).collect()}
    assert auth["lab"] == 1.0 and auth["ann bee"] == 0.0
    pairs = graph.symmetric(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "x string, y string"), "x", "y")
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b"), ("b", "a")]
    names = spark.createDataFrame([("Horizon Lab",), ("Other",), (None,)], "n string")
    scores = [r.s for r in names.select(graph.match_score("horizon lab", F.col("n")).alias("s")).collect()]
    assert scores[0] == 1.0 and scores[1] < 0.4 and scores[2] is not None


def test_links(spark) -> None:
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("b", "a"), (None, "z")], "s string, d string")
    got = {r.node: r.depth for r in links.reachable(edges, "s", "d", spark.createDataFrame([("a",)], "n string"), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    pages = spark.createDataFrame([("p", 1, "x", ["a"]), ("p", 2, "x", ["a"]), ("p", 3, "y", ["b", "a"]), ("p", 4, "z", None)], "page string, at int, d string, i array<string>").withColumn("id", F.col("at"))
    got = [(r.revision, r.added, r.removed) for r in links.revisions(pages, "page", "at", "id", F.col("d"), F.col("i")).orderBy("revision").collect()]
    assert got == [(1, ["a"], []), (2, ["b"], []), (3, [], ["a", "b"])]
    led = links.ledger(spark.createDataFrame([("s", "d", 1), ("s", "d", 3), ("t", "d", 2)], "s string, d string, at int"), "s", "d", "at")
    assert {(r.dst, r.parent) for r in links.parents(led).collect()} == {("d", "s")}
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 00:40:00"), (2, "2024-01-01 00:00:00"), (3, None)], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [(r.k, r.samples, r.minutes) for r in links.cadence(events, "k", "t").collect()] == [(1, 2, 20.0)]


def test_series(spark) -> None:
    closes = [10.0, 0.0, 12.0, None, 15.0, 18.0]
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(closes)] + [("t", 0, 1.0)], "k string, at int, c double")
    got = {r.k: r.one_week for r in series.returns(df, "k", "at", "c").collect()}
    assert got == {"s": 80.0, "t": 0.0}
    kept = [c for c in closes if c is not None]
    r = [(b - a) / a for a, b in zip(kept, kept[1:]) if a]
    mean = sum(r) / len(r)
    expected = math.sqrt(sum((x - mean) ** 2 for x in r) / len(r)) * math.sqrt(252) * 100
    vol = {x.k: x.volatility for x in series.volatility(df, "k", "at", "c").collect()}
    assert abs(vol["s"] - expected) < 1e-6 and vol["t"] == 0.0


def test_logistic_training_against_plain_python(spark) -> None:
    random.seed(3)
    rows = [(random.random(), random.random()) for _ in range(60)]
    data = [(a, b, float(a > b)) for a, b in rows] + [(None, 0.5, 0.0), (0.1, 0.2, None)]
    weights, bias = model.train(spark.createDataFrame(data, "a double, b double, y double"), ["a", "b"], "y", iterations=15, rate=0.5)
    w, c = [0.0, 0.0], 0.0
    plain = [(a or 0.0, b, y) for a, b, y in data if y is not None]
    for _ in range(15):
        e = [1 / (1 + math.exp(-(w[0] * a + w[1] * b + c))) - y for a, b, y in plain]
        c -= 0.5 * sum(e) / len(e)
        w = [w[k] - 0.5 * sum(x * r[k] for x, r in zip(e, plain)) / len(e) for k in range(2)]
    assert abs(weights["a"] - w[0]) < 1e-9 and abs(weights["b"] - w[1]) < 1e-9 and abs(bias - c) < 1e-9
    assert model.train(spark.createDataFrame([], "a double, y double"), ["a"], "y") == ({"a": 0.0}, 0.0)


def test_merge(spark) -> None:
    df = spark.createDataFrame([("k", 2, "", ["b"]), ("k", 1, None, ["a", "b"]), ("k", 3, "v", None), (None, 1, "n", [])], "k string, o int, t string, l array<string>").withColumn("f", F.col("o") == 3)
    got = {r.k: (r.t, r.o, r.f, r.l) for r in merge.merge_fields(df, "k", F.col("o"), ["t"], ["o"], ["f"], ["l"]).collect()}
    assert got == {"k": ("v", 3, True, ["a", "b"]), None: ("n", 1, False, [])}
    assert {(r.k, r.o) for r in merge.first_wins(df, ["k"], [F.col("o")]).collect()} == {("k", 1), (None, 1)}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "i int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "i int, v string")
    assert sorted(tuple(r) for r in merge.upsert(old, new, ["i"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_nearest_vectors_in_blocks(spark, monkeypatch) -> None:
    from larkspur.operators import vectors

    monkeypatch.setattr(vectors, "ROWS", 30)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    random.seed(5)
    rows = [(i, [random.choice([-1.0, 0.0, 1.0]) for _ in range(5)]) for i in range(100)] + [(200, None), (201, []), (None, [1.0] * 5), (202, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = sorted((r.query, r.rank, r.id) for r in vectors.nearest(df, "id", "v", F.col("id") % 10 == 0, 3).collect())
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows if i is not None and v and any(v)}
    expected = []
    for q in (i for i in unit if i % 10 == 0):
        near = sorted(((-round(sum(a * b for a, b in zip(unit[q], unit[i])), 12), i) for i in unit if i != q))[:3]
        expected += [(q, n + 1, i) for n, (_, i) in enumerate(near)]
    assert got == sorted(expected)
