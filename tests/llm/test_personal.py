from __future__ import annotations

import random

import pytest

from larkspur.llm import personal

GIVEN = "Alden Orla Felix Thea Rufus Edwin".split()
SUFFIX = ["worth", "field", "brook", "stock", "thorpe"]
PLACES = ["port", "ton", "mouth"]


def word(rng: random.Random) -> str:
    return "".join(rng.choice(["tra", "bel", "kor", "fin", "lu", "mon", "ger"]) for _ in range(rng.randint(1, 2))).capitalize()


def document(rng: random.Random) -> str:
    name = f"{rng.choice(GIVEN)} {word(rng)}{rng.choice(SUFFIX)}"
    kind = rng.randint(0, 3)
    if kind == 0:
        return f"Hello,\nMy name is {name}. Call me on 07700 900{rng.randint(100, 999)}. My order {rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-22 has not arrived. Passport no. AB{rng.randint(1000000, 9999999)}."
    if kind == 1:
        return f"Analysts in {word(rng)}{rng.choice(PLACES)} say margins should improve, though {name} does not agree. {word(rng)} Capital approved it."
    if kind == 2:
        return f"{name}, who leads the {word(rng)}{rng.choice(PLACES)} office of {word(rng)} Labs, said that the plan was off."
    return f"Shares of {word(rng)} Labs moved, said {name} of the {word(rng)}{rng.choice(PLACES)} exchange."


@pytest.fixture(scope="module")
def finder() -> personal.Finder:
    rng = random.Random(1)
    return personal.Finder(personal.Weights().train([document(rng) for _ in range(600)]))


def found(finder: personal.Finder, text: str | None) -> set[tuple[str, str]]:
    return {(k, text[a:b]) for a, b, k in finder.find(text)}


def test_given_names_are_learnt(finder) -> None:
    assert set(finder.w.given) >= {g.lower() for g in GIVEN} and len(finder.w.given) <= len(GIVEN) + 2


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, set()), ("", set()), ("   ", set()), ("Alden Labs v2.14.3, ISIN ORD-9006-66, INV52318382", set()), ("Thanks\n\nAlden", set()), ("@felix: see 2024-01-02 and 1,686 workers", set()),
        ("My name is Orla Korfield.", {("name", "Orla Korfield")}), ("My name is Korbrook, Thea.", {("name", "Korbrook, Thea")}), ("I am felix de la monworth.", {("name", "felix de la monworth")}), ("I AM RUFUS BELSTOCK-KORFIELD.", {("name", "RUFUS BELSTOCK-KORFIELD")}), ("This is Edwin Q. O’Lufield writing.", {("name", "Edwin Q. O’Lufield")}),
        ("Mail a.b+news@x-y.co.example.", {("email", "a.b+news@x-y.co.example")}), ("Mail info(at)lil.example, or", {("email", "info(at)lil.example")}), ("Mail press at dra dot example.", {("email", "press at dra dot example")}), ("Mail a_b [at] c [dot] org [dot] test", {("email", "a_b [at] c [dot] org [dot] test")}), ("Mail x @ y.test.", {("email", "x @ y.test")}),
        ("Call me on +44 7700 900760. Bye", {("phone", "+44 7700 900760")}), ("Phone: (533) 555 0173.", {("phone", "(533) 555 0173")}), ("Invoice 932/5039/24 is wrong. Ticket 1062-0846-28", set()),
        ("Passport no. C 03430716.", {("id_number", "C 03430716")}), ("SSN: 996-60-8277,", {("id_number", "996-60-8277")}), ("My social security number is 973 85 6440.", {("id_number", "973 85 6440")}), ("Mi DNI es 32.785.393-T.", {("id_number", "32.785.393-T")}),
        ("I live at 132 c Tunburel Close, Rulbarton 06286.", {("address", "132 c Tunburel Close")}), ("Our office is at 53 Vundrenen St.. Bye", {("address", "53 Vundrenen St.")}), ("Ich wohne in der Nersolholelstr. 97b, 12345 Au", {("address", "Nersolholelstr. 97b")}), ("Anschrift Kekir-Allee 136", {("address", "Kekir-Allee 136")}), ("Adresse : 54 chemin Traldalnol,", {("address", "54 chemin Traldalnol")}), ("Entreguem na Rua Plemurnir, 177.", {("address", "Rua Plemurnir, 177")}), ("адрес: пер. Маризыовая, д. 120, 431732", {("address", "пер. Маризыовая, д. 120")}),
        ("closed the plant in 2024 on the way", set()),
    ],
)
def test_kinds(finder, text: str | None, expected: set) -> None:
    assert found(finder, text) == expected


def test_skip_edges_carry_a_decision(finder) -> None:
    node = personal.Node
    sure, unsure, other = node(0, 5, ("name",), [4.0], ("x",)), node(500, 505, ("name",), [-0.7], ("x",)), node(900, 905, ("name",), [-0.7], ("y",))
    labels = [k for k, _ in finder._infer([sure, unsure, other])]
    assert labels == ["name", "name", None]


def test_rows_and_placeholders(spark) -> None:
    rng = random.Random(2)
    weights = personal.Weights().train([document(rng) for _ in range(400)])
    df = spark.createDataFrame([(1, "My name is Orla Korfield. Mail a@b.test."), (2, None), (3, ""), (1, "My name is Orla Korfield. Mail a@b.test.")], "id bigint, text string")
    rows = personal.personal_data(df, "id", "text", weights).collect()
    assert sorted((r.id, r.kind, r.val) for r in rows) == [(1, "email", "a@b.test")] * 2 + [(1, "name", "Orla Korfield")] * 2
    texts = sorted(((r.id, r.text) for r in personal.redacted(df, "id", "text", weights).collect()), key=str)
    assert texts == sorted([(1, "My name is [NAME]. Mail [EMAIL]."), (1, "My name is [NAME]. Mail [EMAIL]."), (2, None), (3, "")], key=str)
    assert personal.personal_data(df.limit(0), "id", "text", weights).count() == 0


def test_very_long_text(finder) -> None:
    text = "x " * 200_000 + "My name is Orla Korfield. " + "y" * 300_000 + " 1" * 50_000
    assert found(finder, text) == {("name", "Orla Korfield")}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("My name is Xandra Korfield. Bye", {("name", "Xandra Korfield")}), ("Please ask Dr. Xandra Lumonbrook about it.", {("name", "Xandra Lumonbrook")}),
        ("Shares of Belkor Labs moved, said Xandra Lumonworth of the Kormouth exchange.", {("name", "Xandra Lumonworth")}), ("Shares of Belkor Labs moved on Friday.", set()), ("Belkor Capital approved it.", set()), ("Belkor SA", set()),
    ],
)
def test_given_names_that_the_sample_does_not_hold(finder, text: str, expected: set) -> None:
    assert "xandra" not in finder.w.belief
    assert found(finder, text) == expected


def test_a_number_said_twice_has_one_kind(finder) -> None:
    text = "Passport number 123456789. Later he repeated 123456789 in the form."
    assert [(k, text[a:b]) for a, b, k in finder.find(text)] == [("id_number", "123456789")] * 2
    # Also where its shape speaks for the other kind.
    finder.w.shape["999999999"] = {"phone": 1.0, "id_number": -1.0, "other": -1.0}
    try:
        assert {k for _, _, k in finder.find(text)} == {"id_number"}
        assert {k for _, _, k in finder.find("Order 123456789 is late. I wrote 123456789 on it.")} == set()
    finally:
        del finder.w.shape["999999999"]


def test_kinds_of_street_beyond_the_commonest(finder) -> None:
    assert found(finder, "12 Bramble Walk, Leeds") == {("address", "12 Bramble Walk")}


def test_elimination_agrees_with_propagation_everywhere(finder) -> None:
    rng = random.Random(4)
    for _ in range(200):
        nodes = [personal.Node(i * 50, i * 50 + 5, ("phone", "id_number") if rng.random() < 0.5 else ("name",), [], (rng.choice("abc"),)) for i in range(4)]
        for n in nodes:
            n.scores = [rng.uniform(-4, 4) for _ in n.kinds]
            n.keys = (f"{len(n.kinds)}{n.keys[0]}",)
        edges, best = personal._linked(nodes), None
        for labels in __import__("itertools").product(*[range(len(n.labels)) for n in nodes]):
            total = sum([0.0, *n.scores][x] for n, x in zip(nodes, labels)) + sum(finder.w.tables[s][nodes[i].labels[labels[i]]][nodes[j].labels[labels[j]]] for i, j, s in edges)
            if best is None or total > best[0]:
                best = (total, labels)
        at = [[] for _ in nodes]
        for i, j, sort in edges:
            at[i].append((j, finder.w.tables[sort]))
            at[j].append((i, finder.w.tables[sort]))
        fixed = finder._eliminate(nodes, [[0.0, *n.scores] for n in nodes], at)
        # What elimination settles on a kind is so in the best labelling of all.
        assert all(f < 1 or f == x for f, x in zip(fixed, best[1]))


def test_all_documents_are_trained_on(spark) -> None:
    rng = random.Random(6)
    rare = [f"Q{a}{b}lin" for a in "aeiou" for b in "bdfgklmn"]
    texts = [document(rng) for _ in range(2500)] + [f"My name is {name} Korfield. Mail q{i}@b.test." for i, name in enumerate(rare)]
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "id bigint, text string").repartition(4)
    weights, found = personal.train(df, "id", "text")
    assert {name.lower() for name in rare} <= set(weights.belief)
    whole = personal.Weights().train(texts)
    assert (weights.given, weights.belief, weights.shape, weights.form) == (whole.given, whole.belief, whole.shape, whole.form)
    finder = personal.Finder(weights)
    rows = sorted(tuple(r) for r in personal.personal_data(found, "id", "text", weights).select("id", "start", "end", "kind").collect())
    assert rows == sorted((i, *x) for i, t in enumerate(texts) for x in finder.find(t))


def test_a_common_word_introduced_by_chance_is_no_given_name() -> None:
    rng = random.Random(7)
    texts = [document(rng) for _ in range(600)] + [f"The {word(rng)}{rng.choice(SUFFIX)} project moved, said the {word(rng)} office." for _ in range(1500)]
    texts += ["This is\nThe Korfield plan.", "I am\nThe Belstock plan."]
    weights = personal.Weights().train(texts)
    assert "the" not in weights.given and set(weights.given) >= {g.lower() for g in GIVEN}
    assert found(personal.Finder(weights), "The Lumonworth project moved, said Orla Korfield.") == {("name", "Orla Korfield")}
