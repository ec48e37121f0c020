"""Personal information in free text: found and replaced by typed placeholders.

Method: skip-chain conditional random field. The nodes of a document are the
stretches that could be personal data; each has a distribution over none and
the kinds it may be. A node's own potentials come from weights trained on
counts over all documents. Neighbouring nodes share a chain table, and
nodes with repeated or similar tokens (a surname said again, an e-mail address
made of it, a number or a street given twice) a skip table of their sort, each
with a potential for every pair of labels. Labels that no messages of the
neighbours could make the best are struck out first, again and again; loopy
belief propagation among the nodes still open gives the rest.

Training has no labelled rows: texts in which people introduce themselves,
and numbers behind a word that names their kind, are the weak labels.
Expectation maximisation estimates from them the weights of word endings,
contexts, given names and shapes of numbers; addresses and e-mail addresses
are weighed against matches that are none. Pseudo-likelihood estimates the
tables of potentials, with the own evidence of the weak labels taken out.
"""

from __future__ import annotations

import ast
import gc
import marshal
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import wraps

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.tables import table, written

#: Rounds of expectation maximisation, and the counts from which a feature of names has a weight.
_STEPS, _SUPPORT = 6, {"ending": 1.5, "left": 1.5, "right": 1.5, "second": 3.0}
#: What sums of parts may be less than their whole number.
_ROUNDING = 1e-6
_USE = ["a", "second", "left", "right", "seed"]
_WORD_COLUMNS = ["a", "second_h", "second_e4", "second_e3", "second_e2", "left_h", "left_n", "right_h", "right_n", "uses", "seeds", "f", "h", "v"]
#: Counts that a task holds before it hands them on.
_HELD = 200_000
#: Surnames whose scores a task keeps, at most.
_SURNAMES = 200_000
KINDS = ("email", "phone", "id_number", "address", "name")
#: What nodes may be, as candidates are kept; the last are names whose first word is not a given name that was learnt.
_SETS = (("email",), ("address",), ("phone", "id_number"), ("name",), ("name",))
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
LABELS = (None, *KINDS)
_LABEL_OF = {k: i for i, k in enumerate(LABELS)}
#: Sorts of edges: neighbours, one number twice, one word of a name twice, a name and an e-mail address made of it, one street twice.
SORTS = ("chain", "number", "name", "mail", "street")
#: Nodes nearer than this, in characters, are neighbours.
NEAR = 60

# Words by which a writer gives a name.
INTRODUCTIONS = "my name is|i am|this is|mein name ist|ich bin|hier schreibt|je m’appelle|je suis|me llamo|soy|mi chiamo|sono|meu nome é|sou|mijn naam is|ik ben|меня зовут|пишет"
TITLES = r"mr\.?|mrs\.?|ms\.?|dr\.?|prof\.?|frau|herr|mme|mlle|m\.|d\.ª|d\.|sr\.?|sra\.?|sr\.ª|dhr\.|mevr\.|sig\.|sig\.ra|dott\.|г-н|г-жа"
# Words before numbers, by what the number then is; short forms as they are written.
PHONE_CUES = "phone tel tél telephone telefon téléphone teléfono telefono telefone telefoon mobile mobil cell call handy rufen nummer number numéro número numero appelez llámeme chiamatemi ligue bel тел телефон звоните номеру ☎ t m fax"
ID_CUES = "passport passeport pasaporte passaporto passaporte paspoort paspoortnummer reisepass паспорт паспорта ssn security sociale social ausweis ausweisnummer personalausweis card carte identité identidad identità dni nie nif cpf rg bsn fiscale fiscal steuer-id steuer снилс инн identity insurance nino national sécurité tax taxpayer"
OTHER_CUES = "order invoice ticket bestellung rechnung commande facture pedido factura ordine fattura encomenda fatura factuur заказ счёте счёт isin ref reference case tracking shipment"
# Words for kinds of street; before the name, behind it, and as its end.
STREET_BEHIND = "street st. st road rd. rd avenue ave. ave lane ln. ln close drive dr. court terrace way square place boulevard crescent grove gardens hill row walk mews parade rise quay wharf alley circle parkway"
STREET_BEFORE = "rue avenue av. avda. avda boulevard bd. chemin place allée impasse quai route cours calle avenida plaza paseo camino ronda c/ via viale piazza corso vicolo largo rua travessa praça estrada alameda ул. ул улица пер. переулок проспект просп. пр-т бульвар б-р площадь пл. набережная наб. шоссе"
STREET_ENDS = "straße strasse str. weg gasse platz allee ring damm ufer straat laan kade plein gracht dijk singel steeg"
PARTICLES = "de la las los del dos das da do di du des le van von der den zu zum ter ten te el y af av della dello"

_LETTER = r"[^\W\d_]"
_WORD = rf"{_LETTER}+(?:[’'ʼ\-‑]{_LETTER}+)*"
_PART = r"(?:" + "|".join(PARTICLES.split()) + r")"
# Initials and particles; first without, as most have none and a capital and a further letter are neither.
_BETWEEN = rf"(?:(?:[ \u00a0\u2009\u202f]{_LETTER}\.)*(?:[ \u00a0\u2009\u202f]{_PART}){{0,3}})??"
# Every capital letter of the first plane, and all of the others, of which isupper() is asked.
_ANY_UPPER = "[" + "".join(c for c in map(chr, range(0x10000)) if c.isupper() and c.isalpha()) + "\U00010000-\U0010ffff]"
# A pattern that begins with a set of characters is searched for faster than one that begins with a look back.
_CAPITAL = re.compile(rf"({_ANY_UPPER}(?<![\w’'\-].){_LETTER}++(?:-{_LETTER}++)?+)(?={_BETWEEN}[ \u00a0\u2009\u202f]({_ANY_UPPER}(?:{_LETTER}++(?:[’'ʼ\-‑]{_LETTER}++)*+|(?:[’'ʼ\-‑]{_LETTER}++)++)))")
_UPPER = "[" + "".join(c for c in map(chr, range(0x250)) if c.isupper()) + "\u0386-\u03ab\u0400-\u042f]"
# Two capitalised words as a name has them, whatever the words.
_PAIR = re.compile(rf"({_UPPER}(?<![\w’'\-@.].){_LETTER}++(?:-{_LETTER}++)?+)(?={_BETWEEN}[ \u00a0\u2009\u202f]+({_UPPER}(?:{_LETTER}|[’'ʼ\-‑](?={_LETTER}))+))")
_SURNAME = re.compile(rf"((?:[ \u00a0\u2009\u202f]+{_LETTER}\.)*(?:[ \u00a0\u2009\u202f]+{_PART}){{0,3}})[ \u00a0\u2009\u202f]+({_WORD})", re.I)
_BEFORE_COMMA = re.compile(rf"((?:{_LETTER}\.[ \u00a0]){{0,3}}(?:{_PART}[ \u00a0\u2009\u202f]){{0,3}}{_WORD}),[ \u00a0\u2009\u202f]+$", re.I)
_BEFORE_BLANK = re.compile(rf"({_WORD})[ \u00a0\u2009\u202f]$")
# The last words of what _INTRO matches, for a look before it is tried.
_INTRO_ENDS = tuple({x.split()[-1] for x in INTRODUCTIONS.split("|")} | {t.replace("\\.?", end).replace("\\.", ".") for t in TITLES.split("|") for end in ("", ".")})
_ENDS_BY_LAST = {c: tuple(x for x in _INTRO_ENDS if x[-1] == c) for c in {x[-1] for x in _INTRO_ENDS}}
_LEFT = re.compile(r".*(?<!\w)(\w+)[^\w\n|]{1,3}\Z", re.S)
_RIGHT = re.compile(r"\W{0,2}(\w*)")
_INTRO = re.compile(rf"(?:\b(?:{INTRODUCTIONS})|(?:^|[\s|])(?:{TITLES}))\s+$", re.I)

_AT = r"(?:@|[ \u00a0\u2009\u202f]@[ \u00a0\u2009\u202f]|[ \u00a0\u2009\u202f]?[\[(]\s?(?:at|@)\s?[\])][ \u00a0\u2009\u202f]?)"
_DOT = r"(?:\.|[ \u00a0\u2009\u202f]?[\[(]\s?(?:dot|\.)\s?[\])][ \u00a0\u2009\u202f]?)"
_LOCAL, _LABEL = r"[A-Za-z0-9_%+](?:[A-Za-z0-9_%+.\-]*[A-Za-z0-9_%+])?", r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_EMAIL = re.compile(rf"(?<![\w.+%-])(?:{_LOCAL}{_AT}{_LABEL}(?:(?:{_DOT}|[ \u00a0\u2009\u202f]dot[ \u00a0\u2009\u202f]){_LABEL})+|{_LOCAL}[ \u00a0\u2009\u202f]at[ \u00a0\u2009\u202f]{_LABEL}(?:[ \u00a0\u2009\u202f]dot[ \u00a0\u2009\u202f]{_LABEL})+)(?![\w@])", re.I)
_EMAIL_LOOK = re.compile(r"at\s?[\])]")
_EMAIL_SIGNS = re.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s\S+\sdot\s", re.I)

_NUMBER = re.compile(r"[+(\d](?<![\w#/.,\-−+].)(?:(?<=\+)\d|(?<=\()\+?\d|(?<=\d))(?:[ \u00a0\u2009\u202f]?[()/.\-–]?[ \u00a0\u2009\u202f]?[()]?\d)+")
# Forms of documents' numbers that hold letters.
_LETTERED = re.compile(r"[A-Z\d](?<![\w#\-].)(?<=(?=((?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|[A-Z]{1,2} ?\d{7,8}|[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]|\d{2}\.?\d{3}\.?\d{3}[ \-]?[A-Z]|[XYZ][ \-]?\d{7}[ \-]?[A-Z]|(?=[A-Z0-9]*\d[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{9,10})(?![\w\-]))).)")
_DATE = re.compile(r"(?:19|20)\d\d[-./](?:\d\d?)[-./]\d\d?|\d\d?[-./]\d\d?[-./](?:19|20)\d\d|(?:19|20)\d\d\s?[-–]\s?(?:19|20)\d\d")
_ADDITION = r"\d{1,4}(?:[ \u00a0\u2009\u202f]?(?:bis|ter|[a-dа-г]))?(?![\w])"
_NAME_OF_STREET = rf"{_WORD}(?:[ \u00a0\u2009\u202f]{_WORD}){{0,2}}?"


def _alternatives(words: str) -> str:
    return "|".join(re.escape(w) for w in sorted(words.split(), key=len, reverse=True))


_BEHIND = re.compile(rf"(?<![\w.,/\-])({_ADDITION},?[ \u00a0\u2009\u202f]{_NAME_OF_STREET}[ \u00a0\u2009\u202f](?:st\.|(?:{_alternatives(STREET_BEHIND.replace('.', ''))})(?!\w)))", re.I)
_BEFORE = re.compile(rf"(?<![\w.,/\-])({_ADDITION},?[ \u00a0\u2009\u202f](?:{_alternatives(STREET_BEFORE)})[ \u00a0\u2009\u202f](?:(?:de|du|des|la|l’|d’|del|da|do|dos|di)[ \u00a0\u2009\u202f]?){{0,3}}{_WORD}|(?<!\w)(?:{_alternatives(STREET_BEFORE)})[ \u00a0\u2009\u202f](?:{_PART}[ \u00a0\u2009\u202f]){{0,3}}{_NAME_OF_STREET},?[ \u00a0\u2009\u202f](?:(?:д\.|n\.º|nº|n°|no\.|nr\.)[ \u00a0\u2009\u202f]?)?{_ADDITION})", re.I)
_ENDS = re.compile(rf"(?<![\w])((?:{_WORD}-)?(?:{_LETTER}{{2,}}(?:{_alternatives(STREET_ENDS)})|(?:{_WORD}-|{_WORD}[ \u00a0\u2009\u202f])(?:{_alternatives(STREET_ENDS)}))[ \u00a0\u2009\u202f]{_ADDITION})", re.I)
_HOUSE = re.compile(r"(?<![\d.,])\d{1,4}(?![\d%])")


class Node:
    """A stretch that could be personal data: its place, the kinds it may be and their potentials against none."""

    __slots__ = ("start", "end", "kinds", "scores", "keys", "labels", "unlearnt")

    def __init__(self, start: int, end: int, kinds: tuple[str, ...], scores: list[float], keys: tuple[str, ...], unlearnt: bool = False):
        self.start, self.end, self.kinds, self.scores, self.keys, self.unlearnt = start, end, kinds, scores, keys, unlearnt
        self.labels = (0, *[_LABEL_OF[k] for k in kinds])


def _shape(number: str) -> str:
    out = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", number))
    return re.sub(r"[ \u00a0\u2009\u202f]", " ", out)


_PHONE, _ID, _OTHER = (set(w.split()) for w in (PHONE_CUES, ID_CUES, OTHER_CUES))
_CUE_WORDS = re.compile(r"☎|[^\W\d_]+(?:-[^\W\d_]+)?")


def _cue(text: str, start: int) -> str | None:
    """What the words before a number on its line say it is; the nearest counts."""
    left = text[max(0, start - 32) : start]
    left = left[max(left.rfind("\n"), left.rfind("|"), left.rfind("\r")) + 1 :].lower()
    for word in reversed(_CUE_WORDS.findall(left)[-5:]):
        if word in _ID:
            return "id_number"
        if word in _OTHER:
            return "other"
        if word in _PHONE:
            # "social security number is" names its kind before the word number.
            return "id_number" if word in ("number", "nummer", "numéro", "número", "numero") and any(w in _ID for w in _CUE_WORDS.findall(left)) else "phone"
    return None


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _NUMBER.finditer(text):
        v = m.group()
        if len(v) < 7 or v.count(")") > v.count("("):
            continue
        digits = sum(map(str.isdigit, v))
        if 7 <= digits <= 15 and not _DATE.fullmatch(v):
            yield m.start(), m.end(), _shape(v)
    last = 0
    for m in _LETTERED.finditer(text):
        if m.start() >= last:
            last = m.end(1)
            yield m.start(), last, _shape(m[1])


#: Belief in a match of the patterns of streets and of e-mail addresses before its features are looked at.
_BASE = {"address": 2.0, "email": 4.0}
_POST = re.compile(r"[\s,.]{1,3}(?:[^\W\d_]+[\s,]{1,2}){0,2}(?:[A-Z]{1,2}\d|\d{4,6}\b)")


def _prior(sort: str) -> list[list[float]]:
    """A table of potentials before training: equal decisions are likelier, and two kinds on one token less likely than a kind and none."""
    agree, against, other = {"chain": (0.3, -0.3, 0.3), "number": (2.0, -2.0, -4.0), "name": (0.75, -0.75, -0.75), "mail": (0.75, -0.75, 0.75), "street": (0.75, -0.75, -1.5)}[sort]
    return [[agree if a == b else against if 0 in (a, b) else other for b in range(len(LABELS))] for a in range(len(LABELS))]


def _address_features(text: str, start: int, end: int) -> list[str]:
    left, _ = _beside(text, start, end)
    digits = text[start].isdigit()
    return [f"left {left}", "number first" if digits else "number last", *(["post"] if _POST.match(text, end) else [])]


def _email_features(text: str, start: int, end: int) -> list[str]:
    value, (left, _) = text[start:end], _beside(text, start, end)
    return [f"left {left}", *(["signs"] if "@" in value or "(" in value or "[" in value else [])]


def _without_evidence(text: str, node: Node) -> tuple[list[float], int | None]:
    """The node's potentials without the evidence that labels it, and that label; None if it has none."""
    if node.kinds == ("name",):
        return ([node.scores[0] - 3.0], _LABEL_OF["name"]) if _introduced(text, node.start) else (node.scores, None)
    if len(node.kinds) == 2 and (cue := _cue(text, node.start)):
        return [x - (3.5 if cue == k else -3.0) for k, x in zip(node.kinds, node.scores)], _LABEL_OF.get(cue, 0)
    return node.scores, None


def _linked(nodes: list[Node]) -> list[tuple[int, int, str]]:
    """The edges of a document's nodes, with their sorts."""
    edges = [(i, i + 1, "chain") for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end < NEAR]
    last: dict[str, int] = {}
    for i, n in enumerate(nodes):
        for k in n.keys:
            j = last.get(k)
            if j is not None and j != i:
                kinds, others = n.kinds, nodes[j].kinds
                edges.append((j, i, "mail" if (kinds[0] == "email") != (others[0] == "email") else "number" if len(kinds) == 2 else "street" if kinds[0] == "address" else "name"))
            last[k] = i
    return edges


class Weights:
    """Trained weights: given names, endings of surnames, words beside names, shapes of numbers, neighbouring kinds."""

    def __init__(self) -> None:
        self.given: dict[str, float] = {}
        self.ending: dict[str, float] = {}
        self.left: dict[str, float] = {}
        self.right: dict[str, float] = {}
        self.second: dict[str, float] = {}
        self.shape: dict[str, dict[str, float]] = {}
        #: Introductions a use, over all first words.
        self.rate = 0.0
        #: Belief of every first word of a pair in the sample, given name or not.
        self.belief: dict[str, float] = {}
        #: Forms of addresses and of e-mail addresses, feature by feature.
        self.form: dict[str, dict[str, float]] = {"address": {}, "email": {}}
        #: For every sort of edge the potential of each pair of labels.
        self.tables = {sort: _prior(sort) for sort in SORTS}
        self._measure()

    def _measure(self) -> None:
        """For each table the most that an edge of it can change between two labels."""
        self.swing = {sort: float(max(abs(t[a][j] - t[b][j]) for a in range(6) for b in range(6) for j in range(6))) for sort, t in self.tables.items()}
        self.lift = self.swing["name"]

    def train(self, texts: list[str]) -> Weights:
        """Weights from a list of texts, by the counts that train() takes over a table."""
        uses, shapes = Counter(), Counter()
        for text in texts:
            for a, second, left, right, seed in _uses(text):
                for f, v, n in (("second", second, 1), ("left", left, 1), ("right", right, 1), ("seed", "", seed)):
                    if n:
                        uses[a, f, v] += n
            _count_shapes(text, shapes)
        first: dict[str, list] = defaultdict(list)
        for (a, f, v), n in uses.items():
            first[a].append((f, v, n))
        self.shapes([(*k, n) for k, n in shapes.items()])
        rows = list(first.items())
        self.rate = sum(n for (_, f, _), n in uses.items() if f == "seed") / max(1, sum(n for (_, f, _), n in uses.items() if f == "left"))
        for step in range(_STEPS):
            counts: dict = {}
            for a, features in rows:
                self.tally(features, step == 0, counts)
            self.weigh([(f, v, y, n) for (f, v), (y, n) in counts.items()])
        self.believe([(a, *self.about(features)) for a, features in rows])
        finder = Finder(self, training=True)
        found = [(text, *finder.candidates(text)) for text in texts]
        forms, edges = Counter(), Counter()
        for text, nodes, rejected in found:
            _count_forms(text, nodes, rejected, self.lift, forms)
        self.forms(forms)
        for text, nodes, _ in found:
            _count_edges(text, finder.scored(text, nodes, self.lift), edges)
        self.edges(edges)
        return self

    def forms(self, counts: Counter) -> None:
        """Log odds of the features of addresses and e-mail addresses, from counts of kind, whether it is one, and feature; None counts the matches.

        Against addresses stand the matches of their patterns without a capital
        letter ("3 plants on the way"), against e-mail addresses the names.
        """
        for kind in self.form:
            n_yes, n_no = counts[kind, True, None], counts[kind, False, None]
            if n_yes >= 20 and n_no >= 20:
                yes, no = ({x: n for (k, is_one, x), n in counts.items() if k == kind and is_one == one and x is not None} for one in (True, False))
                self.form[kind] = {x: round(max(-1.5, min(1.5, math.log((n + 1) / (n_yes + 2)) - math.log((no.get(x, 0) + 1) / (n_no + 2)))), 3) for x, n in yes.items() if n + no.get(x, 0) >= 5}

    def edges(self, counts: Counter) -> None:
        """The tables of potentials, by pseudo-likelihood on the weak labels.

        counts has the nodes to be predicted, by their own potentials, label and
        neighbours' labels. Deviations from the prior tables are penalised, so
        tables of which the documents say little stay what they were.
        """
        if not counts:
            return
        nodes = sorted(counts, key=repr)
        own, sure, n = np.full((len(nodes), len(LABELS)), -1e9), np.zeros((len(nodes), len(LABELS))), np.array([counts[x] for x in nodes], float)
        near = {sort: np.zeros((len(nodes), len(LABELS))) for sort in SORTS}
        for i, (potentials, y, beside, on) in enumerate(nodes):
            own[i, 0], sure[i, y] = 0.0, float(on)
            for k, x in potentials:
                own[i, k] = x
            for sort, k, times in beside:
                near[SORTS[sort]][i, k] += times
        on = sure.sum(axis=1, keepdims=True) * n[:, None]
        # Each edge is met from both its ends.
        lengths = {sort: float((near[sort].sum(axis=1) * n).sum() / 2) for sort in SORTS}
        prior = {sort: np.array(t) for sort, t in self.tables.items()}
        tables = {sort: t.copy() for sort, t in prior.items()}
        for _ in range(40):
            field = own + sum(near[sort] @ tables[sort] for sort in SORTS)
            p = np.exp(field - field.max(axis=1, keepdims=True))
            rest = (sure - p / p.sum(axis=1, keepdims=True)) * on
            for sort in SORTS:
                if lengths[sort]:
                    step = rest.T @ near[sort]
                    tables[sort] += 0.5 * ((step + step.T) / (lengths[sort] + 20) - 0.05 * (tables[sort] - prior[sort]))
        self.tables = {sort: np.clip(t, prior[sort] - 2, prior[sort] + 2).round(3).tolist() for sort, t in tables.items()}
        self._measure()

    def tally(self, features: list[tuple[str, str, int]], begin: bool, counts: dict) -> None:
        """Adds the features of a first word to the counts for and against names, in parts by the belief in it."""
        if begin:
            b = 3.0 if self.introduced(sum([n for f, _, n in features if f == "seed"]), sum([n for f, _, n in features if f == "left"])) > 0 else -2.0
        else:
            b = self.about(features)[0]
        p = 1 / (1 + math.exp(-b))
        for f, v, n in features:
            if f == "seed":
                continue
            for g, x in (("ending", v[-4:]), ("ending", v[-3:]), ("ending", v[-2:]), ("second", v)) if f == "second" else ((f, v),):
                m = 1 if f == "second" else n
                for key in ((g, x), (g, None)):
                    c = counts.get(key)
                    if c is None:
                        c = counts[key] = [0.0, 0.0]
                    c[0] += p * m
                    c[1] += (1 - p) * m

    def weigh(self, counts: list[tuple[str, str | None, float, float]]) -> None:
        """Log odds of the features of names; the counts of None are those of all."""
        total = {f: (yes + 1, no + 1) for f, v, yes, no in counts if v is None}
        for f in ("ending", "left", "right", "second"):
            setattr(self, f, {})
        for f, v, yes, no in counts:
            if v is not None and yes + no >= _SUPPORT[f] - _ROUNDING:
                # A prior in proportion to the totals, so that few counts say little.
                part = total[f][0] / (total[f][0] + total[f][1])
                w = max(-3.0, min(3.0, math.log((yes + part) / total[f][0]) - math.log((no + 1 - part) / total[f][1])))
                # Surnames only count against.
                if f != "second" or w < 0:
                    getattr(self, f)[v] = w

    def introduced(self, seeds: int, uses: int) -> float:
        """What introductions say for a first word: nothing where a word so common would be introduced more often were it a name."""
        return max(0.0, min(3.0, 1.5 * seeds, 3.0 * seeds - self.rate * uses))

    def about(self, features: list[tuple[str, str, int]]) -> tuple[float, int, int, int]:
        """The belief in a first word, and its numbers of second words, of uses and of introductions."""
        seconds, ends, uses, beside, seeds = 0, 0.0, 0, 0.0, 0
        for f, v, n in features:
            if f == "second":
                seconds += 1
                ends += self._surname(v)
            elif f == "left":
                uses += n
                beside += n * self.left.get(v, 0.0)
            elif f == "right":
                beside += n * self.right.get(v, 0.0)
            else:
                seeds += n
        # A given name goes before many different surnames.
        about = ends / max(1, seconds) + beside / max(1, uses)
        return max(-6.0, min(6.0, -2.0 + 1.3 * min(4.0, math.log2(1 + seconds)) * about + self.introduced(seeds, uses))), seconds, uses, seeds

    def believe(self, rows: list[tuple[str, float, int, int, int]]) -> None:
        """Takes over the beliefs in first words. One use says no more than unseen() does."""
        self.belief = {a: round(b, 2) for a, b, _, uses, seeds in rows if uses > 1 or seeds}
        self.given = {a: round(b, 2) for a, b, seconds, _, seeds in rows if b > 1 and (seconds >= 2 or seeds)}

    def unseen(self, about: float) -> float:
        """The belief in a given name that the sample does not hold, from one use: what it says of the surname and the words beside."""
        return max(-6.0, min(6.0, -2.0 + 1.3 * about))

    def _surname(self, word: str) -> float:
        found = [self.ending[e] for e in (word[-4:], word[-3:], word[-2:]) if e in self.ending]
        return (sum(found) / len(found) if found else 0.0) + min(0.0, self.second.get(word, 0.0))

    def shapes(self, rows: list[tuple[str, str, int]]) -> None:
        """Log odds of the kinds that words before numbers name, by the shape of the numbers."""
        counts: dict[str, Counter[str]] = defaultdict(Counter)
        for shape, cue, n in rows:
            counts[shape][cue] += n
        for shape, c in counts.items():
            n = sum(c.values())
            self.shape[shape] = {k: math.log((c[k] + 0.2) / (n - c[k] + 0.2)) for k in ("phone", "id_number", "other")}

    def automaton(self) -> ahocorasick.Automaton:
        """Finds the given names, and the words for kinds of street, in lower-case text."""
        a = ahocorasick.Automaton()
        for name, belief in self.given.items():
            a.add_word(name, (len(name), belief))
        streets: dict[str, list] = defaultdict(list)
        for words, pattern in ((STREET_BEHIND, _BEHIND), (STREET_BEFORE, _BEFORE), (STREET_ENDS, _ENDS)):
            for word in words.split():
                streets[word].append(pattern)
        for word, patterns in streets.items():
            if word not in self.given:
                a.add_word(word, (len(word), patterns))
        a.make_automaton()
        return a


def _uncollected(work: Callable) -> Callable:
    """The task without searches for cycles of objects, as it makes none."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from work(batches)
        finally:
            gc.enable()

    return run


def _introduced(text: str, start: int) -> bool:
    """Whether an introduction or a title stands before a name."""
    last, least = start - 1, max(0, start - 24)
    if last < least or not text[last].isspace():
        return False
    while last > least and text[last].isspace():
        last -= 1
    ends = _ENDS_BY_LAST.get(text[last].lower())
    return ends is not None and text[least : last + 1].lower().endswith(ends) and _INTRO.search(text[least:start]) is not None


def _beside(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and behind a name; | where its line begins or ends."""
    m = _LEFT.match(text[max(0, start - 24) : start])
    before = m[1].lower() if m else "|"
    m = _RIGHT.match(text, end)
    return before, (m[1].lower() or "|") if m else "|"


def _uses(text: str) -> Iterator[tuple[str, str, str, str, int]]:
    """First words of pairs, with the second words, the words before and behind, and whether introduced."""
    for m in _CAPITAL.finditer(text):
        first, second = m[1], m[2]
        # Words in capitals throughout tell nothing about names.
        if len(second) < 3 or first.isupper() or not (first[0].isupper() and second[0].isupper()):
            continue
        start = m.start()
        yield first.lower(), second.lower(), *_beside(text, start, m.end(2)), int(_introduced(text, start))


def _count_shapes(text: str, shapes: Counter) -> None:
    """Adds the shapes of a text's numbers, with what they are said to be."""
    for start, _, shape in _numbers(text):
        if cue := _cue(text, start):
            shapes[shape, cue] += 1


def _count_forms(text: str, nodes: list[tuple], rejected: list[tuple[int, int]], lift: float, counts: Counter) -> None:
    """Adds the features of addresses and e-mail addresses, and of what stands against them."""
    for kind, features, against in (("address", _address_features, rejected), ("email", _email_features, [n[:2] for n in nodes if n[2] >= 3 and n[3][0] > -lift])):
        for one, spans in ((True, [n[:2] for n in nodes if _SETS[n[2]] == (kind,)]), (False, against)):
            for start, end in spans:
                counts[kind, one, None] += 1
                for x in features(text, start, end):
                    counts[kind, one, x] += 1


def _count_edges(text: str, nodes: list[Node], counts: Counter) -> None:
    """Adds the nodes of a text that have neighbours, as Weights.edges() takes them.

    A node is to be predicted if it has a weak label, and then without the
    evidence of that label, or if its own potentials leave little doubt.
    Potentials are counted to a tenth.
    """
    edges = _linked(nodes)
    if not edges:
        return
    beside: list[Counter] = [Counter() for _ in nodes]
    label, seen = [], []
    for n in nodes:
        bare, weak = _without_evidence(text, n)
        top = max(n.scores)
        label.append(weak if weak is not None else n.labels[1 + n.scores.index(top)] if top > 0 else 0)
        seen.append((tuple([(k, round(max(-12.0, min(12.0, x)), 1)) for k, x in zip(n.labels[1:], bare)]), weak is not None or abs(top) > 2.0))
    for i, j, sort in edges:
        beside[i][SORTS.index(sort), label[j]] += 1
        beside[j][SORTS.index(sort), label[i]] += 1
    for y, (potentials, on), c in zip(label, seen, beside):
        if c:
            # Of the others only their edges count.
            counts[potentials if on else (), y, tuple(sorted([(*k, n) for k, n in c.items()])), on] += 1


class Finder:
    """Finds the personal data of a text by the skip-chain field over its candidate stretches."""

    def __init__(self, weights: Weights, training: bool = False):
        self.w, self.automaton = weights, weights.automaton()
        #: An edge cannot lift a name of a lower score; training can still raise this.
        self.lift = weights.lift + 4.0 * training
        #: Scores of surnames met before.
        self.surnames: dict[str, float] = {}
        #: In training, the places where a street's pattern matched without a capital letter.
        self.rejected: list[tuple[int, int]] | None = [] if training else None

    def nodes(self, text: str) -> list[Node]:
        out: list[Node] = []
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join([c.lower() if len(c.lower()) == 1 else c for c in text])
        if "@" in text or ("dot" in lower or _EMAIL_LOOK.search(lower)) and _EMAIL_SIGNS.search(text):
            for m in _EMAIL.finditer(text):
                # Similar words: parts of the address, also without an initial before a surname.
                parts = [p for p in re.split(r"[^a-z]+", re.split(r"@|\s|[\[(]", m.group().lower())[0]) if len(p) > 3]
                out.append(Node(m.start(), m.end(), ("email",), [self._form("email", _email_features(text, m.start(), m.end()))], (*parts, *[p[1:] for p in parts if len(p) > 5])))
        for start, end, shape in _numbers(text):
            out.append(self._number(text, start, end, shape))
        streets: dict[tuple[int, int], Node] = {}
        for last, (size, found) in self.automaton.iter(lower):
            start = last - size + 1
            if type(found) is list:
                # It is a word, or an end before a number; a house number stands near.
                apart = not (start and lower[start - 1].isalnum() or last + 1 < len(lower) and lower[last + 1].isalnum())
                if (apart or _ENDS in found and lower[last + 1 : last + 2].isspace() and lower[last + 2 : last + 3].isdecimal()) and _HOUSE.search(lower, max(0, start - 40), last + 50):
                    self._address(text, start, last + 1, found, streets)
            else:
                self._name(text, lower, start, last + 1, found, out)
        given, learnt = self.w.given, sorted([(n.start, n.end) for n in out if n.kinds == ("name",) and n.scores[0] > 0], reverse=True)
        # Where the names that begin no later than here end, at most.
        reach = 0
        for m in _PAIR.finditer(text):
            key = m[1].lower()
            if key not in given:
                while learnt and learnt[-1][0] <= m.start():
                    reach = max(reach, learnt.pop()[1])
                if m.start() >= reach:
                    self._unlearnt(text, m, key, out)
        out.extend(streets.values())
        out.sort(key=lambda n: (n.start, -n.end))
        return out

    def candidates(self, text: str) -> tuple[list[tuple], list[tuple[int, int]]]:
        """In training: the text's nodes as plain tuples, and the matches of streets' patterns without a capital letter."""
        self.rejected = []
        return [(n.start, n.end, 4 if n.unlearnt else _SETS.index(n.kinds), n.scores, n.keys) for n in self.nodes(text)], self.rejected

    def scored(self, text: str, nodes: list[tuple], lift: float) -> list[Node]:
        """The nodes again, with the scores of trained forms, without names that no edge can lift."""
        out = []
        for start, end, kind, scores, keys in nodes:
            if kind == 0:
                scores = [self._form("email", _email_features(text, start, end))]
            elif kind == 1:
                scores = [self._form("address", _address_features(text, start, end))]
            elif kind == 4 and scores[0] <= -lift:
                continue
            out.append(Node(start, end, _SETS[kind], scores, keys))
        return out

    def _form(self, kind: str, features: list[str]) -> float:
        weights = self.w.form[kind]
        return _BASE[kind] + sum([weights.get(f, 0.0) for f in features])

    def _address(self, text: str, start: int, end: int, patterns: list[re.Pattern], out: dict[tuple[int, int], Node]) -> None:
        for pattern in patterns:
            for m in pattern.finditer(text, max(0, start - 50), min(len(text), end + 60)):
                if m.start(1) > start or end > m.end(1):
                    continue
                if not any(map(str.isupper, m[1])):
                    if self.rejected is not None:
                        self.rejected.append((m.start(1), m.end(1)))
                else:
                    if m.span(1) not in out:
                        street = "street " + re.sub(r"[\W\d]+", " ", m[1]).strip().lower()
                        out[m.span(1)] = Node(m.start(1), m.end(1), ("address",), [self._form("address", _address_features(text, m.start(1), m.end(1)))], (street,))

    def _number(self, text: str, start: int, end: int, shape: str) -> Node:
        cue, known = _cue(text, start), self.w.shape.get(shape, {})
        scores = []
        for kind in ("phone", "id_number"):
            score = -1.0 + 0.8 * known.get(kind, -0.5)
            score += 3.5 if cue == kind else -3.0 if cue is not None else 0.0
            scores.append(score)
        if shape[0] in "+(" or shape.startswith("00"):
            scores[0] += 2.0
        if "A" in shape:
            scores[0] -= 6.0
            scores[1] += 0.5 if cue == "id_number" else -1.0
        return Node(start, end, ("phone", "id_number"), scores, (re.sub(r"\W", "", text[start:end]),))

    def _name(self, text: str, lower: str, start: int, end: int, belief: float, out: list[Node]) -> None:
        if start and (lower[start - 1].isalnum() or lower[start - 1] in "’'_@-.") or end < len(lower) and (lower[end].isalnum() or lower[end] in "’'_@"):
            return
        small = not text[start].isupper()
        w = self.w
        m = _SURNAME.match(text, end)
        if m and (m[2][0].isupper() or small) and len(m[2]) > 1:
            surname = m[2]
            key = surname.lower()
            left, right = _beside(text, start, m.end())
            score = 0.6 * belief + w._surname(key) + w.left.get(left, 0.0) + w.right.get(right, 0.0) - 1.0
            if _introduced(text, start):
                score += 3.0
            if small:
                score -= 1.5
            if "." in m[1]:
                score += 2.0  # an initial
            if left == right == "|":
                score += 1.0  # a line of its own
            out.append(Node(start, m.end(), ("name",), [score], (key, lower[start:end])))
            if score > 0:
                return
        back = text[max(0, start - 60) : start]
        m = _BEFORE_COMMA.search(back) or _BEFORE_BLANK.search(back)
        if not m or not (m[1].split()[-1][0].isupper() or small):
            return
        key = m[1].split()[-1].lower()
        if key in w.given:
            return
        begin = start - len(back) + m.start(1)
        left, right = _beside(text, begin, end)
        score = 0.4 * belief + w._surname(key) + w.left.get(left, 0.0) + w.right.get(right, 0.0) - (1.5 if "," in m.group() else 3.0)
        if _introduced(text, begin):
            score += 3.0
        if "," in m.group() and left == right == "|":
            score += 2.0  # a line of its own
        out.append(Node(begin, end, ("name",), [score - 1.5 * small], (key, lower[start:end])))

    def _unlearnt(self, text: str, pair: re.Match, key: str, out: list[Node]) -> None:
        """A node for two capitalised words of which the first is not among the given names that were learnt, outside the names found by those."""
        start, w = pair.start(), self.w
        known = w.belief.get(key)
        introduced = _introduced(text, start)
        # Words that the sample holds as no names, words in capitals throughout, and given names one word on are none unless introduced.
        if not introduced and (known is not None and known <= 1 or pair[1].isupper() or pair[2].isupper() or pair[2].lower() in w.given):
            return
        surname, end = pair[2].lower(), pair.end(2)
        ending = self.surnames.get(surname)
        if ending is None:
            if len(self.surnames) > _SURNAMES:
                self.surnames.clear()
            ending = self.surnames[surname] = w._surname(surname)
        left, right = _beside(text, start, end)
        about = ending + w.left.get(left, 0.0) + w.right.get(right, 0.0)
        score = 0.6 * (w.unseen(about) if known is None else known) + about - 1.0
        if introduced:
            score += 3.0
        if "." in text[pair.end(1) : pair.start(2)]:
            score += 2.0  # an initial
        # An edge cannot lift what is lower.
        if score > -self.lift:
            out.append(Node(start, end, ("name",), [score], (surname, key), True))

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end and kind of each piece of personal data, in order and apart from each other."""
        if not text:
            return []
        return self.decided(text, self.nodes(text))

    def found(self, text: str | None, held: bytes | None) -> list[tuple[int, int, str]]:
        """What find() gives, from the candidates if they are held."""
        return self.find(text) if held is None else self.decided(text, self.scored(text, marshal.loads(held)[0], self.lift))

    def decided(self, text: str, nodes: list[Node]) -> list[tuple[int, int, str]]:
        """What find() gives, from the text's nodes."""
        if not nodes:
            return []
        labels = self._infer(nodes)
        picked = [(n.start, n.end, kind, score) for n, (kind, score) in zip(nodes, labels) if kind]
        picked.sort(key=lambda p: (-(p[2] in ("email", "address")), -(p[1] - p[0]), p[0]))
        out: list[tuple[int, int, str]] = []
        taken = bytearray(len(text)) if len(picked) > 1 else bytearray(0)
        for start, end, kind, _ in picked:
            if len(picked) > 1:
                if any(taken[start:end]):
                    continue
                taken[start:end] = b"\1" * (end - start)
            out.append((start, end, kind))
        return sorted(out)

    def _infer(self, nodes: list[Node]) -> list[tuple[str | None, float]]:
        """The label of each node and its margin over none."""
        w = self.w
        edges = _linked(nodes)
        reach = [0.0] * len(nodes)
        for i, j, sort in edges:
            reach[i] += w.swing[sort]
            reach[j] += w.swing[sort]
        own = [[0.0, *n.scores] for n in nodes]
        if all([_lead(u) > r for u, r in zip(own, reach)]):
            return [_best(n, u) for n, u in zip(nodes, own)]
        at: list[list[tuple[int, list[list[float]]]]] = [[] for _ in nodes]
        for i, j, sort in edges:
            at[i].append((j, w.tables[sort]))
            at[j].append((i, w.tables[sort]))
        fixed = self._eliminate(nodes, own, at)
        self._propagate(nodes, own, at, fixed)
        return [_best(n, u) for n, u in zip(nodes, own)]

    @staticmethod
    def _eliminate(nodes: list[Node], own: list[list[float]], at: list) -> list[int]:
        """The place of the label of every node that keeps it whatever its open neighbours are; -1 for open nodes.

        The potentials of an edge to a node that is settled go into the other's own.
        """
        fixed, todo = [-1] * len(nodes), list(range(len(nodes)))
        while todo:
            i = todo.pop()
            if fixed[i] >= 0:
                continue
            u, labels = own[i], nodes[i].labels
            a = 0 if _any(u) <= 0 else max(range(1, len(u)), key=u.__getitem__)
            kinds_lead = -_any(u) if a == 0 else 0.0
            settled = True
            for b in range(len(u)):
                if b != a:
                    lead = kinds_lead if a == 0 else u[a] - u[b]
                    for j, table in at[i]:
                        if fixed[j] < 0:
                            x, y = table[labels[a]], table[labels[b]]
                            lead += min([x[k] - y[k] for k in nodes[j].labels])
                    if lead <= 0:
                        settled = False
                        break
            if settled:
                fixed[i] = a
                for j, table in at[i]:
                    if fixed[j] < 0:
                        row = table[labels[a]]
                        base = row[0]
                        own[j] = [x + row[k] - base for x, k in zip(own[j], nodes[j].labels)]
                        todo.append(j)
        return fixed

    @staticmethod
    def _propagate(nodes: list[Node], own: list[list[float]], at: list, fixed: list[int]) -> None:
        """Loopy belief propagation among the open nodes, whose own potentials become their beliefs."""
        wires = [(i, j, table) for i in range(len(nodes)) if fixed[i] < 0 for j, table in at[i] if fixed[j] < 0]
        if not wires:
            return
        # A wire carries messages from its second node to its first; its partner goes the other way.
        back: dict[tuple[int, int, int], int] = {(i, j, id(t)): n for n, (i, j, t) in enumerate(wires)}
        partner = [back[j, i, id(t)] for i, j, t in wires]
        message = [[0.0] * len(nodes[i].labels) for i, _, _ in wires]
        total = {i: list(own[i]) for i in range(len(nodes)) if fixed[i] < 0}
        for _ in range(30):
            change = 0.0
            for n, (i, j, table) in enumerate(wires):
                cavity = [x - m for x, m in zip(total[j], message[partner[n]])]
                fresh = [_sum([x + table[a][b] for x, b in zip(cavity, nodes[j].labels)]) for a in nodes[i].labels]
                fresh = [0.5 * (m + x - fresh[0]) for m, x in zip(message[n], fresh)]
                moved = [x - m for x, m in zip(fresh, message[n])]
                change = max(change, max(map(abs, moved)))
                message[n] = fresh
                total[i] = [x + d for x, d in zip(total[i], moved)]
            if change < 1e-2:
                break
        for i, u in total.items():
            own[i] = [x - u[0] for x in u]


def _sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum([math.exp(x - top) for x in logs]))


def _any(u: list[float]) -> float:
    """Log odds of any kind against none."""
    return (u[1] if len(u) == 2 else _sum(u[1:])) - u[0]


def _lead(u: list[float]) -> float:
    """By how much the best label leads, all kinds together against none."""
    if len(u) == 2:
        return abs(u[1] - u[0])
    top = max(u[1:])
    return -_any(u) if _any(u) <= 0 else min(top - u[0], *[top - x for x in u[1:] if x is not top])


def _best(node: Node, u: list[float]) -> tuple[str | None, float]:
    belief = _any(u)
    return (node.kinds[max(range(len(u) - 1), key=lambda k: u[1 + k])] if belief > 0 else None), belief


def _counted(df: DataFrame, columns: list[str], begin: Callable, schema: str, flat: Callable = tuple) -> DataFrame:
    """The counts of a table, by task: begin() gives a function that adds a row of the columns to a Counter, flat makes its keys columns."""
    names, kinds = zip(*[part.split() for part in schema.split(", ")])
    types = [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[k] for k in kinds]

    @_uncollected
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, counts = begin(), Counter()
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                step(row, counts)
            if len(counts) > _HELD:
                yield _arrow(counts, flat, types, names)
                counts.clear()
        if counts:
            yield _arrow(counts, flat, types, names)

    return df.select(*columns).mapInArrow(work, schema)


def _arrow(counts: Counter, flat: Callable, types: list, names: tuple[str, ...]) -> pa.RecordBatch:
    rows = [(*flat(k), *(v if isinstance(v, list) else [v])) for k, v in counts.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _words(df: DataFrame, text: str) -> DataFrame:
    """A row a first word: hashes of its second words and of their endings, of the words before and behind with counts; how often used and introduced.

    The features of some words together are listed, with their hashes and texts,
    in the first of these. Rows of null have the shapes of numbers, what they
    are said to be and how often.
    """

    @_uncollected
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, kinds = Counter(), (*[pa.string()] * 4, pa.int64())
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                if t:
                    rows.extend(_uses(t))
                    _count_shapes(t, shapes)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _USE)
        if shapes:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[(None, *k, None, n) for k, n in shapes.items()]), kinds)], _USE)

    used = df.select(text).mapInArrow(read, "a string, second string, left string, right string, seed bigint").repartition("a").withColumn("h", F.xxhash64("a")).sortWithinPartitions("h")
    hashes = {f"{f}_h": F.xxhash64(F.lit(f), f) for f in ("second", "left", "right")} | {f"e{k}": F.xxhash64(F.lit("ending"), F.substring("second", -k, k)) for k in (4, 3, 2)}
    kind = "a string, second_h array<bigint>, second_e4 array<bigint>, second_e3 array<bigint>, second_e2 array<bigint>, left_h array<bigint>, left_n array<bigint>, right_h array<bigint>, right_n array<bigint>, uses bigint, seeds bigint, f array<string>, h array<bigint>, v array<string>"
    return used.withColumns(hashes).mapInArrow(_gathered, kind)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _words() from uses in the order of the hashes of their first words."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last, h = held[-1].column("h")[-1].as_py() if held else None, _column(batch, "h")
        # Whole words only; those of the last hash may go on.
        if last is not None and h[-1] != last and sum(b.num_rows for b in held) > _HELD:
            cut = int(np.searchsorted(h, last, "right"))
            yield _gather([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield _gather(held)


def _listed(rows: int, of: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    """Columns of lists from the rows of the entries, in order, and their values."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, v if isinstance(v, pa.Array) else pa.array(v)) for v in values]


def _gather(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    # Numbers' shapes, then the words.
    null = table.column("a").is_null()
    numbers, table = table.filter(null).combine_chunks(), table.filter(pa.compute.invert(null)).combine_chunks()
    get = {c: table.column(c).to_numpy() for c in ("h", "seed", "second_h", "left_h", "right_h", "e4", "e3", "e2")}
    _, at, of = np.unique(get["h"], return_index=True, return_inverse=True)
    rows = len(at)
    # Each second word of a first word once, the words beside with their counts.
    columns: list = []
    words: list[tuple[str, np.ndarray, np.ndarray, int | None]] = []
    for f in ("second", "left", "right"):
        h = get[f"{f}_h"]
        order = np.lexsort((h, of))
        new = np.flatnonzero(np.r_[True, (of[order][1:] != of[order][:-1]) | (h[order][1:] != h[order][:-1])][: len(order)])
        first = order[new]
        columns += _listed(rows, of[first], h[first], *([get[e][first] for e in ("e4", "e3", "e2")] if f == "second" else [np.diff(np.r_[new, len(order)]).astype(np.int64)]))
        for g, hashes, cut in ((f, h, None),) if f != "second" else ((f, h, None), ("ending", get["e4"], 4), ("ending", get["e3"], 3), ("ending", get["e2"], 2)):
            keys, places = np.unique(hashes, return_index=True)
            texts = table.column(f).take(pa.array(places)).combine_chunks()
            words.append((g, keys, texts if cut is None else pa.compute.utf8_slice_codeunits(texts, -cut), len(keys)))
    sorts = pa.array(np.repeat([w[0] for w in words], [w[3] for w in words]).tolist(), pa.string())
    begin = np.zeros(len(sorts), np.int64)
    whole = [table.column("a").take(pa.array(at)), *columns, pa.array(np.bincount(of, minlength=rows).astype(np.int64)), pa.array(np.bincount(of, get["seed"], rows).astype(np.int64))]
    whole += _listed(rows, begin, sorts, np.concatenate([w[1] for w in words]), pa.concat_arrays([w[2].combine_chunks() if isinstance(w[2], pa.ChunkedArray) else w[2] for w in words])) if rows else [pa.array([], pa.list_(t)) for t in (pa.string(), pa.int64(), pa.string())]
    out = pa.Table.from_arrays(whole, _WORD_COLUMNS)
    if len(numbers):
        none = [pa.nulls(1, t.type) for t in out.columns[:-3]]
        out = pa.concat_tables([out, pa.Table.from_arrays([*none, *_listed(1, np.zeros(len(numbers), np.int64), *[numbers.column(c).combine_chunks() for c in ("second", "seed", "left")])], _WORD_COLUMNS)])
    return out.combine_chunks().to_batches()[0]


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _parents(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """For each entry of a column of lists its row."""
    return np.repeat(np.arange(batch.num_rows), batch.column(name).value_lengths().to_numpy(zero_copy_only=False))


class _Hashed:
    """The weights of Weights by hashes of the features; about() for many first words at once."""

    def __init__(self, weights: Weights, weigh: dict[str, dict[int, float]]):
        self.rate, self.begin = weights.rate, not weigh
        self.of = {}
        for f in _SUPPORT:
            keys = np.array(sorted(weigh.get(f, {})), np.int64)
            self.of[f] = keys, np.array([weigh[f][k] for k in keys.tolist()], float)

    def _look(self, f: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of features, 0 if they have none, and whether they have one."""
        keys, values = self.of[f]
        if not len(keys):
            return np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        there = keys[at] == hashes
        return np.where(there, values[at], 0.0), there

    def about(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The beliefs in the first words of a batch, and their numbers of second words."""
        rows, uses, seeds = batch.num_rows, _column(batch, "uses"), _column(batch, "seeds")
        ends, seconds = np.zeros(rows), batch.column("second_h").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        introduced = np.maximum(0.0, np.minimum(np.minimum(3.0, 1.5 * seeds), 3.0 * seeds - self.rate * uses))
        if self.begin:
            return np.where(introduced > 0, 3.0, -2.0), seconds
        total, number = 0.0, 0
        for k in (4, 3, 2):
            w, there = self._look("ending", _flat(batch, f"second_e{k}"))
            total, number = total + w, number + there
        surname = total / np.maximum(number, 1) + np.minimum(0.0, self._look("second", _flat(batch, "second_h"))[0])
        ends = np.bincount(_parents(batch, "second_h"), surname, rows)
        beside = sum(np.bincount(_parents(batch, f"{f}_h"), self._look(f, _flat(batch, f"{f}_h"))[0] * _flat(batch, f"{f}_n"), rows) for f in ("left", "right"))
        about = ends / np.maximum(1, seconds) + beside / np.maximum(1, uses)
        return np.clip(-2.0 + 1.3 * np.minimum(4.0, np.log2(1.0 + seconds)) * about + introduced, -6.0, 6.0), seconds

    def tally(self, batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """As Weights.tally(): sorts of features, their hashes and what is to be added for and against."""
        p = 1 / (1 + np.exp(-self.about(batch)[0]))
        of = _parents(batch, "second_h")
        yield "ending", np.concatenate([_flat(batch, f"second_e{k}") for k in (4, 3, 2)]), np.tile(p[of], 3), np.tile(1 - p[of], 3)
        yield "second", _flat(batch, "second_h"), p[of], 1 - p[of]
        for f in ("left", "right"):
            of, n = _parents(batch, f"{f}_h"), _flat(batch, f"{f}_n")
            yield f, _flat(batch, f"{f}_h"), p[of] * n, (1 - p[of]) * n


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _tallied(words: DataFrame, hashed: _Hashed, live: np.ndarray | None) -> DataFrame:
    """Counts for and against of the features, by sort and hash; hash null has those of all of a sort. live: the hashes of all that can have a weight."""
    sent = words.sparkSession.sparkContext.broadcast((hashed, live))

    def summed(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for f, parts in held.items():
            h, y, n = (np.concatenate(x) for x in zip(*parts))
            total, there, live = (y.sum(), n.sum()), slice(None), sent.value[1]
            if live is not None:
                there = live[np.minimum(np.searchsorted(live, h), len(live) - 1)] == h if len(live) else np.zeros(len(h), bool)
            keys, at = np.unique(h[there], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([f] * (len(keys) + 1)), pa.array([None, *keys.tolist()], pa.int64()), *[pa.array(np.concatenate([[t], np.bincount(at, x[there], len(keys))])) for t, x in zip(total, (y, n))]], ["f", "h", "y", "n"])

    @_uncollected
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        for batch in batches:
            for f, h, y, n in sent.value[0].tally(batch):
                if len(h):
                    held[f].append((h, y, n))
                    size += len(h)
            if size > 10 * _HELD:
                yield from summed(held)
                held, size = defaultdict(list), 0
        yield from summed(held)

    columns = [c for f in _SUPPORT if f != "ending" for c in (f"{f}_h", *([f"{f}_n"] if f != "second" else [f"second_e{k}" for k in (4, 3, 2)]))]
    return words.select("uses", "seeds", *columns).mapInArrow(work, "f string, h bigint, y double, n double").groupBy("f", "h").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))


def _names(words: DataFrame, weights: Weights) -> None:
    """Expectation maximisation over all first words: what each adds to the counts is summed by feature."""
    spark, weigh, live = words.sparkSession, {}, None
    for _ in range(_STEPS):
        counts = _tallied(words, _Hashed(weights, weigh), live)
        if live is None:
            support = F.create_map(*[F.lit(x) for kv in _SUPPORT.items() for x in kv])[F.col("f")]
            counts = counts.where(F.col("h").isNull() | (F.col("y") + F.col("n") >= support - _ROUNDING))
        got = counts.toArrow().combine_chunks()
        f, h, y, n = (got.column(c).to_numpy() for c in ("f", "h", "y", "n"))
        every = got.column("h").is_null().to_numpy()
        if live is None:
            # The counts for and against are together the same in each round.
            live = np.sort(got.column("h").drop_null().to_numpy()).astype(np.int64)
        kept, second = np.ones(len(f), bool), (f == "second") & ~every
        if second.any():
            yes, no = y[every & (f == "second")].sum() + 1, n[every & (f == "second")].sum() + 1
            kept = ~second | ((y + 0.5) / yes <= (n + 0.5) / no)
        weights.weigh([tuple(r.values()) for r in got.filter(pa.array(kept)).to_pylist()])
        weigh = {f: getattr(weights, f) for f in _SUPPORT}
    sent = spark.sparkContext.broadcast(_Hashed(weights, weigh))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, h, v = (batch.column(c).flatten() for c in ("f", "h", "v"))
            there = np.zeros(len(h), bool)
            for g in _SUPPORT:
                there |= (f.to_numpy(zero_copy_only=False) == g) & sent.value._look(g, h.to_numpy(zero_copy_only=False))[1]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(there)) for c in (f, h, v)], ["f", "h", "v"])

    def believed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, seconds = sent.value.about(batch)
            uses, seeds = _column(batch, "uses"), _column(batch, "seeds")
            some = np.flatnonzero((uses > 1) | (seeds > 0))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(some)), *[pa.array(x[some]) for x in (b, seconds, uses, seeds)]], ["a", "b", "s", "u", "i"])

    named = [tuple(r) for r in words.where("size(h) > 0").select("f", "h", "v").mapInArrow(texts, "f string, h bigint, v string").distinct().collect()]
    rows = [tuple(r) for r in words.drop("f", "h", "v").mapInArrow(believed, "a string, b double, s bigint, u bigint, i bigint").collect()]
    for f in _SUPPORT:
        setattr(weights, f, {v: weigh[f][h] for g, h, v in named if g == f})
    weights.believe(rows)


def train(df: DataFrame, key: str, text: str) -> tuple[Weights, DataFrame]:
    """Weights from all documents, and the documents with the candidates found in them, in the column _n.

    Every count is over the whole table. The candidates are kept, so that texts
    are searched for them once; blank texts have none.
    """
    spark = df.sparkSession
    weights = Weights()

    words = written(_words(df, text), "words")
    shapes: Counter = Counter()
    for r in words.where("a IS NULL").select("f", "v", "h").collect():
        for shape, cue, n in zip(*r):
            shapes[shape, cue] += n
    weights.shapes([(*k, n) for k, n in shapes.items()])
    words = words.where("a IS NOT NULL")
    seeds, uses_of_all = words.agg(F.sum("seeds"), F.sum("uses")).first()
    weights.rate = (seeds or 0) / max(1, uses_of_all or 0)
    _names(words, weights)
    named = spark.sparkContext.broadcast(weights)

    @_uncollected
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(named.value, training=True)
        for batch in batches:
            held = [marshal.dumps(finder.candidates(t)) if t else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.binary())], [key, text, "_n"])

    kind = df.schema[key].dataType.simpleString()
    found = written(df.select(key, text).mapInArrow(search, f"`{key}` {kind}, `{text}` string, _n binary"), "candidates")

    def forms() -> Callable:
        return lambda row, counts: _count_forms(row[0], *marshal.loads(row[1]), named.value.lift, counts) if row[1] else None

    parts = _counted(found, [text, "_n"], forms, "k string, one string, x string, n bigint", lambda k: (k[0], str(k[1]), k[2]))
    whole = parts.groupBy("k", "one", "x").agg(F.sum("n").alias("n"))
    common = whole.groupBy("k", "x").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("one") == "True", F.col("n")).otherwise(0)).alias("yes")).where("x IS NULL OR n >= 5")
    weights.forms(Counter({(r.k, one, r.x): n for r in common.collect() for one, n in ((True, r.yes), (False, r.n - r.yes)) if n}))
    formed = spark.sparkContext.broadcast(weights)

    def edges() -> Callable:
        finder = Finder(formed.value)
        return lambda row, counts: _count_edges(row[0], finder.scored(row[0], marshal.loads(row[1])[0], finder.lift), counts) if row[1] else None

    parts = _counted(found, [text, "_n"], edges, "k string, n bigint", lambda k: (repr(k),))
    weights.edges(Counter({ast.literal_eval(r.k): r.n for r in parts.groupBy("k").agg(F.sum("n").alias("n")).collect()}))
    return weights, found


def _held(batch: pa.RecordBatch) -> Iterator[tuple[str | None, bytes | None]]:
    """Texts and, if there is a third column, their candidates."""
    texts = batch.column(1).to_pylist()
    return zip(texts, batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts))


def personal_data(df: DataFrame, key: str, text: str, weights: Weights) -> DataFrame:
    """Columns key, start, end (code points), kind and val of every piece of personal data.

    Null, empty and blank texts have none; rows that repeat stay repeated;
    whole texts are read. Candidates of train() are taken from the column _n.
    """
    sent, kept = df.sparkSession.sparkContext.broadcast(weights), "_n" in df.columns

    @_uncollected
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, (t, nodes) in enumerate(_held(batch)):
                for start, end, kind in finder.found(t, nodes):
                    for column, x in zip(rows, (i, start, end, kind, t[start:end])):
                        column.append(x)
            keys = batch.column(0).take(pa.array(rows[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())], [key, "start", "end", "kind", "val"])

    return df.select(key, text, *["_n"] * kept).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, start int, end int, kind string, val string")


def redacted(df: DataFrame, key: str, text: str, weights: Weights) -> DataFrame:
    """Columns key and text with each piece of personal data replaced by its placeholder; null texts stay null."""
    sent, kept = df.sparkSession.sparkContext.broadcast(weights), "_n" in df.columns

    @_uncollected
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            out = []
            for t, nodes in _held(batch):
                for start, end, kind in reversed(finder.found(t, nodes)):
                    t = t[:start] + PLACEHOLDER[kind] + t[end:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, text])

    return df.select(key, text, *["_n"] * kept).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, `{text}` string")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    weights, documents = train(table(spark, folder, "documents"), "doc_id", "text")
    return personal_data(documents, "doc_id", "text", weights).select("doc_id", "kind", "val").distinct()


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    weights, documents = train(table(spark, folder, "documents"), "doc_id", "text")
    return redacted(documents, "doc_id", "text", weights)
