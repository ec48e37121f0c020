"""Likeness of strings that no built-in expression measures, as Arrow-batched functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "AEIOU"


def shared_length(a: str, b: str) -> int:
    """Characters in the longest common substring and, on both its sides, in those of what is left."""
    stack, total = [(0, len(a), 0, len(b))], 0
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        best, at, bt, row = 0, 0, 0, {}
        for i in range(alo, ahi):
            new = {}
            for j in range(blo, bhi):
                if a[i] == b[j]:
                    k = new[j] = row.get(j - 1, 0) + 1
                    if k > best:
                        best, at, bt = k, i - k + 1, j - k + 1
            row = new
        if best:
            total += best
            stack.append((alo, at, blo, bt))
            stack.append((at + best, ahi, bt + best, bhi))
    return total


def similar_percent(a: str | None, b: str | None) -> float:
    """200 x shared length / both lengths; 0 for two empty strings, null counts as empty."""
    a, b = a or "", b or ""
    return 200.0 * shared_length(a, b) / (len(a) + len(b)) if a or b else 0.0


def sound_key(word: str | None) -> str:
    """A phonetic key of an English word in the manner of the published metaphone rules; '' for null."""
    w = re.sub("[^A-Z]", "", (word or "").upper())
    w = re.sub(r"([^C])\1+", r"\1", w)
    for old, new in (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R")):
        if w.startswith(old):
            w = new + w[2:]
    if w.startswith("X"):
        w = "S" + w[1:]
    if w.startswith("WH"):
        w = "W" + w[2:]
    out, i, n = [], 0, len(w)
    while i < n:
        c, nxt, prev = w[i], w[i + 1 : i + 2], w[i - 1 : i] if i else ""
        step = 1
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and prev == "M"):
                out.append("B")
        elif c == "C":
            if w[i : i + 3] == "CIA" or nxt == "H":
                out.append("X")
                step = 2 if nxt == "H" else 1
            elif nxt and nxt in "IEY":
                if prev != "S":
                    out.append("S")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if nxt == "G" and w[i + 2 : i + 3] in ("E", "I", "Y") and w[i + 2 : i + 3] else "T")
        elif c == "G":
            if nxt == "H" and i + 2 < n and w[i + 2] not in _VOWELS:
                step = 2
            elif nxt == "N" and i + 2 >= n:
                pass
            elif nxt and nxt in "IEY" and prev != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if nxt and nxt in _VOWELS and prev not in ("C", "S", "P", "T", "G"):
                out.append("H")
        elif c == "K":
            if prev != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if nxt == "H" else "P")
            step = 2 if nxt == "H" else 1
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if nxt == "H" or w[i : i + 3] in ("SIO", "SIA"):
                out.append("X")
                step = 2 if nxt == "H" else 1
            else:
                out.append("S")
        elif c == "T":
            if nxt == "H":
                out.append("0")
                step = 2
            elif w[i : i + 3] in ("TIA", "TIO"):
                out.append("X")
            elif w[i : i + 3] != "TCH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if nxt and nxt in _VOWELS:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += step
    return "".join(out)


@F.pandas_udf(T.DoubleType())
def similar_text(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar_percent(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def metaphone(word: pd.Series) -> pd.Series:
    return pd.Series([sound_key(w) for w in word])
