"""Variants of words for the planning of queries, in plain Python: a query's few words are expanded before any plan is made."""

from __future__ import annotations

# The least length of a term, the ending it loses, what it gets instead, and the weight; the first of the first three that fits counts.
PLURALS = [(4, "ies", "y", 0.9), (3, "es", "", 0.85), (3, "s", "", 0.82)]
INFLECTIONS = [(5, "ing", "", 0.8), (4, "ed", "", 0.78), (4, "er", "", 0.75)]
# Weights of the plural of a word in y, of another plural, and of a hyphen as a blank and as nothing.
IES, PLURAL, APART, JOINED = 0.88, 0.8, 0.72, 0.65


def term_variants(term: str) -> dict[str, float]:
    """Variants of a term with their weights, the term itself with 1."""
    term = term.strip().lower()
    out = {term: 1.0} if term else {}
    fits = [next((r for r in PLURALS if len(term) >= r[0] and term.endswith(r[1])), None), *[r for r in INFLECTIONS if len(term) >= r[0] and term.endswith(r[1])]]
    found = [(term[: -len(ending)] + instead, weight) for _, ending, instead, weight in filter(None, fits)]
    if len(term) >= 3 and not term.endswith("s"):
        found += [(term[:-1] + "ies", IES)] if term.endswith("y") else []
        found.append((term + "s", PLURAL))
    if "-" in term:
        found += [(term.replace("-", " "), APART), (term.replace("-", ""), JOINED)]
    for variant, weight in found:
        if variant.strip():
            out[variant.strip()] = max(out.get(variant.strip(), 0.0), weight)
    return out


def verb_forms(base: str) -> list[str]:
    """The base with its third person, past and participle, in that order."""
    base = base.strip().lower()
    if not base:
        return []
    if base.endswith("e"):
        third, past, doing = base + "s", base + "d", base[:-1] + "ing"
    elif base.endswith("y") and len(base) > 1 and base[-2] not in "aeiou":
        third, past, doing = base[:-1] + "ies", base[:-1] + "ied", base + "ing"
    elif base.endswith(("s", "x", "z", "ch", "sh", "o")):
        third, past, doing = base + "es", base + "ed", base + "ing"
    else:
        third, past, doing = base + "s", base + "ed", base + "ing"
    return list(dict.fromkeys([base, third, past, doing]))


def base_form(verb: str) -> str:
    """The base of an inflected verb: ies and ied to y, then ing, ed, es and s, with a doubled last consonant undone."""
    verb = verb.strip().lower()
    if len(verb) > 4 and verb.endswith(("ies", "ied")):
        return verb[:-3] + "y"
    for ending, least in (("ing", 5), ("ed", 4), ("es", 4), ("s", 3)):
        if len(verb) >= least and verb.endswith(ending) and not (ending == "s" and verb.endswith("ss")):
            stem = verb[: -len(ending)]
            if ending in ("ing", "ed") and len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "aeiouls":
                stem = stem[:-1]
            return stem
    return verb
