from __future__ import annotations

from larkspur.functions.variants import base_form, term_variants, verb_forms


def test_variants() -> None:
    assert term_variants("party") == {"party": 1.0, "parties": 0.88, "partys": 0.8} and term_variants("bank") == {"bank": 1.0, "banks": 0.8} and term_variants("banks") == {"banks": 1.0, "bank": 0.82}
    assert term_variants("parties") == {"parties": 1.0, "party": 0.9} and term_variants("boxes") == {"boxes": 1.0, "box": 0.85} and term_variants("trading") == {"trading": 1.0, "trad": 0.8, "tradings": 0.8}
    assert term_variants("e-mail") == {"e-mail": 1.0, "e-mails": 0.8, "e mail": 0.72, "email": 0.65} and term_variants("") == {}


def test_verbs() -> None:
    assert verb_forms("approve") == ["approve", "approves", "approved", "approving"] and verb_forms("carry")[1:3] == ["carries", "carried"] and verb_forms("pass")[1] == "passes" and verb_forms("") == []
    assert [base_form(v) for v in ("parties", "planned", "running", "makes", "pass")] == ["party", "plan", "run", "mak", "pass"]
