"""All registered queries of the package, with their SQL."""

from __future__ import annotations

from larkspur.llm import oracle
from larkspur.llm.bpe import p6_ids
from larkspur.llm.history import p4_found
from larkspur.llm.langid import p1_articles, p1_found, p1_segments
from larkspur.llm.near_duplicates import p2_classes, p2_found
from larkspur.llm.packing import p7_fill, p7_packed
from larkspur.llm.personal import p8_found, p8_redacted
from larkspur.llm.survivorship import p5_found, p5_survivors

QUERIES = {"p1_found": p1_found, "p1_segments": p1_segments, "p1_articles": p1_articles, "p2_found": p2_found, "p2_classes": p2_classes, "p4_found": p4_found, "p5_found": p5_found, "p5_survivors": p5_survivors, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE = dict(oracle.ORACLE)
