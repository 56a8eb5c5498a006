"""What the tests here share."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
#: Rows that every operator must take: nulls, empty and very long texts, white space, ties, repeats, clashing names.
ODD = [(1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (None, "some words here", "s"), (5, "Ünï çode　wörds ok", "t"), (6, "a b", "t"), (6, "a b", "t"), (7, "long " * 60_000, "s"), (8, "x\n\ny\n", None)]


def thue_morse(n: int, a: str, b: str) -> str:
    """Texts of this kind and their complements share a hash under any polynomial modulo 2**64."""
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


SCHEMA = "doc_id long, text string, source string"
