"""Tokens and cleaned queries, as Column expressions.

The token class, the ASCII-only lower casing and the two excluded ranges are fixed values of the data model:
U+2000-206F and U+3000-307F part tokens, every other character above U+007F belongs to one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
TOKEN_CLASS = r"[0-9a-z\x{80}-\x{1FFF}\x{2070}-\x{2FFF}\x{3080}-\x{10FFFF}]"
TOKEN = TOKEN_CLASS + "+"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; É stays É. Null gives null."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Maximal runs of token characters in order; empty text gives an empty array, null gives null."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: Column) -> Column:
    """Distinct tokens in byte order; null gives null."""
    return F.array_sort(F.array_distinct(tokens(query)))


def query_key(query: Column) -> Column:
    """The canonical form that permutations and repetitions of a query share."""
    return F.array_join(query_terms(query), " ")


#: The same token for Python, which works on code points as the Column form does.
PY_TOKEN = re.compile(TOKEN.replace("\\x{80}", "\x80").replace("\\x{1FFF}", "\u1fff").replace("\\x{2070}", "\u2070").replace("\\x{2FFF}", "\u2fff").replace("\\x{3080}", "\u3080").replace("\\x{10FFFF}", "\U0010ffff"))
PY_LOWER = str.maketrans(UPPER, LOWER)


def clean_terms(query: str | None) -> list[str]:
    """``query_terms`` of one query, on the driver: what a cache is asked for without a job."""
    return sorted(set(PY_TOKEN.findall((query or "").translate(PY_LOWER))), key=str.encode)
