"""Tokens and matches for text search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(text: str) -> list[str]:
    return [t.replace("_", "") for t in re.findall(r"\w+", text.lower()) if t.replace("_", "")]


def matches(own: Column, token: str, strategy: str = "text", fuzzy: int = 0) -> Column:
    """Whether one of a row's tokens matches: equal, as a prefix, or within ``fuzzy`` edits."""
    whole = F.exists(own, lambda t: F.levenshtein(t, F.lit(token), fuzzy) >= 0) if fuzzy else F.array_contains(own, token)
    if strategy == "text":
        return whole
    prefix = F.exists(own, lambda t: F.startswith(t, F.lit(token)))
    return prefix if strategy == "autocomplete" else whole | prefix


def frequency(own: Column, token: str, fuzzy: int = 0) -> Column:
    """How many of a row's tokens are the token, or within ``fuzzy`` edits of it."""
    return F.size(F.filter(own, lambda t: (F.levenshtein(t, F.lit(token), fuzzy) >= 0) if fuzzy else t == token))


def any_contains(columns: list[Column], text: str) -> Column:
    """The fallback without an index: the text occurs in one of the columns, in any case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns])
