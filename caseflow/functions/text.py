"""Text functions as column expressions; only the similarity ratio needs Python (Arrow batches)."""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: White space of any script, and the separators U+001C to U+001F.
_WHITE = r"[\p{IsWhite_Space}\x1C-\x1F]"


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{_WHITE}+|{_WHITE}+\z", "")


def blank(text: Column) -> Column:
    """Whether a text is null or white space alone."""
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def folded(text: Column) -> Column:
    """Without case, as far as upper and then lower case tell it: one form for ß and ss, a capital and its small letter."""
    # the step between keeps the optimizer from taking lower(upper(x)) for lower(x)
    return F.lower(F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS")))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{_WHITE}+", " "))


def label(text: Column, suffixes: list[str]) -> Column:
    """struct(label, part): lower case, one of the trailing words `suffixes` cut off as the part, else part is body."""
    x = F.lower(collapse(text))
    pattern = rf"^(.*) ({'|'.join(map(re.escape, suffixes))})$"
    return F.struct(F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1)).otherwise(x).alias("label"), F.coalesce(F.nullif(F.regexp_extract(x, pattern, 2), F.lit("")), F.lit("body")).alias("part"))


def statement(text: Column) -> Column:
    """Lower case, ASCII letters and digits only, single spaces: the form in which restatements are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def mentions(text: Column, labels: list[str]) -> Column:
    """Labels that a text mentions as words, the longest first so that no part of a longer label counts; sorted, distinct."""
    pattern = "|".join(re.escape(x) for x in sorted(labels, key=lambda x: (-len(x), x)))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({pattern})\b"), F.lit(1))))


def number(text: Column) -> Column:
    """The first number of a text ("about 4.5 seconds"), else null."""
    return F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def boolean(text: Column) -> Column:
    """true for yes/true/y/1, false for no/false/n/0 (any case, white space around), else null."""
    x = F.lower(strip(text))
    return F.when(x.isin("yes", "true", "y", "1"), True).when(x.isin("no", "false", "n", "0"), False)


def html_escape(text: Column) -> Column:
    """& < > double and single quote as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_path(path: Column) -> Column:
    """A relative path: not empty, no leading slash, no "..", "" or "." part, no backslash, no colon."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return (F.length(path) > 0) & ~bad & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit(":"))


def clock(ms: Column) -> Column:
    """MM:SS.mmm of whole milliseconds."""
    p = lambda v, n: F.lpad(v.cast("string"), n, "0")
    minutes = F.floor(ms / 60_000)
    return F.concat(F.when(minutes < 100, p(minutes, 2)).otherwise(minutes.cast("string")), F.lit(":"), p(F.floor(ms / 1000) % 60, 2), F.lit("."), p(ms % 1000, 3))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def similarity_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """similarity() where it is `least` or more, else null.

    A bound is looked at first: a ratio r leaves d = (1 - r) * (len(x) + len(y)) characters unmatched, each of which
    parts at most 4 of the longer text's substrings of 4; the others stand in both texts.
    """
    held: dict[str, Counter] = {}

    def grams(x: str) -> Counter:
        if x not in held:
            held[x] = Counter(x[i : i + 4] for i in range(len(x) - 3))
        return held[x]

    def ratio(x: str, y: str, cut: float) -> float | None:
        if x == y:
            return 1.0
        need = max(len(x), len(y)) - 3 - 4 * (1 - cut) * (len(x) + len(y)) - 1e-6
        if need > 0:
            other = grams(y)
            if sum(min(n, other[g]) for g, n in grams(x).items() if g in other) < need:
                return None
        r = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
        return r if r >= cut else None

    return pd.Series([ratio(x or "", y or "", cut) for x, y, cut in zip(a, b, least, strict=True)], dtype="float64")


#: Findings of a text scan, by category; fixed patterns without look-around, so that any regex engine agrees.
HYGIENE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "key_header": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "home_path": r"(/home/|/Users/)[A-Za-z0-9._-]+",
    "license_line": r"(?i)licensed under the",
}


def findings(text: Column) -> Column:
    """Sorted categories of HYGIENE that a text has."""
    return F.array_sort(F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in HYGIENE.items()]), lambda x: x.isNotNull()))
