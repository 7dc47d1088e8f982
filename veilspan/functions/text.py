"""String columns: trimming, clipping, fuzzy matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a clipped line, the ellipsis included.
CLIP = 64


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end (SQL's trim takes spaces only)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def is_blank(c: Column) -> Column:
    return F.length(trimmed(c)) == 0


def strip_end(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+$", "")


def strip_both(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def squeezed(c: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def word_count(c: Column) -> Column:
    """Parts between runs of white space; an empty text has one."""
    return F.size(F.split(c, r"\s+"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def letters(c: Column) -> Column:
    """How many letters there are."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def clip(c: Column) -> Column:
    flat = trimmed(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= CLIP, flat).otherwise(F.concat(F.substring(flat, 1, CLIP - 1), F.lit("…")))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 3).cast("int") + 16


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row: inside a lambda it is a variable, not an expression to repeat."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def listed(values: list[str]) -> Column:
    """The values as one constant array: a plan with one literal instead of one for each word."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def any_of(values: list[str], test) -> Column:
    """Whether ``test`` holds for one of some values; they travel in the plan, so nothing is joined or shuffled."""
    return F.exists(listed(values), test)


def _third(a: Column) -> Column:
    return F.floor(a / 3).cast("int")


def fuzzy_equals(a: Column, b: Column) -> Column:
    """Lengths differ by 3 at most, and the distance is within a third of the shorter or the first four letters within 1."""
    la, lb = F.length(a), F.length(b)
    near = F.levenshtein(a, b) <= F.greatest(F.lit(1), _third(F.least(la, lb)))
    start = (la >= 4) & (lb >= 4) & (F.levenshtein(F.substring(a, 1, 4), F.substring(b, 1, 4)) <= 1)
    return (F.abs(la - lb) <= 3) & (near | start)


def fuzzy_phrase(line: Column, phrase: Column) -> Column:
    """Equal, or lengths within a third plus 2 and the distance within a fifth (2 at least)."""
    n = F.length(phrase)
    close = F.abs(F.length(line) - n) <= F.floor(n / 3) + 2
    return (line == phrase) | (close & (F.levenshtein(line, phrase) <= F.greatest(F.lit(2), F.floor(n / 5).cast("int"))))


def matches_any(label: Column, stems: list[str]) -> Column:
    """A label is a stem, starts or ends with one, holds one at a word's start, or is nearly one."""

    whole = "|".join(re.escape(s) for s in sorted(stems, key=len))
    found = f"^(?:{whole})|(?:{whole})$| (?:{whole})"

    def among(at: Column) -> Column:
        return (F.length(at) > 0) & (at.rlike(found) | any_of(stems, lambda s: fuzzy_equals(at, s)))

    return F.coalesce(let(strip_both(F.lower(trimmed(label)), ".,\\-"), among), F.lit(False))
