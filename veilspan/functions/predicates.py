"""What a line is: a caption, an inline field, a header, a public body, a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .entities import has_strong
from .text import any_of, fuzzy_phrase, let, letters, listed, matches_any, squeezed, strip_both, strip_end, trimmed, word_count

_TAIL = r":\-–"
_INLINE = r"^([\p{L}\p{M}][\p{L}\p{M} ./'\-]{0,28}?)[\s]*[:：][\s]*(.+)$"


def caption(c: Column) -> Column:
    """Without the colon or dash that ends a caption."""
    return trimmed(strip_end(trimmed(c), _TAIL))


def is_caption(c: Column, captions: list[str] = V.CAPTIONS) -> Column:
    """At most 34 characters, no @, a letter; a known caption, or up to four words without a digit before a colon."""

    def test(t: Column, own: Column) -> Column:
        shape = (F.length(t) > 0) & (F.length(t) <= 34) & ~F.contains(t, F.lit("@")) & own.rlike(r"\p{L}")
        colon = F.endswith(t, F.lit(":")) & ~own.rlike(r"\d") & (word_count(own) <= 4)
        return shape & (F.array_contains(listed(captions), F.lower(own)) | colon)

    return F.coalesce(let(trimmed(c), lambda t: let(caption(t), lambda own: test(t, own))), F.lit(False))


def inline_field(c: Column) -> Column:
    """Struct (label, value) of a line ``label: value``, or null."""
    t = trimmed(c)
    label, value = trimmed(F.regexp_extract(t, _INLINE, 1)), trimmed(F.regexp_extract(t, _INLINE, 2))
    ok = (F.length(label) > 0) & (F.length(value) > 0) & (word_count(label) <= 4) & ~label.rlike(r"\d")
    return F.when(ok, F.struct(label.alias("label"), value.alias("value")))


def is_sensitive_label(c: Column) -> Column:
    return matches_any(c, V.SENSITIVE_STEMS)


def is_address_label(c: Column) -> Column:
    return matches_any(c, V.ADDRESS_STEMS)


def _words(patterns: list[str]) -> str:
    """Whole words in any script."""
    return r"(?i)(?<![\p{L}\p{M}\p{N}_])(" + "|".join(patterns) + r")(?![\p{L}\p{M}\p{N}_])"


def is_private_caption(c: Column) -> Column:
    test = lambda own: (F.length(own) > 0) & ~any_of(V.PUBLIC_CAPTIONS, lambda s: F.contains(own, s)) & own.rlike(_words(V.PRIVATE_WORDS))
    return F.coalesce(let(F.lower(caption(c)), test), F.lit(False))


def is_name_like(c: Column) -> Column:
    t = trimmed(c)
    return F.coalesce(F.length(t).between(3, 40) & ~t.rlike(r"\d") & ~F.contains(t, F.lit(":")) & (word_count(t) <= 4) & (letters(t) >= F.floor(F.length(t) / 2)), F.lit(False))


def is_header(text: Column, role: Column, top: Column, height: Column, hints: Column) -> Column:
    t = trimmed(text)
    return ((role != "VALUE") & (height > 0) & (top <= height * F.lit(0.25)) & (F.length(t) <= 60) & (word_count(t) <= 8) & ~has_strong(hints) & t.rlike(_words(V.HEADER_WORDS)))


def is_public_entity(c: Column) -> Column:
    def test(t: Column) -> Column:
        words = F.transform(F.split(t, r"\s+"), lambda w: strip_both(w, r".,()&\-"))
        named = ~t.rlike(r"\d") & (F.size(words) <= 8) & F.arrays_overlap(words, listed(V.INSTITUTION_WORDS))
        return F.length(t).between(4, 60) & t.rlike(r"\p{L}") & (any_of(V.ISSUER_PHRASES, lambda p: fuzzy_phrase(t, p)) | named)

    return F.coalesce(let(F.lower(strip_end(trimmed(c), r".,:\-")), test), F.lit(False))


def neighbour_caption(own: Column, neighbour: Column) -> Column:
    """What a neighbouring line captions this one with: its label if its value is this line, itself if it is a caption."""
    field = inline_field(neighbour)
    return F.when(field.isNotNull(), F.when(squeezed(field["value"]) == squeezed(own), field["label"])).when(is_caption(neighbour, V.GATE_CAPTIONS), trimmed(neighbour))


def sensitive_neighbour(own: Column, previous: Column, following: Column) -> Column:
    """The private caption before or else after the line, if the line has no colon or digit and is no caption itself."""
    plain = ~F.contains(own, F.lit(":")) & ~own.rlike(r"\d") & ~is_caption(own, V.GATE_CAPTIONS)
    fits = lambda c: F.when(matches_any(c, V.NEIGHBOUR_STEMS), c)
    return F.when(plain, F.coalesce(fits(neighbour_caption(own, previous)), fits(neighbour_caption(own, following))))


