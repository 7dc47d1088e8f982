"""Identifiers in a line of text: patterns, checks, and what a neighbouring line makes certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import digits, is_blank, let, trimmed

# Patterns that must match the same strings as the system this engine stands in for.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[\s\-.]?)?(?:\(\d{2,5}\)[\s\-.]?)?\d{3,5}[\s\-.]?\d{3,5}(?:[\s\-.]?\d{2,4})?(?!\d)"
AADHAAR = r"(?<!\d)[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}(?!\d)"
PAN = r"(?<![A-Z0-9])[A-Z]{5}\d{4}[A-Z](?![A-Z0-9])"
PASSPORT = r"(?<![A-Z0-9])[A-PR-WY][0-9]{7}(?![A-Z0-9])"
CARD = r"(?<!\d)(?:\d[ \-]?){12,18}\d(?!\d)"
MASKS = "*xX•×#"
MASKED_CARD = r"(?<![A-Za-z0-9])[0-9*xX•×#]{2,6}(?:[\s\-][0-9*xX•×#]{2,6}){1,5}(?![A-Za-z0-9])"
ACCOUNT = r"(?i)\b(?:a/?c|acct|account|ifsc|iban)\b[\s:.#\-]*(?:(?:no|num|number)\b[\s:.#\-]*)?([A-Z0-9]{6,24})"
IFSC = r"(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])"
UPI = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._\-]{1,}@[A-Za-z]{2,}(?![A-Za-z0-9.\-])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.])"
DATE = r"(?<![\d/\-.])(?:[0-3]?\d[/\-.][0-1]?\d[/\-.](?:\d{2}|\d{4})|(?:\d{4})[/\-.][0-1]?\d[/\-.][0-3]?\d)(?![\d/\-.])"
URL = r"(?i)\b(?:https?://|www\.)[^\s,;]{4,}"
PIN = r"(?<!\d)[1-9]\d{5}(?!\d)"
MONEY = r"(?i)(?:₹|rs\.?|inr|usd|\$|€|£)\s?\d[\d,]*(?:\.\d{1,2})?"
CURRENCY = r"(?i)(₹|rs\.?|inr|usd|\$|€|£)"
#: Labels of a date of birth and of an amount that is someone's own. Words end where no letter or mark follows, in any script.
BIRTH_LABEL = r"(?i)(?<![\p{L}\p{M}\p{N}_])(d\.?o\.?b|date\s+of\s+birth|birth\s*date|born|जन्म)(?![\p{L}\p{M}\p{N}_])"
AMOUNT_LABEL = (
    r"(?i)\b(?:(?:closing|opening|available|current|account|avl)\s+bal(?:ance)?|bal(?:ance)?\s*[:.]|net\s+(?:pay|salary)|gross\s+(?:pay|salary)"
    r"|take[\s\-]?home|salary|wages|income|ctc|credit\s+limit)\b"
)
#: In order of detection, with what tags show.
KINDS = {
    "EMAIL": "email", "UPI": "upi-id", "IFSC": "ifsc", "URL": "url", "IP": "ip", "PAN": "pan", "PASSPORT": "passport", "AADHAAR": "aadhaar", "DATE": "date",
    "MONEY": "amount", "ACCOUNT": "account-no", "CARD": "card", "PHONE": "phone", "PIN": "postcode",
}
HINTS = "array<struct<kind:string,matched:string,strong:boolean>>"


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _as_hints(found: Column, kind: str, strong) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("matched"), (strong(m) if callable(strong) else F.lit(strong)).alias("strong")))


def mask_count(m: Column) -> Column:
    return F.length(F.regexp_replace(m, f"[^{MASKS}]", ""))


#: Kinds that a kind's detection looks at besides its own pattern.
_EARLY = ("EMAIL", "UPI", "IFSC", "URL", "IP", "PAN", "PASSPORT", "AADHAAR", "DATE", "MONEY", "ACCOUNT", "CARD")
_NEEDS = {"UPI": ("EMAIL",), "PHONE": _EARLY, "PIN": (*_EARLY, "PHONE")}
_PATTERNS = {"EMAIL": EMAIL, "UPI": UPI, "IFSC": IFSC, "URL": URL, "IP": IP, "PAN": PAN, "PASSPORT": PASSPORT, "AADHAAR": AADHAAR, "DATE": DATE, "MONEY": MONEY,
             "ACCOUNT": ACCOUNT, "CARD": CARD, "MASKED": MASKED_CARD, "PHONE": PHONE, "PIN": PIN}

_SPACE = r"[\t\n\f\r \-.]?"
#: The wording of SQL engines that can't look around: a card number is a whole word of ASCII, and what stands beside a phone number is used
#: up with it, so a number right behind another one lacks its first mark. No other kinds have such a wording.
PLAIN = {
    "EMAIL": EMAIL, "IP": IP, "CARD": r"(?<![A-Za-z0-9_])(?:[0-9][ \-]?){12,18}[0-9](?![A-Za-z0-9_])",
    "PHONE": rf"(?:\A|[^0-9])((?:\+?[0-9]{{1,3}}{_SPACE})?(?:\([0-9]{{2,5}}\){_SPACE})?[0-9]{{3,5}}{_SPACE}[0-9]{{3,5}}(?:{_SPACE}[0-9]{{2,4}})?)(?:\z|[^0-9])",
}


def hints_of(text: Column, kinds: tuple[str, ...] = tuple(KINDS), wording: dict[str, str] = _PATTERNS) -> Column:
    """The identifiers of a line in order of detection, the first of each kind and match; null and blank lines have none.

    Later kinds look at earlier ones: a UPI handle inside an e-mail address, a phone number that shares its digits with an earlier
    match and a PIN inside one are dropped. Only the kinds asked for, and those that they look at, are searched. Every step is bound
    as a lambda variable, so a pattern is in the plan once and runs once a line; it runs at all only where the line holds what any
    match has (a digit, an @, a link's start). Kinds without a pattern in ``wording`` are not searched.
    """
    search = {k for kind in kinds for k in (kind, *_NEEDS.get(kind, ())) if k in wording}
    patterns = {k: p for k, p in wording.items() if k in search or (k == "MASKED" and "CARD" in search)}
    none = F.array().cast("array<string>")

    def candidates(line: Column) -> Column:
        t, low = line["t"], F.lower(line["t"])
        has = {"EMAIL": line["at"], "UPI": line["at"], "URL": F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))}
        return F.struct(*[F.when(has.get(k, line["digit"]), find_all(t, p, int(k == "ACCOUNT" or (k == "PHONE" and wording is PLAIN)))).otherwise(none).alias(k) for k, p in patterns.items()])

    def cards(found: Column) -> Column:
        return F.transform(F.filter(found["CARD"], lambda m: F.length(digits(m)).between(13, 19)), trimmed)

    def early(found: Column, card: Column) -> Column:
        masked = lambda m: (F.length(digits(m)) >= 4) & (mask_count(m) >= 2) & ~F.exists(card, lambda c: F.contains(c, m))
        own = {
            "UPI": lambda: F.filter(found["UPI"], lambda m: ~F.exists(found["EMAIL"], lambda e: F.contains(e, m))),
            "ACCOUNT": lambda: F.filter(found["ACCOUNT"], lambda m: m.rlike(r"\d")), "CARD": lambda: card,
        }
        strong = {"DATE": False, "MONEY": False, "CARD": lambda m: F.call_function("luhn_check", digits(m))}
        parts = [_as_hints(own[k]() if k in own else found[k], k, strong.get(k, True)) for k in _EARLY if k in search]
        if "MASKED" in patterns:
            parts.append(_as_hints(F.filter(F.transform(found["MASKED"], trimmed), masked), "CARD", True))
        return F.concat(*parts) if parts else F.array().cast(HINTS)

    def with_phones(found: Column, hints: Column) -> Column:
        if "PHONE" not in search:
            return hints
        claimed = F.filter(F.transform(hints, lambda h: digits(h.matched)), lambda d: F.length(d) > 0)

        def free(claimed: Column) -> Column:
            taken = lambda d: F.exists(claimed, lambda c: F.contains(c, d) | F.contains(d, c))
            return F.filter(found["PHONE"], lambda m: let(digits(m), lambda d: F.length(d).between(7, 13) & ~taken(d)))

        return F.concat(hints, _as_hints(F.transform(let(claimed, free), trimmed), "PHONE", True))

    def with_pins(found: Column, hints: Column) -> Column:
        if "PIN" not in search:
            return hints
        return F.concat(hints, _as_hints(F.filter(found["PIN"], lambda m: ~F.exists(hints, lambda h: F.contains(h.matched, m))), "PIN", False))

    def first_ones(hints: Column) -> Column:
        new = F.filter(hints, lambda h, i: ~F.exists(F.slice(hints, F.lit(1), i), lambda g: (g.kind == h.kind) & (g.matched == h.matched)))
        every = F.when(F.size(hints) > 1, new).otherwise(hints)
        return every if set(kinds) >= search else F.filter(every, lambda h: h.kind.isin(*kinds))

    def among(found: Column) -> Column:
        return let(cards(found) if "CARD" in search else none, lambda card: let(early(found, card), lambda e: let(with_phones(found, e), lambda p: let(with_pins(found, p), first_ones))))

    line = F.when(~is_blank(text), text).otherwise(F.lit(""))
    parts = lambda t: F.struct(t.alias("t"), F.contains(t, F.lit("@")).alias("at"), t.rlike(r"\d").alias("digit"))
    return let(line, lambda t: let(parts(t), lambda x: let(candidates(x), among)))


def with_hints(spans: DataFrame, text: str = "text", out: str = "hints", kinds: tuple[str, ...] = tuple(KINDS), wording: dict[str, str] = _PATTERNS) -> DataFrame:
    """Adds :func:`hints_of` as one expression; no other column is added or lost."""
    return spans.withColumn(out, hints_of(F.col(text), kinds, wording))


def promoted(hints: Column, previous: Column, line: Column) -> Column:
    """Dates are certain beside a label of birth, amounts beside a label of balance or pay, in the line or the one before."""
    context = F.concat_ws("\n", previous, line)
    birth, amount = context.rlike(BIRTH_LABEL), context.rlike(AMOUNT_LABEL)
    sure = lambda h: h.strong | ((h.kind == "DATE") & birth) | ((h.kind == "MONEY") & amount)
    return F.transform(hints, lambda h: F.struct(h.kind.alias("kind"), h.matched.alias("matched"), sure(h).alias("strong")))


def has_strong(hints: Column) -> Column:
    return F.exists(hints, lambda h: h.strong)


#: Kinds that settle a line by themselves: in the first pass, and at the gate.
CERTAIN = ["EMAIL", "UPI", "PAN", "AADHAAR", "PASSPORT", "ACCOUNT", "IFSC", "CARD", "PHONE", "DATE", "MONEY"]
GATE_KINDS = ["PAN", "AADHAAR", "PASSPORT", "ACCOUNT", "IFSC", "CARD", "UPI", "EMAIL", "PHONE"]


def confident_phone(text: Column, hints: Column, matched: Column) -> Column:
    money = F.exists(hints, lambda h: h.kind == "MONEY")
    plain = ~money & ~F.contains(matched, F.lit(",")) & ~text.rlike(CURRENCY)
    return plain & (F.contains(matched, F.lit("+")) | F.length(digits(matched)).between(10, 13))


def certain_identifier(text: Column, hints: Column) -> Column:
    """Kind of the first certain strong hint; a phone number has to look like one."""
    ok = lambda h: h.strong & h.kind.isin(CERTAIN) & ((h.kind != "PHONE") | confident_phone(text, hints, h.matched))
    return F.try_element_at(F.filter(hints, ok), F.lit(1))["kind"]


def gate_identifier(hints: Column) -> Column:
    """The first strong hint of the gate's kinds, phones as they are."""
    return F.try_element_at(F.filter(hints, lambda h: h.strong & h.kind.isin(GATE_KINDS)), F.lit(1))


def kind_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[kind]


def hint_rows(spans: DataFrame, *keys: str) -> DataFrame:
    """Long form: (keys, seq, kind, matched, strong), seq from 1 in order of detection.

    The outer explode and a test of its output keep the optimiser from deriving a filter on ``hints`` itself, which it would push
    down as a second copy of the whole detection.
    """
    return spans.select(*keys, F.posexplode_outer("hints").alias("_p", "_h")).where("_h IS NOT NULL").select(
        *keys, (F.col("_p") + 1).alias("seq"), F.col("_h.kind").alias("kind"), F.col("_h.matched").alias("matched"), F.col("_h.strong").alias("strong"))
