"""Operator 5: personal data, with built-in functions only.

Regular expressions propose spans, validators (Luhn, mod-97, number ranges) confirm them, and words near a span
raise its score.  The base kinds need their validators only; the added kinds (short cards, IBANs, national ids,
secrets such as access tokens) need a score of at least ``LEAST`` as well.

The patterns are written with possessive quantifiers and start where a run of their signs starts, which finds the
same leftmost matches in time linear in the text.  A match's place is the length of what splitting leaves
before it.

Defined results: null or empty text has no spans.  Rows are searched one by one, so repeated rows, ties, null
doc_ids and other columns pass through unchanged, but for columns named as a kind, which are replaced.  Places are in
code points.  A long text is searched whole; with n spans of a kind it takes n ** 1.5 steps of copying.  An empty table
stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, documents, unused

LEAST = 0.5
#: Code points looked at before and after a span for context words.
BEFORE, AFTER = 48, 24
#: Different signs that a secret has at least.
VARIED = 8
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn checksum."""
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")
    parts = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether ``value`` (an IBAN) leaves 1 modulo 97, its first four signs moved to the end and letters as numbers."""
    plain = F.regexp_replace(value, " ", "")
    signs = F.filter(F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    rest = F.aggregate(signs, F.lit(0), lambda a, c: (F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int"))
    return rest == 1


def varied(value: Column) -> Column:
    """Whether ``value`` looks drawn at random: letters and digits, at least ``VARIED`` different signs."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= VARIED)


def _count(value: Column, low: int, high: int) -> Column:
    return F.length(_digits(value)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """``hint`` is a sign or a simple pattern that every match contains, for which most texts are passed over; ``words`` raise the score by ``bonus``."""

    name: str
    pattern: str
    valid: object
    score: float
    words: str
    hint: str
    base: bool = True
    bonus: float = 0.3


_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){%d,%d}+(?![\x20-]?[0-9])"
_LONG_NUMBER = r"[0-9](?:[\x20-]?[0-9]){12}"
_PAYMENT = "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta"
KINDS = [
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", lambda v: F.lit(True), 0.9, "mail|contact|write|reach", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, r"\bip\b|server|host|address|login", r"[0-9]\.[0-9]"),
    Kind("card", _CARD % (15, 18), luhn, 0.7, _PAYMENT, _LONG_NUMBER),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: _count(v, 8, 15), 0.6, "phone|call|tel|mobile|fax|whatsapp", "+"),
    Kind("short_card", _CARD % (12, 14), luhn, 0.3, _PAYMENT, _LONG_NUMBER, False),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8, "iban|account|konto|compte|cuenta|bank", "[A-Z]{2}[0-9]{2}", False),
    Kind("national_id", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda v: F.lit(True), 0.3, r"\bssn\b|social security|tax id|national id|identity", "[0-9]-[0-9]", False),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,128}+(?![A-Za-z0-9_-])", varied, 0.3, r"token|secret|passw|credential|\bauth|api.?key|access.?key|private.?key", "", False),
]


def _rated(k: Kind, placed: Column) -> Column:
    """The spans that ``k`` confirms, with their scores."""

    def score(s: Column) -> Column:
        near = F.lower(s["near"]).rlike(k.words)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.when(near, k.score + k.bonus).otherwise(k.score).alias("score"))

    rated = F.transform(F.filter(placed, lambda s: k.valid(s["value"])), score)
    return rated if k.base else F.filter(rated, lambda s: s["score"] >= LEAST)


def _names(k: Kind) -> Column:
    return F.transform(F.col(k.name), lambda s: F.concat_ws(":", F.lit(k.name), s["start"].cast("string"), s["end"].cast("string")))


_SPAN = "struct<start: int, end: int, value: string, near: string>"


def _placed(found: Column) -> Column:
    """(start, end, value, near) of each hit from (gap, near, value): running sums in two levels.

    A fold copies what it has at each step, so it runs over about sqrt(n) blocks and then over each block's sqrt(n) hits.
    """

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is computed once."""
        return F.transform(F.array(value), use)[0]

    def width(hits: Column) -> Column:
        return F.aggregate(hits, F.lit(0), lambda a, h: a + h["gap"] + F.length(h["value"]))

    def starts(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(blocks, first, lambda a, b: F.struct((a["at"] + width(b)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    def step(a: Column, h: Column) -> Column:
        first = a["at"] + h["gap"]
        last = first + F.length(h["value"])
        span = F.struct(first.alias("start"), last.alias("end"), h["value"].alias("value"), h["near"].alias("near"))
        return F.struct(last.alias("at"), F.concat(a["all"], F.array(span)).alias("all"))

    def walk(hits: Column, at: Column) -> Column:
        return F.aggregate(hits, F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("all")), step, lambda a: a["all"])

    def cut(hits: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(hits))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(hits) / size).cast("int") - 1), lambda k: F.slice(hits, k * size + 1, size))

    return bound(found, lambda hits: F.flatten(bound(cut(hits), lambda blocks: F.zip_with(blocks, starts(blocks), walk))))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a column for each kind: an array of (start, end, value, score), ascending."""
    own = unused(docs.columns)
    body_name = own + "text"
    there, parts, found = {}, {}, {}
    for k in KINDS:
        gaps, hits, seen = (F.col(f"{own}{k.name}_{part}") for part in ("gaps", "hits", "there"))
        proposed = F.col(body_name).rlike(k.pattern)
        hinted = F.contains(F.col(body_name), F.lit(k.hint)) if len(k.hint) == 1 else F.col(body_name).rlike(k.hint)
        there[f"{own}{k.name}_there"] = hinted & proposed if k.hint else proposed
        parts[f"{own}{k.name}_gaps"] = F.when(seen, F.split(body_name, k.pattern, -1))
        parts[f"{own}{k.name}_hits"] = F.when(seen, F.regexp_extract_all(F.col(body_name), F.lit(k.pattern), F.lit(0)))
        before = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(BEFORE)).alias("near"), h.alias("value")))
        around = F.zip_with(before, F.slice(gaps, F.lit(2), F.size(hits)), lambda f, g: F.struct(f["gap"].alias("gap"), F.concat_ws("\n", f["near"], F.left(g, F.lit(AFTER))).alias("near"), f["value"].alias("value")))
        kind = "array<struct<start: int, end: int, value: string, score: double>>"
        found[k.name] = F.coalesce(_rated(k, _placed(around)).cast(kind), F.array().cast(kind))
    out = docs.withColumn(body_name, body(text)).withColumns(there).withColumns(parts).withColumns(found)
    names = {k.name for k in KINDS}
    return out.select(*[c for c in docs.columns if c not in names], *(k.name for k in KINDS))


def listed(kinds: list[Kind]) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.concat(*map(_names, kinds)), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = [k for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
        sum((F.size(k.name).cast("long") for k in KINDS), F.lit(0).cast("long")).alias("n_spans"),
    )
