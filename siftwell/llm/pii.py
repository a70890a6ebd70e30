"""PII (10): patterns propose spans, checksums confirm them, nearby context words move their scores.

All in DataFrame expressions: ``split`` and ``regexp_extract_all`` by one pattern give the texts between matches and the
matches, so their lengths add up to positions. Each pattern runs only on texts that pass a cheap test for it. Patterns are
written without nested backtracking (possessive repeats; a match may begin only where no earlier one could), which finds the
same matches and stays linear on long runs.

The base kinds (email, ip, card, phone) always stay. The method adds ``iban`` (mod-97) and ``ssn`` (which needs context),
where the score reaches ``least_score``. Of what may follow the head of an ``iban``, as much is taken as its country's numbers have, or
up to the last blank at which mod-97 passes where the country is not known; every head is tried that no earlier number covers.
Positions are code points, ends exclusive; spans of different kinds may overlap, those of equal start are in order of kind.
``redacted`` replaces the union of spans.

Null texts count as empty and stay null; long texts are scanned whole, in time that grows with length and matches; repeated
rows give equal results; an empty table gives no rows. ``find`` replaces a column that is named as its own (``pii_col``
names it otherwise); the others pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # a text without it has no match
    prior: float
    context: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]+\\.", 0.9, ("mail", "contact", "write", "kontakt", "correo")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]", 0.6, ("ip", "host", "server", "address", "login", "adresse")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "(?:[0-9][\\x20-]?){13}[0-9]", 0.8, ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 0.7, ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))", "[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]", 0.7, ("iban", "account", "bank", "konto", "cuenta", "compte"), False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, ("ssn", "social", "security"), False),
)
#: Characters of an account number by country (ISO 13616 registry), blanks aside.
IBAN_LENGTHS = {
    country: int(n)
    for n, *countries in map(
        str.split,
        (
            "15 NO", "16 BE", "18 DK FI FK FO GL NL SD", "19 MK SI", "20 AT BA EE KZ LT LU MN XK", "21 CH HR LI LV", "22 BG BH CR DE GB GE IE ME RS VA", "23 AE GI IL IQ OM SO TL",
            "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST", "26 IS TR", "27 BI DJ FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HN HU LB NI PL SV", "29 BR EG PS QA UA", "30 JO KW MU YE", "31 MT SC", "32 LC", "33 RU",
        ),
    )
    for country in countries
}
#: Code points before a span that are searched for context words, what one adds, and the least score of an added span.
NEAR, LIFT, LEAST_SCORE = 40, 0.25, 0.5


def luhn(digits: Column) -> Column:
    """Whether a text of decimal digits passes Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (blanks allowed) passes ISO 7064 mod 97-10."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    letters = F.split(turned, "")
    value = lambda c: F.when(c == "", None).when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(letters, F.lit(0), lambda s, c: F.when(value(c).isNull(), s).otherwise((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97))
    return (rest == 1) & F.length(plain).between(15, 34)


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(p.try_cast("decimal(38,0)"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)  # account numbers have passed mod-97


def iban_size(head: Column, tail: Column) -> Column:
    """Code points of the account number that begins with ``head`` and ends at a blank or the end of ``tail``; null if there is none."""
    parts = F.split(F.concat(head, tail), " ")
    # the country's length, else any
    known = F.element_at(F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair)), F.left(head, F.lit(2)))
    begun = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    fits = F.filter(begun, lambda x: F.coalesce(F.length(F.replace(x, F.lit(" "), F.lit(""))) == known, F.lit(True)) & mod97(x))
    return F.array_max(F.transform(fits, lambda x: F.length(x)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 256) -> Column:
    """array<string>: for each item what ``step(state, item)`` gives beside the next state (no comma in it), and one more text.

    The state is carried through in order. Results are collected as text, in blocks, since Spark copies a collected
    array in full at every step.
    """

    def over(all_items: Column) -> Column:
        def inside(s: Column, i: Column) -> Column:
            after, found = step(s["state"], F.get(all_items, i))
            return F.struct(after.alias("state"), F.concat(s["out"], found, F.lit(",")).alias("out"))

        def one(s: Column, b: Column) -> Column:
            places = F.sequence(b * block, F.least((b + 1) * block, F.size(all_items)) - 1)
            return F.aggregate(places, F.struct(s["state"].alias("state"), F.lit("").alias("out")), inside, lambda e: F.struct(e["state"].alias("state"), F.concat(s["out"], e["out"]).alias("out")))

        blocks = F.when(F.size(all_items) > 0, F.sequence(F.lit(0), ((F.size(all_items) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.split(F.aggregate(blocks, F.struct(state.alias("state"), F.lit("").alias("out")), one, lambda e: e["out"]), ",", -1)

    return bound(items, over)


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _text(*numbers: Column) -> Column:
    return F.concat_ws(":", *(n.cast("string") for n in numbers))


def _number(text: Column, k: int) -> Column:
    return F.get(F.split(text, ":"), F.lit(k)).cast("int")


def _ibans(kind: Kind, text: Column) -> Column:
    """array<struct<start, end, match, before>> of account numbers; ``kind.pattern`` matches heads and looks ahead at what may follow."""
    heads, tails = (F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(k)) for k in (0, 1))
    zipped = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), heads.alias("head"), tails.alias("tail"))
    sized = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["head"].alias("head"), iban_size(x["head"], x["tail"]).alias("size"), x["tail"].alias("tail")))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        start = s["at"] + F.length(x["gap"])
        taken = x["head"].isNotNull() & x["size"].isNotNull() & (start >= s["end"])
        after = F.struct((start + F.coalesce(F.length(x["head"]), F.lit(0))).alias("at"), F.when(taken, start + x["size"]).otherwise(s["end"]).alias("end"))
        return after, F.when(taken, _text(start, s["end"])).otherwise("")

    def placed(pairs: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            x, start = F.get(pairs, i), _number(t, 0)
            # the gap before, and heads that were none with theirs, back to where the last number ended
            parts = [F.coalesce(F.get(pairs, i - k)[c], F.lit("")) for k in (2, 1) for c in ("gap", "head")]
            before = F.right(F.concat(*parts, x["gap"]), F.least(F.lit(NEAR), start - _number(t, 1)))
            return F.when(t != "", F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.left(F.concat(x["head"], x["tail"]), x["size"]).alias("match"), F.lower(before).alias("before")))

        return _present(F.transform(scanned(pairs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("end")), step), one))

    return bound(sized, placed)


def _matches(kind: Kind, text: Column) -> Column:
    """array<struct<start, end, match, before>> of all matches."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        return start + F.coalesce(F.length(x["match"]), F.lit(0)), start.cast("string")

    def one(x: Column, t: Column) -> Column:
        start = t.cast("int")
        return F.when(x["match"].isNotNull(), F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"), F.lower(F.right(x["gap"], F.lit(NEAR))).alias("before")))

    zipped = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"))
    return bound(zipped, lambda pairs: _present(F.zip_with(pairs, scanned(pairs, F.lit(0), step), one)))


def _spans(k: int, kind: Kind, text: Column) -> Column:
    """array<struct<start, kind, end, score>> of one kind."""
    placed = _ibans(kind, text) if kind.name == "iban" else _matches(kind, text)
    near = lambda x: x["before"].rlike("(?<![a-z])(?:" + "|".join(kind.context) + ")")
    score = lambda x: F.lit(kind.prior) + F.when(near(x), F.least(F.lit(LIFT), F.lit(1 - kind.prior))).otherwise(0.0)
    keep = lambda x: confirmed(kind.name, x["match"]) & (F.lit(True) if kind.base else score(x) >= LEAST_SCORE)
    out = F.transform(F.filter(placed, keep), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), F.round(score(x), 2).alias("score")))
    return F.when(text.rlike(kind.guard), out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>"))


def find(docs: DataFrame, text_col: str = "text", pii_col: str = "pii") -> DataFrame:
    """``docs`` with ``pii_col``, in place of a column of that name: its spans as array<struct<start, kind, end, score>>, by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(pii_col, F.sort_array(F.concat(*(_spans(k, kind, text) for k, kind in enumerate(KINDS)))))


def joined(spans: Column, scores: bool = False) -> Column:
    name = F.array(*(F.lit(k.name) for k in KINDS))

    def one(x: Column) -> Column:
        parts = [F.get(name, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")]
        return F.concat(*parts, F.lit(":"), F.format_number(x["score"], 2)) if scores else F.concat(*parts)

    return F.array_join(F.transform(spans, one), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from a frame with ``pii``."""
    n_base = sum(k.base for k in KINDS)
    base = F.filter("pii", lambda x: x["kind"] < n_base)

    def count(k: int) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS) if kind.base]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), joined(F.col("pii"), True).alias("scores"))


#: Code points of the parts that a text is cut into before stretches are taken from it.
PART = 1024


def _stretch(parts: Column, first: Column, end: Column) -> Column:
    """The code points from ``first`` up to ``end`` of a text that was cut into ``parts``."""
    lower = lambda c: F.greatest(first - c * PART, F.lit(0))
    one = lambda c: F.substr(F.get(parts, c), lower(c) + 1, F.least(end - c * PART, F.lit(PART)) - lower(c))
    return F.when(end > first, F.array_join(F.transform(F.sequence((first / PART).cast("int"), ((end - 1) / PART).cast("int")), one), "")).otherwise("")


def redacted(found: DataFrame, text_col: str = "text", pii_col: str = "pii") -> DataFrame:
    """A frame with ``pii``, each stretch of its text that spans cover replaced by its first kind in brackets."""
    text, spans = F.col(text_col), F.col(pii_col)
    mark = F.array(*(F.lit(f"[{k.name.upper()}]") for k in KINDS))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, _text(at, x["start"], x["kind"])).otherwise("")

    def done(parts: Column) -> Column:
        one = lambda t: F.when(t != "", F.concat(_stretch(parts, _number(t, 0), _number(t, 1)), F.get(mark, _number(t, 2)))).otherwise("")
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(F.transform(scanned(spans, F.lit(0), step), one), ""), _stretch(parts, last, F.length(text)))

    whole = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), done)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text))
