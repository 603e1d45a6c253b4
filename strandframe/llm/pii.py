"""Personal data: regular expressions propose, checksums confirm, words nearby adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower, let

# Fixed patterns of the base kinds. Starts are tied to the beginning of a run (or the end of the match before) and runs are
# possessive, and runs of under 13 digits are left out of the card pattern at once: this only saves work on matches that fail.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Fixed patterns of the added kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+(-])(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[\x20-])[0-9]{3}[\x20-][0-9]{4}(?![0-9A-Za-z-])"


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap test that every text with a match passes; ``near`` are words that raise the score."""

    name: str
    pattern: str
    hint: str
    prior: float
    near: str
    base: bool


KINDS = (
    Kind("email", EMAIL, r"@", 0.9, r"mail|contact|write", True),
    Kind("ip", IP, r"[0-9]\.[0-9]++\.[0-9]", 0.7, r"\bip\b|host|server|address|login", True),
    Kind("card", CARD, r"[0-9][\x20-]?[0-9]", 0.8, r"card|visa|master|credit|payment", True),
    Kind("phone", PHONE, r"\+[0-9]", 0.8, r"phone|call|tel|mobile|fax", True),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.9, r"iban|bank|account", False),
    Kind("national_id", NATIONAL_ID, r"[0-9]-[0-9]{2}-[0-9]", 0.4, r"ssn|social|security|tax|\bid\b", False),
    Kind("local_phone", LOCAL_PHONE, r"[0-9][\x20-][0-9]{4}", 0.3, r"phone|call|tel\b|tel\.|mobile|fax|whatsapp", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    places = F.split(F.reverse(digits), "")

    def add(total: Column, place: Column) -> Column:
        doubled = place.d * 2
        return F.when(place.i % 2 == 0, total + place.d).otherwise(total + doubled - F.when(doubled > 9, 9).otherwise(0))

    marked = F.transform(F.filter(places, lambda d: d != ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(marked, F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number with its country and check digits leaves 1 on division by 97."""
    moved = F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.char_length(q) < 3) | ((F.char_length(q) == 3) & (q <= "255")))
        return F.forall(F.split(found, r"\."), small)
    if kind == "card":
        return let(_digits(found), lambda d: F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(found)).between(9, 15)
    if kind == "iban":
        return let(F.regexp_replace(found, " ", ""), lambda c: F.when(F.char_length(c).between(15, 34), mod97(c)).otherwise(False))
    if kind == "national_id":
        return ~found.rlike(r"^(000|666|9..)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: Kind, window: int, least: float) -> Column:
    """Array of (kind, start, end, score) of the confirmed matches, in code points, in order.

    ``split`` gives the stretches between the matches, so starts are running sums of lengths and no match is searched twice.
    """
    text = F.col("text")
    between = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def place(both: Column) -> Column:
        lengths = F.zip_with(F.transform(both.gaps, F.char_length), F.transform(both.found, F.char_length), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def step(acc: Column, x: Column) -> Column:
            start = acc.at + x.a
            return F.struct((start + F.coalesce(x.b, F.lit(0))).alias("at"), F.concat(acc.starts, F.array(start)).alias("starts"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(lengths, zero, step, lambda acc: acc.starts)

    def scored(s: Column) -> Column:
        before, after = F.right(F.get(s.both.gaps, s.i), F.lit(window)), F.left(F.get(s.both.gaps, s.i + 1), F.lit(window))
        near = ascii_lower(F.concat_ws(" ", before, after)).rlike(kind.near)
        return F.least(F.lit(1.0), F.lit(kind.prior) + F.when(near, 0.3).otherwise(0.0))

    def spans(both: Column) -> Column:
        def of(starts: Column) -> Column:
            rows = F.transform(
                both.found,
                lambda m, i: F.struct(
                    F.lit(kind.name).alias("kind"), starts[i].alias("start"), (starts[i] + F.char_length(m)).alias("end"),
                    scored(F.struct(both.alias("both"), i.alias("i"))).alias("score"), _confirmed(kind.name, m).alias("ok"),
                ),
            )
            return F.filter(rows, lambda r: r.ok & (F.lit(kind.base) | (r.score >= least)))

        return let(place(both), of)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double,ok:boolean>>")
    return F.when(text.rlike(kind.hint), let(F.struct(between.alias("gaps"), found.alias("found")), spans)).otherwise(none)


def find_personal_data(docs: DataFrame, window: int = 40, least: float = 0.5) -> DataFrame:
    """``doc_id`` and ``spans``: an array of (kind, start, end, score), by kind in the order of ``KINDS``, then by start.

    Start and end are code points, the end exclusive. Base kinds (email, ip, card, phone) are the leftmost non-overlapping
    matches of their pattern that pass their check and are always returned; added kinds never overlap them. Added kinds (IBAN by mod-97, national id
    and local phone numbers) are returned if the pattern's prior, raised by words within ``window`` characters, reaches
    ``least``. Null texts count as empty and have no spans; repeated rows are treated alike; other columns are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.concat(*[_spans(k, window, least) for k in KINDS if k.base])
    added = F.concat(*[_spans(k, window, least) for k in KINDS if not k.base])

    def apart(both: Column) -> Column:
        return F.concat(both.base, F.filter(both.added, lambda a: ~F.exists(both.base, lambda b: (a.start < b.end) & (b.start < a.end))))

    spans = let(F.struct(base.alias("base"), added.alias("added")), apart)
    return rows.select("doc_id", F.transform(spans, lambda r: F.struct(r.kind, r.start, r.end, r.score)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r.kind, r.start, r.end)), ",")
