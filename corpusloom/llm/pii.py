"""Personal data in texts, with built-in functions only.

A regular expression proposes spans of each kind, a validator confirms them (Luhn for
cards, mod 97 for account numbers, ranges of parts and counts of digits for the rest),
and words around a span raise its score. Positions come from the pieces that the same
expression splits a text into, so a text is never walked in Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Possessive repeats never try again with less: a run of any length takes one pass and
# no stack. Where a run could be entered in its middle, a look-behind forbids it, or
# allows it only where the last match ended.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Length of an account number by country: the registry, and the countries that use such
# numbers without being in it. The length tells where a number ends.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
LISTED = "|".join(code for codes in LENGTHS.values() for code in codes.split())
NUMBERS = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in LENGTHS.items())
# Only the two letters are used up, so that one that is none hides nothing that begins
# within it. A country that is not listed has its number in one piece.
ACCOUNT = (
    r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})"
    rf"(?=({NUMBERS}|(?!{LISTED})[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+)(?![A-Za-z0-9]))[A-Z]{{2}}"
)
NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CONTEXT = 40  # characters before and after a span that are looked at
PART = 64  # characters of the parts that a text is cut into for that
BLOCK = 256  # numbers summed in one go


@dataclass
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    may_have: Callable[[Column], Column]  # cheap test for the whole text
    words: str  # that make it likelier
    score: float
    base: bool = True  # is reported whatever its score
    head: int | None = None  # characters the pattern uses up, if less than its group 1, the span


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _card(span: Column) -> Column:
    return F.length(_digits(span)).between(16, 19) & F.call_function("luhn_check", _digits(span))


def _ip(span: Column) -> Column:
    # leading zeros do not count; more than three digits are over 255
    parts = F.transform(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def _account(span: Column) -> Column:
    """The first four characters move to the end, letters become 10 to 35, and the
    number leaves 1 when divided by 97."""
    plain = F.regexp_replace(span, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    code = lambda c: F.when(c < F.lit("A"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: F.pmod(r * F.when(c < F.lit("A"), 10).otherwise(100) + code(c), F.lit(97))
    return F.length(plain).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), step) == 1)


KINDS = [
    Kind("email", EMAIL, lambda s: F.lit(True), lambda t: F.contains(t, F.lit("@")), "mail|contact|write", 0.9),
    Kind("ip", IP, _ip, lambda t: F.lit(True), r"\bip\b|address|host|server", 0.6),
    Kind("card", CARD, _card, lambda t: F.lit(True), "card|visa|credit|pay", 0.8),
    Kind("phone", PHONE, lambda s: F.length(_digits(s)).between(8, 15), lambda t: F.contains(t, F.lit("+")), "phone|call|tel|mobile|fax", 0.7),
    Kind("iban", ACCOUNT, _account, lambda t: F.lit(True), "iban|account|bank|transfer", 0.7, base=False, head=2),
    Kind("ssn", NUMBER, lambda s: ~s.rlike("^(000|666|9)|-00-|-0000$"), lambda t: F.contains(t, F.lit("-")), "ssn|social|security|tax", 0.3, base=False),
]
LEAST = 0.5  # score of a span of the added kinds
MORE = 0.3  # what a context word adds


def _running(xs: Column) -> Column:
    """Running sums of a short array."""
    add = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    empty = F.array().cast("array<bigint>")
    return F.when(F.size(xs) == 0, empty).otherwise(F.aggregate(F.slice(xs, 2, F.size(xs)), F.slice(xs, 1, 1), add))


def _blocks(sizes: Column) -> Column:
    """Running sums within blocks of BLOCK numbers, so that no array grows item by item
    beyond that."""
    starts = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda i: _running(F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(sizes) == 0, F.array().cast("array<array<bigint>>")).otherwise(blocks)


def _joined(blocks: Column, ahead: Column) -> Column:
    """The blocks' sums with what lies ahead of each block added."""
    return F.flatten(F.zip_with(blocks, ahead, lambda b, base: F.transform(b, lambda x: x + base)))


def _ahead(blocks: Column) -> Column:
    totals = F.transform(blocks, lambda b: F.element_at(b, -1))
    return F.slice(_running(F.concat(F.array(F.lit(0).cast("bigint")), totals)), 1, F.size(blocks))


def _between(parts: Column, start: Column, stop: Column) -> Column:
    """Characters start to stop, at most CONTEXT, of the text cut into `parts`. A place
    in a long text is counted out anew each time, one in the parts is not."""
    start = F.greatest(start, F.lit(0))
    first = F.floor(start / PART).cast("int")
    few = F.array_join(F.slice(parts, first + 1, F.lit(CONTEXT // PART + 2)), "")
    return F.substring(few, (start - first * PART + 1).cast("int"), (stop - start).cast("int"))


def _found(kind: Kind) -> str:
    return f"_{kind.name}"


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id and spans, an array of (kind, start, end, score)
    sorted by kind in the order of KINDS, then start.

    start and end are code points, end exclusive. Spans of one kind don't overlap; those
    of different kinds may. Null and empty texts have none. A null doc_id stays null and
    repeated rows are rows of their own. Other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        matches = F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(0 if kind.head is None else 1))
        rows = rows.withColumn(f"{_found(kind)}_m", F.when(kind.may_have(F.col("_text")), matches).otherwise(none))
    for kind in KINDS:
        m = F.col(f"{_found(kind)}_m")
        pieces = F.when(F.size(m) > 0, F.split("_text", kind.pattern, -1)).otherwise(none)
        rows = rows.withColumn(f"{_found(kind)}_p", pieces)
    # one column for each step: what is used more than once is computed once
    for out, step in (
        ("d", lambda of, k: _distances(of("m"), of("p"), k.head)),
        ("b", lambda of, k: _blocks(of("d"))),
        ("a", lambda of, k: _ahead(of("b"))),
        ("s", lambda of, k: _joined(of("b"), of("a"))),
        # the lists that the matches stand in: breaks before them, and the first of each
        ("q", lambda of, k: _gaps(of("m"), of("p"), k.head)),
        ("f", lambda of, k: _breaks(of("m"), of("q"))),
        ("n", lambda of, k: _blocks(of("f"))),
        ("o", lambda of, k: _ahead(of("n"))),
        ("g", lambda of, k: _joined(of("n"), of("o"))),
        ("i", lambda of, k: _firsts(of("f"))),
    ):
        rows = rows.withColumns({f"{_found(k)}_{out}": step(lambda c, k=k: F.col(f"{_found(k)}_{c}"), k) for k in KINDS})
    some = F.greatest(*[F.size(f"{_found(k)}_m") for k in KINDS]) > 0
    rows = rows.withColumn("_parts", F.when(some, F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))).otherwise(none))
    for kind in KINDS:
        rows = rows.withColumn(_found(kind), _spans(kind))
        if kind.head is not None:
            rows = rows.withColumn(_found(kind), _apart(F.col(_found(kind))))
    spans = F.concat(*[F.col(_found(k)) for k in KINDS])
    return rows.select("doc_id", F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"])).alias("spans"))


def _distances(m: Column, p: Column, head: int | None) -> Column:
    """From the start of each match back to that of the one before: between them lie
    what that one used up and a piece."""
    used = lambda j: F.coalesce(F.length(F.get(m, j - 1)), F.lit(0)) if head is None else F.when(j > 0, head).otherwise(0)
    return F.transform(m, lambda x, j: (F.length(F.get(p, j)) + used(j)).cast("bigint"))


def _apart(spans: Column) -> Column:
    """The spans without those that begin within an earlier one that stays."""
    clash = lambda s, j: (j > 0) & (s["start"] < F.get(spans, j - 1)["end"])
    empty = F.slice(spans, 1, 0)
    stays = lambda done, s: F.when(s["start"] < F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)), done).otherwise(F.concat(done, F.array(s)))
    return F.when(F.exists(F.transform(spans, clash), lambda c: c), F.aggregate(spans, empty, stays)).otherwise(spans)


def _gaps(m: Column, p: Column, head: int | None) -> Column:
    """What lies before each match, back to the end of the one before, and after the last."""
    if head is None:
        return p
    body = lambda j: F.coalesce(F.length(F.get(m, j - 1)) - head, F.lit(0))
    return F.transform(p, lambda x, j: F.when(j > 0, F.substring(x, body(j) + 1, F.length(x))).otherwise(x))


def _breaks(m: Column, q: Column) -> Column:
    """1 for each match that does not continue a list: there is more than marks and
    digits, or more than CONTEXT characters, between it and the one before."""
    apart = lambda j: (j == 0) | (F.length(F.get(q, j)) > CONTEXT) | F.get(q, j).rlike(r"\p{L}")
    return F.transform(m, lambda x, j: F.when(apart(j), 1).otherwise(0).cast("bigint"))


def _firsts(f: Column) -> Column:
    return F.filter(F.transform(f, lambda x, j: F.when(x == 1, j)), lambda j: j.isNotNull())


def _spans(kind: Kind) -> Column:
    """The valid spans of a kind, scored by the text around them and around the list
    they stand in. What leads up to the next match, after the last mark before it,
    belongs to that one."""
    m, start, gap, group, firsts = (F.col(f"{_found(kind)}_{c}") for c in "msqgi")
    parts = F.col("_parts")
    before = lambda at: _between(parts, at - CONTEXT, at)

    def near(j: Column) -> Column:
        first = F.get(firsts, (F.get(group, j) - 1).cast("int"))
        following = F.coalesce(F.get(firsts, F.get(group, j).cast("int")), F.size(m))
        rest = F.get(gap, following)
        leads = (following < F.size(m)) & (F.length(rest) <= CONTEXT)
        after = F.when(leads, F.regexp_replace(rest, r"[,;.|\t\r\n][^,;.|\t\r\n]*\z", "")).otherwise(F.substring(rest, 1, CONTEXT))
        return F.lower(F.concat_ws("\n", before(F.get(start, first)), before(F.get(start, j)), after))

    def span(x: Column, j: Column) -> Column:
        valid = kind.valid(x)
        score = F.least(F.lit(kind.score) + F.when(valid & near(j).rlike(kind.words), MORE).otherwise(0.0), F.lit(1.0))
        return F.struct(
            F.lit(kind.name).alias("kind"),
            F.get(start, j).alias("start"),
            (F.get(start, j) + F.length(x)).alias("end"),
            F.round(score, 2).alias("score"),
            valid.alias("valid"),
        )

    keep = (lambda s: s["valid"]) if kind.base else (lambda s: s["valid"] & (s["score"] >= LEAST))
    return F.filter(F.transform(m, span), keep)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
