"""Personal data by regular expressions, checksums and context, in SQL functions only.

Expressions propose spans, validators confirm them (Luhn for cards, mod-97 for bank
account numbers, ranges and digit counts for the others), and words near a span move
its score. The expressions are written so that they never backtrack over long runs:
they are possessive and begin where a run begins or the last match ended.

Added to the base kinds: ``iban``, confirmed by mod-97. Base spans always stay; an
added span stays if its score reaches ``least_score``. A null text is empty, a text
without data has no spans, repeated rows give repeated rows, other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadframes.llm.common import texts

LOCAL = "[A-Za-z0-9._%+-]"
#: Kind, expression, the text it cannot do without, score without context. Cards are
#: maximal chains of digits with 16 to 19 of them, which is what is left of all chains
#: after counting digits.
KINDS = (
    ("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", None, 0.7),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", None, 0.7),
)
#: Words that make a kind likelier or less likely near a span.
CONTEXT = {
    "email": ("mail|contact|write|address", "noreply|example"),
    "ip": ("ip|host|server|address|login", "version|release|section"),
    "card": ("card|visa|credit|payment|cvv", "order|serial|isbn|tracking"),
    "phone": ("phone|tel|call|mobile|fax", "version|model"),
    "iban": ("iban|bank|account|transfer|konto", "serial|model"),
}
NEAR = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    total = F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
        F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (ISO 13616) leaves 1: its first four signs moved to the end."""
    code = F.regexp_replace(code, " ", "")
    moved = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(1, 4))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97))
    return rest == 1


def _octets(value: Column) -> Column:
    return F.forall(
        F.split(value, r"\."),
        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
        & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))


CONFIRMED = {
    "email": lambda v: F.lit(True),
    "ip": _octets,
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
    "iban": mod97,
}


def _found(text: Column, kind: str, pattern: str, needs: str | None) -> Column:
    """Matches with their places, left to right: what stands between matches gives the places."""
    pieces, hits = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, i: Column) -> Column:
        here = acc["at"] + F.length(F.get(pieces, i))
        return F.struct((here + F.length(F.get(hits, i))).alias("at"), F.array_append(acc["starts"], here).alias("starts"))

    starts = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step)["starts"]
    found = F.transform(hits, lambda h, i: F.struct(
        F.lit(kind).alias("kind"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(h)).alias("stop"),
        h.alias("value")))
    likely = F.lit(True) if needs is None else F.contains(text, F.lit(needs))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,value:string>>")
    return F.when(likely & F.rlike(text, F.lit(pattern)), found).otherwise(none)


def _scored(text: Column, span: Column, kind: str, base: float) -> Column:
    before = F.lower(F.substring(text, F.greatest(span["start"] - NEAR + 1, F.lit(1)), F.least(span["start"], F.lit(NEAR))))
    after = F.lower(F.substring(text, span["stop"] + 1, F.lit(NEAR)))
    near = F.concat_ws(" ", before, after)
    more, less = CONTEXT[kind]
    score = (F.lit(base) + F.when(F.rlike(near, F.lit(rf"\b(?:{more})")), 0.2).otherwise(0.0)
             - F.when(F.rlike(near, F.lit(rf"\b(?:{less})")), 0.3).otherwise(0.0))
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"),
                    span["value"].alias("value"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def _confirmed(kind: str, base: float) -> Column:
    passed = F.filter(kind, lambda s: CONFIRMED[kind](s["value"]))
    return F.transform(passed, lambda s: _scored(F.col("text"), s, kind, base))


def find_pii(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """``doc_id``, and ``email``, ``ip``, ``card``, ``phone``, ``iban``: arrays of kind, start,
    stop (code points, end exclusive), value and score. Base kinds keep every confirmed span."""
    out = texts(docs)
    for kind, pattern, needs, _ in KINDS:
        out = out.withColumn(kind, _found(F.col("text"), kind, pattern, needs))
    columns = []
    for kind, _, _, base in KINDS:
        scored = _confirmed(kind, base)
        if kind == "iban":
            scored = F.filter(scored, lambda s: s["score"] >= least_score)
        columns.append(F.when(F.size(kind) > 0, scored).otherwise(F.array().cast(
            "array<struct<kind:string,start:int,stop:int,value:string,score:double>>")).alias(kind))
    return out.select("doc_id", *columns)
