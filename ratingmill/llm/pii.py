"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score. SQL functions only.

Patterns are possessive where nothing can be given back, so that long runs neither backtrack nor recurse, and start at the start
of a run or where the last match ended, which is where the leftmost match starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.spans import Rule, annotate, digest, redacted, spare

BASE = ("email", "ip", "card", "phone")
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": r"\bip\b|host|server|address|network",
    "card": "card|visa|credit|payment|master",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|insurance",
}
#: Words near a number that speak against personal data.
AGAINST = r"version|order|invoice|isbn|part no|serial"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass Luhn."""
    d = _digits(m)

    def value(i: Column) -> Column:
        x = F.substring(d, i, 1).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10."""
    c = F.replace(m, F.lit(" "), F.lit(""))
    c = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(c, i, 1)
        return F.when(x.between("0", "9"), (acc * 10 + F.ascii(x) - 48) % 97).otherwise((acc * 100 + F.ascii(x) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0), step) == 1


#: Of a kind: the score of a span that its checks confirm, and what a word near it that speaks for the kind adds.
SCORES = {"email": (0.85, 0.15), "ip": (0.6, 0.15), "card": (0.8, 0.15), "phone": (0.65, 0.15), "iban": (0.9, 0.1), "ssn": (0.3, 0.4)}
#: What a word near it that speaks against personal data takes away.
LESS = 0.2


def _scored(kind: str):
    start, more = SCORES[kind]

    def score(m: Column, before: Column, after: Column) -> Column:
        near = F.lower(F.concat_ws(" ", before, after))
        s = F.lit(start) + F.when(near.rlike(CONTEXT[kind]), more).otherwise(0.0)
        s = s - F.when(near.rlike(AGAINST), LESS).otherwise(0.0)
        return F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 3)

    return score


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_digit = lambda t: t.rlike("[0-9]")

RULES = (
    Rule(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"), score=_scored("email"),
    ),
    Rule(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.contains(".") & _digit(t),
        lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), _scored("ip"),
    ),
    Rule(
        "card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", _digit,
        lambda m: F.length(_digits(m)).between(14, 19) & luhn(m), _scored("card"),
    ),
    Rule(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"),
        lambda m: F.length(_digits(m)).between(10, 15), _scored("phone"),
    ),
    Rule(
        "iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _digit,
        lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & mod97(m), _scored("iban"),
    ),
    Rule(
        "ssn", r"[0-9][0-9-]*+", lambda t: t.contains("-") & _digit(t),
        lambda m: m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~m.rlike("^(?:000|666|9)|-00-|-0000$"), _scored("ssn"), least=0.5,
    ),
)


def find(docs: DataFrame, out: str = "pii", text: str = "text") -> DataFrame:
    """docs with the column `out`: an array of (start, rank, kind, end, text, score) by start, then kind.

    email, ip, card and phone are kept whenever they pass their checks, whatever their score; iban must pass mod 97; ssn is kept
    only if nearby words lift its score to 0.5. Null and empty texts have no span; rows and other columns stay as they are.
    """
    return annotate(docs, F.col(text), RULES, out)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every document; scores: of the spans, in their order.

    Null and empty texts have no span; equal rows and rows without doc_id are given each; an empty table gives no row.
    """
    return digest(find(docs.select("doc_id", "text"), "pii_spans"), "pii_spans", BASE, scores=True)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each piece of personal data in text replaced by its kind in brackets; n_chars, if there, follows the text.

    Null and empty texts, texts without a span and all other columns stay as they are; equal rows are kept each.
    """
    own = spare(docs, "__pii_spans")
    done = find(docs, own).withColumn("text", redacted(F.col("text"), F.col(own))).drop(own)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
