"""Stand-ins of the same form as what they replace: the same text gets the same one everywhere, as all choices come from its MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.functions.scalars import luhn_digit

# Invented values.
FIRST = ["Asha", "Ravi", "Meera", "Arjun", "Kavya", "Nikhil", "Leela", "Sameer"]
LAST = ["Verma", "Menon", "Joshi", "Das", "Pillai", "Bose", "Saxena"]
STATES = ["Kerala", "Punjab", "Assam", "Goa", "Odisha"]
ORGS = (["Tech", "Global", "Prime", "Nova"], ["Systems", "Industries", "Services"])
DOMAINS = ["mail.example", "post.example", "inbox.example"]
BANKS, LICENCES, HOLDERS = ["AAAA", "BBBB", "CCCC"], ["MH", "KA", "TN", "KL"], list("ABCFGHLJPT")
TYPES = [*R.RISK_WEIGHT, "OTHER"]


def digits(text: Column) -> Column:
    """32 decimal digits."""
    return F.translate(F.md5(text), "abcdef", "012345")


def letters(text: Column) -> Column:
    return F.translate(F.md5(F.concat(F.lit("1:"), text)), "0123456789abcdef", "ABCDEFGHIJKLMNOP")


def number(text: Column, at: int, below: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("bigint") % below


def pick(text: Column, at: int, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number(text, at, len(values)) + 1).cast("int"))


def person(text: Column) -> Column:
    return F.concat(pick(text, 1, FIRST), F.lit(" "), pick(text, 5, LAST))


def email(name: Column, text: Column) -> Column:
    """An address made of a name."""
    return F.concat(F.lower(F.replace(name, F.lit(" "), F.lit("."))), F.substring(digits(text), 20, 2), F.lit("@"), pick(text, 9, DOMAINS))


def replacement(type_: Column, text: Column) -> Column:
    """One of fourteen forms by type; others get a fixed mark."""
    d, a = digits(text), letters(text)
    s = lambda c, at, n: F.substring(c, at, n)
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    card = F.concat(F.lit("4"), s(d, 1, 14))
    whole = F.concat(card, luhn_digit(card))
    forms = {
        "PAN": join(s(a, 1, 3), pick(text, 1, HOLDERS), s(a, 5, 1), s(d, 1, 4), s(a, 6, 1)),
        "AADHAAR": join(number(text, 1, 8) + 2, s(d, 2, 3), " ", s(d, 5, 4), " ", s(d, 9, 4)),
        "EMAIL": email(person(text), text),
        "PHONE": join("+91 ", number(text, 1, 4) + 6, s(d, 2, 4), " ", s(d, 6, 5)),
        "PERSON_NAME": person(text),
        "LOCATION": join(pick(text, 1, R.CITIES), ", ", pick(text, 5, STATES)),
        "ORGANIZATION": join(pick(text, 1, ORGS[0]), " ", pick(text, 5, ORGS[1])),
        "DATE_OF_BIRTH": join(F.lpad((number(text, 1, 28) + 1).cast("string"), 2, "0"), "/", F.lpad((number(text, 5, 12) + 1).cast("string"), 2, "0"), "/", number(text, 9, 50) + 1950),
        "CREDIT_CARD": join(s(whole, 1, 4), " ", s(whole, 5, 4), " ", s(whole, 9, 4), " ", s(whole, 13, 4)),
        "IFSC": join(pick(text, 1, BANKS), "0", s(d, 1, 6)),
        "PASSPORT": join(s(a, 1, 1), s(d, 1, 7)),
        "DRIVING_LICENSE": join(pick(text, 1, LICENCES), number(text, 5, 15) + 10, " ", s(d, 1, 4), " ", s(d, 5, 7)),
        "BANK_ACCOUNT": F.substring(d, F.lit(1), (number(text, 1, 8) + 9).cast("int")),
        "IP_ADDRESS": join(number(text, 1, 223) + 1, ".", number(text, 5, 256), ".", number(text, 9, 256), ".", number(text, 13, 254) + 1),
    }
    out = F.lit("[SYNTHETIC DATA]")
    for k, v in forms.items():
        out = F.when(type_ == k, v).otherwise(out)
    return out
