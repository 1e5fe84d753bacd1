"""Rule recognisers: patterns per category, and the matches with their offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories and patterns. Patterns use what Java's and RE2's syntax share.
PATTERNS = {
    "Email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b",
    "IPAddress": r"\b[0-9]{1,9}(?:\.[0-9]{1,9}){3,}\b",
    "CreditCardNumber": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "PhoneNumber": r"\+[0-9][0-9 ()-]{7,14}[0-9]\b",
    "UKNationalInsuranceNumber": r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b",
    "UKNationalHealthNumber": r"\b[0-9]{3} [0-9]{3} [0-9]{4}\b",
    "UKElectoralRollNumber": r"\b[A-Z]{2,3}[0-9]{1,4}/[0-9]{1,4}\b",
    "UKUniqueTaxpayerReferenceNumber": r"\bUTR:? ?[0-9]{10}\b",
    "UKDriversLicenseNumber": r"\b[A-Z9]{5}[0-9]{6}[A-Z9]{2}[0-9A-Z]{3}\b",
    "PassportNumber": r"\b[Pp]assport(?: [Nn]o\.?)?:? ?[A-Z0-9]{9}\b",
    "DateTime": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b",
    "Age": r"\b[Aa]ged? [0-9]{1,3}\b",
    "Address": r"\b[0-9]{1,4} [A-Z][a-z]+ (?:Street|Road|Avenue|Lane)\b",
    "Secret": r"""\b(?:token|key|secret|password) = "[^"]+\"""",
}
#: Persons after a title, and organisations by their kind; defaults where no model's entities are given.
NAME_PATTERNS = {
    "Person": r"\b(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+\b",
    "Organization": r"\b[A-Z][a-z]+ (?:School|Academy|College|University|Ltd|Inc|GmbH)\b",
}
#: What every match of a category holds; a text without it isn't searched.
HOLDS = {
    "Email": "@", "IPAddress": ".", "PhoneNumber": "+", "UKElectoralRollNumber": "/", "UKUniqueTaxpayerReferenceNumber": "UTR", "PassportNumber": "assport",
    "DateTime": "/", "Secret": ' = "',
}
_MARK = "\x01"


def pieces(text: Column, pattern: str, holds: str = "") -> Column:
    """A text cut at its matches: every second piece is one. The mark character must not occur in texts; take it out first.
    Null for a text without the characters that every match ``holds``."""
    cut = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    return F.when(text.contains(holds), cut) if holds else cut


def matches(pieces: Column) -> Column:
    """From a column made by :func:`pieces`, all matches as ``array<struct<text, offset, length>>``, by code points."""
    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces) - 1, F.lit(2)))
    offset = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i - 1), F.lit(0), lambda a, p: a + F.length(p))
    return F.transform(places, lambda i: F.struct(F.element_at(pieces, i).alias("text"), offset(i).alias("offset"), F.length(F.element_at(pieces, i)).alias("length")))


def is_valid(category: Column, text: Column) -> Column:
    """Checks beyond the pattern: four octets, card and health-number check digits, the number of digits."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    octets = text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") & F.forall(F.split(text, r"\."), lambda o: o.cast("int") <= 255)
    nhs = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + (11 - i) * F.substring(digits, i, F.lit(1)).cast("int"))
    return (
        F.when(category == "IPAddress", octets)
        .when(category == "CreditCardNumber", F.call_function("luhn_check", digits))
        .when(category == "UKNationalHealthNumber", (11 - nhs % 11) % 11 == F.substring(digits, 10, 1).cast("int"))
        .when(category == "PhoneNumber", F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )
