"""Text normalisers and keys as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, spelled out so that every engine agrees on it.
SPACE = r"[ \t\n\x0b\f\r]"
#: Header labels whose line is dropped before comparing.
HEADER_LABELS = "from:|sent:|to:|subject:|cc:|bcc:"
#: Characters removed from keys.
NEEDLE_MARKS, QUOTE_MARKS = ("’s", "'s", "'", ".", ",", "(", ")", " "), ('"', "“", "”")
#: Canonical names of e-mail headers by their lower-case spelling.
HEADER_NAMES = {
    "from": "from", "to": "to", "cc": "cc", "bcc": "bcc", "subject": "subject", "date": "date", "sent": "date",
    "reply-to": "reply_to", "reply to": "reply_to", "message-id": "message_id", "mime-version": "mime_version",
    "content-type": "content_type", "attachment": "attachments", "attachments": "attachments",
}


def collapsed(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize_text(text: Column) -> Column:
    """For comparing paragraphs: without header remainders and quote marks, lower-cased, collapsed; null is empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?imd)({HEADER_LABELS}).*?$", "")
    return collapsed(F.lower(F.regexp_replace(bare, r"(?md)^>+[ \t\n\x0b\f\r]?", "")))


def normalize_email(text: Column) -> Column:
    """For comparing e-mail bodies: lower-cased and collapsed."""
    return collapsed(F.lower(F.coalesce(text, F.lit(""))))


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalize_pdf_text(text: Column) -> Column:
    """For matching text from PDF files: compatibility composition, zero-width characters dropped, collapsed.
    Spark has no Unicode normaliser, so texts outside ASCII go through an Arrow function."""
    text = F.coalesce(text, F.lit(""))
    composed = F.when(text.rlike(r"[^\x00-\x7f]"), _composed(text)).otherwise(text)
    return collapsed(F.translate(F.regexp_replace(composed, "[​‌‍⁠﻿]", ""), " ", " "))


def needle_key(text: Column) -> Column:
    """The key of a searched phrase: lower-cased, without possessive endings, some punctuation and spaces."""
    key = F.lower(text)
    for mark in NEEDLE_MARKS:
        key = F.replace(key, F.lit(mark), F.lit(""))
    return key


def haystack_key(text: Column) -> Column:
    """The key of page words: the needle's key, also without double quotes."""
    key = needle_key(text)
    for mark in QUOTE_MARKS:
        key = F.replace(key, F.lit(mark), F.lit(""))
    return key


def occurrence_key(text: Column) -> Column:
    """The key of a word when one redaction is spread to all its occurrences."""
    return F.regexp_replace(F.lower(text), r"[.,;:!?'’s()]+$", "")


def header_name(name: Column) -> Column:
    """The canonical name of an e-mail header, null for others."""
    key = F.lower(collapsed(F.regexp_replace(name, "[‐‑‒–—]", "-")))
    key = F.regexp_replace(key, " ?- ?", "-")
    return F.create_map(*(F.lit(x) for pair in HEADER_NAMES.items() for x in pair))[key]


def without_quotes(text: Column) -> Column:
    """Reply marks at line starts removed."""
    return F.regexp_replace(text, r"(?md)^[ \t\n\x0b\f\r]*(?:>[ \t\n\x0b\f\r]*)+", "")


def around(text: Column, offset: Column, before: int, after: Column | int) -> Column:
    """The characters from ``before`` ahead of an offset to ``after`` past it, clipped to the text."""
    start = F.greatest(F.lit(0), offset - before)
    return F.substring(text, start + 1, offset + after - start)
