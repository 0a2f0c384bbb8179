"""Instants from the store's mixed time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, optionally a time with fraction and a zone; nothing looser, so that '2026' or '2026-07' stay null.
ISO = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|z|[+-]\d{2}(:?\d{2})?)?)?\s*$"


def timestamp(text: Column) -> Column:
    """A timestamp of the text; no offset means UTC (the session's zone is UTC); null if it is none."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")))


def instant(text: Column) -> Column:
    """Whole seconds since 1970 of the text, or null."""
    return F.unix_seconds(timestamp(text))


def utc_text(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of seconds since 1970."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
