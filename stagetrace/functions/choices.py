"""Turning the values of optional filters into plain arguments."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Row

# Fixed value: the label and id of the "no restriction" entry of a filter list.
ALL = "All"

_BOUND = re.compile(r"([01]\d|2[0-4]):([0-5]\d)(?::([0-5]\d))?")


def chosen(value: Any) -> str | None:
    """The id to restrict to, or None for "no restriction".

    A value is an id, or an entry of a filter list, which has its id in the field
    `id`.  Nothing, blank text and the first entry of the lists restrict nothing.
    """
    if isinstance(value, (Row, dict)):
        value = value["id"]
    return str(value) if value not in (None, "", ALL) else None


def as_day(value: str | dt.date) -> dt.date:
    """A calendar day from a date or `YYYY-MM-DD` text; raises on anything else."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip()):
        raise ValueError(f"not a YYYY-MM-DD date: {value!r}")
    return dt.date.fromisoformat(value.strip())


def time_bound(text: str | None, fill_seconds: int) -> int | None:
    """Seconds of the day for an `HH:MM` or `HH:MM:SS` bound; blank means none.

    Unpadded hours are refused: as text `8:00` sorts after every `08:..`, so a
    text comparison would silently return nothing.
    """
    text = (text or "").strip()
    if not text:
        return None
    match = _BOUND.fullmatch(text)
    if not match:
        raise ValueError(f"not an HH:MM or HH:MM:SS time: {text!r}")
    hours, minutes, seconds = match.groups()
    second = fill_seconds if seconds is None else int(seconds)
    return int(hours) * 3600 + int(minutes) * 60 + second
