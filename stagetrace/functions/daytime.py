"""Predicates on calendar days and times of day that reach the file scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def on_day(ts: Column, day: dt.date) -> Column:
    """Rows of one calendar day.

    Catalyst rewrites the cast to a half-open timestamp range, which is pushed.
    """
    return ts.cast("date") == F.lit(day)


def between_days(
    ts: Column, first: dt.date | None, last: dt.date | None
) -> list[Column]:
    """Rows of the days first..last, both inclusive; an open end adds nothing."""
    predicates = []
    if first is not None:
        predicates.append(ts.cast("date") >= F.lit(first))
    if last is not None:
        predicates.append(ts.cast("date") <= F.lit(last))
    return predicates


def _instant(day: dt.date, seconds: int, kind: str) -> Column:
    moment = dt.datetime.combine(day, dt.time()) + dt.timedelta(seconds=seconds)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast(kind)


def in_time_window(
    df: DataFrame,
    column: str,
    start: int | None,
    end: int | None,
    precision: str,
    day: dt.date | None = None,
) -> list[Column]:
    """Time-of-day bounds in seconds of the day, both inclusive.

    `second` precision ignores fractions of a second, so 08:00:59.9 is within
    an end of 08:00:59; `micro` keeps them, so it is not.

    With a single day and clock readings that cannot repeat (no zone, or UTC)
    the bounds become a plain timestamp range, which the scan can use to skip
    row groups.  Otherwise the time of day is computed per row.
    """
    if precision not in ("second", "micro"):
        raise ValueError(f"unknown time precision: {precision!r}")
    ts = F.col(column)
    kind = df.schema[column].dataType
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    whole = precision == "second"
    predicates = []
    if day is not None and (isinstance(kind, T.TimestampNTZType) or zone == "UTC"):
        name = kind.simpleString()
        if start is not None:
            predicates.append(ts >= _instant(day, start, name))
        if end is not None and whole:
            predicates.append(ts < _instant(day, end + 1, name))
        elif end is not None:
            predicates.append(ts <= _instant(day, end, name))
        return predicates
    second = F.second(ts) if whole else F.date_part(F.lit("SECOND"), ts)
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + second
    if start is not None:
        predicates.append(clock >= F.lit(start))
    if end is not None:
        predicates.append(clock <= F.lit(end))
    return predicates
