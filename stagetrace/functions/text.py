"""Values as they are shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts shown for missing values and for flags.
MISSING = "N/A"
TICK, CROSS = "✓", "✗"
YES, NO = "Yes ✓", "No ✗"

_SPLITTER = 134217729.0  # 2**27 + 1 halves the 53 bits of a double


def or_default(text: Column, default: str) -> Column:
    """The text, or the default when it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def three_decimals(value: Column) -> Column:
    """A double with three decimals, rounded from its exact binary value.

    `format_string` rounds half up on the shortest decimal form, so 0.0625 would
    read 0.063; rounding the exact value, ties to even, gives 0.062.  The value
    is rounded to thousandths first, and where the product with 1000 lies half
    way, its rounding error tells on which side the exact product is.
    """
    thousand = F.lit(1000.0)
    product = value * thousand
    nearest = F.rint(product)
    rest = product - nearest
    spread = value * F.lit(_SPLITTER)
    high = spread - (spread - value)
    error = (high * thousand - product) + (value - high) * thousand
    step = F.when((F.abs(rest) == 0.5) & (rest * error > 0), rest * 2).otherwise(0.0)
    return F.format_string("%.3f", (nearest + step) / thousand)


def shown_score(value: Column) -> Column:
    """Three decimals; null and NaN are missing."""
    return F.when(value.isNull() | F.isnan(value), F.lit(MISSING)).otherwise(
        three_decimals(value)
    )


def shown_second(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(MISSING))


def shown_moment(ts: Column) -> Column:
    """Date and time, with six fraction digits unless they are all zero."""
    full = F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(F.regexp_replace(full, r"\.000000$", ""), F.lit(MISSING))


def shown_flag(flag: Column, true_text: str, false_text: str) -> Column:
    return (
        F.when(flag.isNull(), F.lit(MISSING))
        .when(flag, F.lit(true_text))
        .otherwise(F.lit(false_text))
    )
