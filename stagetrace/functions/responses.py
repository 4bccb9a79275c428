"""Cleaning of raw model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states a response can be in.
JSON, TEXT, ABSENT = "json", "text", "missing"

def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; null for null.

    Spark's JSON functions stop after the first value, so trailing text would go
    unnoticed.  The text is therefore read as the item before a known last item, once:
    it is one value exactly if that item is found, and is the second.  The last item is
    the text's own digest, which the text cannot contain.  `NaN`, infinities and
    repeated object keys are accepted.
    """
    last = F.md5(text)
    items = F.from_json(
        F.concat(F.lit("["), text, F.lit(',"'), last, F.lit('"]')),
        "array<string>",
        {"allowSingleQuotes": "false"},
    )
    return F.when(text.isNotNull(), F.coalesce(F.array_position(items, last) == 2, F.lit(False)))


def unescaped(text: Column) -> Column:
    """Literal backslash-n pairs become line breaks, before any parsing."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def normalized(raw: Column, max_chars: int | None = None) -> Column:
    """The state of a response and the text to show for it, as `status` and `body`.

    The text is as it is for JSON, and unquoted for anything else; with `max_chars`
    a text that is not JSON is cut to so many characters.  One value, so that a text
    is parsed once for both.
    """
    clean = unescaped(raw)
    plain = F.replace(clean, F.lit('\\"'), F.lit('"'))
    if max_chars is not None:
        plain = F.left(plain, F.lit(max_chars))

    def state(status: str, body: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), body.alias("body"))

    return (
        F.when(F.coalesce(raw, F.lit("")) == "", state(ABSENT, F.lit(None).cast("string")))
        .when(is_json(clean), state(JSON, clean))
        .otherwise(state(TEXT, plain))
    )
