"""Object URIs of the form scheme, bucket, object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the only scheme media is kept under.
SCHEME = "gs://"


def _rest(uri: Column) -> Column:
    """The URI without the scheme, wherever it occurs."""
    return F.replace(uri, F.lit(SCHEME), F.lit(""))


def is_object_uri(uri: Column) -> Column:
    """True for URIs with the scheme and a slash after the bucket; never null."""
    return F.coalesce(
        F.startswith(uri, F.lit(SCHEME)) & F.contains(_rest(uri), F.lit("/")), F.lit(False)
    )


def bucket_name(uri: Column) -> Column:
    return F.when(is_object_uri(uri), F.substring_index(_rest(uri), "/", 1))


def object_name(uri: Column) -> Column:
    rest = _rest(uri)
    return F.when(is_object_uri(uri), F.substr(rest, F.position(F.lit("/"), rest) + 1))
