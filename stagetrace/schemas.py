"""Declared schemas of the input tables, and a check that a frame fits them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


DETECTIONS = _schema(
    ("session_id", _S),
    ("farm_id", _S),
    ("camera_id", _S),
    ("processing_timestamp", T.TimestampType()),
    ("highest_probability_category", _S),
    ("highest_probability_value", _D),
    ("should_forward", _B),
    ("frame_uris", T.ArrayType(_S)),
    ("probability_animal_husbandry", _D),
    ("probability_down_cow", _D),
    ("probability_quick_movements", _D),
    ("probability_no_event", _D),
    ("gemini_raw_response", _S),
)

INFERENCES = _schema(
    ("inference_id", _S),
    ("camera_id", _S),
    ("inference_timestamp", T.TimestampType()),
    ("classification", _S),
    ("max_probability_score", _D),
    ("should_forward", _B),
    ("video_gcs_path", _S),
    ("file_name", _S),
    ("model_votes", T.ArrayType(_schema(("raw_response", _S)))),
)

TENANTS = _schema(
    ("tenant_id", _S), ("tenant_name", _S), ("tenant_ui_url", _S), ("tenant_slug", _S)
)
FARMS = _schema(("farm_id", _S), ("farm_name", _S), ("tenant_id", _S))
CAMERAS = _schema(("camera_id", _S), ("camera_name", _S))

# One site configuration document; unknown members of the document are ignored.
SITE_CONFIG = _schema(
    (
        "farms",
        T.ArrayType(
            _schema(
                ("name", _S),
                ("uuid", _S),
                ("cameras", T.ArrayType(_schema(("name", _S), ("uuid", _S)))),
            )
        ),
    )
)

# Text columns that may also arrive as parsed JSON; they are rendered as text.
_JSON_TEXT = {"gemini_raw_response"}

_TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)
_PARSED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


class SchemaMismatch(ValueError):
    """A table does not have the columns or types a query needs."""


def _fits(actual: T.DataType, expected: T.DataType) -> bool:
    if isinstance(expected, _TIMESTAMPS):
        return isinstance(actual, _TIMESTAMPS)
    if isinstance(expected, T.ArrayType):
        return isinstance(actual, T.ArrayType) and _fits(
            actual.elementType, expected.elementType
        )
    if isinstance(expected, T.StructType):
        if not isinstance(actual, T.StructType):
            return False
        have = {f.name: f.dataType for f in actual.fields}
        return all(f.name in have and _fits(have[f.name], f.dataType) for f in expected)
    return type(actual) is type(expected)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Keep the declared columns, in order; raise if one is absent or mistyped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems, columns = [], []
    for field in schema.fields:
        actual = have.get(field.name)
        if actual is None:
            problems.append(f"{field.name} is missing")
        elif field.name in _JSON_TEXT and isinstance(actual, _PARSED):
            columns.append(F.to_json(field.name).alias(field.name))
        elif not _fits(actual, field.dataType):
            problems.append(
                f"{field.name} is {actual.simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
        else:
            columns.append(F.col(field.name))
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df.select(*columns)
