"""Site configuration documents: one file per site, farms with their cameras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrace import schemas


def read_json_configs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per JSON file, with its path as `document`; files that are not JSON give
    a null `farms`."""
    rows = spark.read.schema(schemas.SITE_CONFIG).json(path, multiLine=True)
    return rows.select(F.col("_metadata.file_path").alias("document"), "farms")


def parse_configs(documents: DataFrame, column: str) -> DataFrame:
    """Documents held as JSON text in a column, parsed with the declared schema; other
    columns stay."""
    parsed = F.from_json(F.col(column), schemas.SITE_CONFIG)
    others = [c for c in documents.columns if c != column]
    return documents.select(*others, parsed["farms"].alias("farms"))
