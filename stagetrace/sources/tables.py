"""Where the five tables live, and reading them with their declared schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stagetrace import schemas

# Formats whose files carry no types of their own.
_UNTYPED = {"json", "csv", "xml"}


@dataclass(frozen=True)
class Table:
    """A table in the catalog, files at a path, or a table behind a connector.

    `Table(name="cat.db.t")` reads the catalog, `Table(path=..., format="orc")`
    reads files, and `Table(name=..., format="bigquery", options={...})` loads
    the name through a connector that is on the class path.

    `where` is a fixed predicate on the stored columns, such as a bound on a
    partition column that is not among the declared ones; it prunes partitions.
    """

    name: str | None = None
    path: str | None = None
    format: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    where: str | None = None

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        if (self.name is None) == (self.path is None):
            raise ValueError("give a table either a name or a path")
        rows = self._load(spark, schema)
        return schemas.conform(rows.where(self.where) if self.where else rows, schema)

    def _load(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        if self.name and not self.format:
            return spark.table(self.name)
        kind = self.format or "parquet"
        reader = spark.read.format(kind).options(**self.options)
        if kind in _UNTYPED:
            reader = reader.schema(schema)
        return reader.load(self.name or self.path)


@dataclass(frozen=True)
class Tables:
    """The five tables one deployment works on."""

    detections: Table
    inferences: Table
    tenants: Table
    farms: Table
    cameras: Table

    @classmethod
    def in_namespace(cls, namespace: str, detections: str, inferences: str) -> Tables:
        """Tables of one `catalog.schema`; the mapping tables have fixed names."""
        return cls(
            detections=Table(name=f"{namespace}.{detections}"),
            inferences=Table(name=f"{namespace}.{inferences}"),
            tenants=Table(name=f"{namespace}.tenant_map"),
            farms=Table(name=f"{namespace}.farm_map"),
            cameras=Table(name=f"{namespace}.farm_camera_map"),
        )


def scan_detections(spark: SparkSession, table: Table) -> DataFrame:
    return table.read(spark, schemas.DETECTIONS)


def scan_inferences(spark: SparkSession, table: Table) -> DataFrame:
    return table.read(spark, schemas.INFERENCES)


def scan_tenants(spark: SparkSession, table: Table) -> DataFrame:
    return table.read(spark, schemas.TENANTS)


def scan_farms(spark: SparkSession, table: Table) -> DataFrame:
    return table.read(spark, schemas.FARMS)


def scan_cameras(spark: SparkSession, table: Table) -> DataFrame:
    return table.read(spark, schemas.CAMERAS)
