from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from tables import at, detections

from stagetrace import schemas
from stagetrace.operators import dims
from stagetrace.plans.dashboard import Workspace
from stagetrace.sources import objects, site_config, tables

ROW = {"session_id": "s", "processing_timestamp": at("2024-01-10 08:00:00"), "frame_uris": ["u"]}


@pytest.mark.parametrize("form", ["parquet", "orc", "json"])
def test_files_by_path(spark, tmp_path, form):
    path = str(tmp_path / form)
    detections(spark, [ROW]).withColumn("extra", F.lit(1)).write.format(form).save(path)
    df = tables.scan_detections(spark, tables.Table(path=path, format=form))
    assert df.columns == schemas.DETECTIONS.fieldNames()
    row = df.first()
    assert (row.session_id, row.processing_timestamp, row.frame_uris) == (
        "s", at("2024-01-10 08:00:00"), ["u"],
    )


def test_partition_bounds(spark, tmp_path):
    rows = [ROW, ROW | {"session_id": "t"}]
    df = detections(spark, rows).withColumn("part", F.col("session_id"))
    df.write.partitionBy("part").parquet(str(tmp_path / "d"))
    table = tables.Table(path=str(tmp_path / "d"), where="part >= 't'")
    kept = tables.scan_detections(spark, table)
    assert [r.session_id for r in kept.collect()] == ["t"]
    assert len(kept.inputFiles()) >= 1 and "part" not in kept.columns


def test_catalog_tables(spark):
    detections(spark, [ROW]).createOrReplaceTempView("some_detections")
    assert tables.scan_detections(spark, tables.Table(name="some_detections")).count() == 1
    named = tables.Tables.in_namespace("cat.db", "d", "i")
    assert named.detections.name == "cat.db.d" and named.cameras.name == "cat.db.farm_camera_map"
    with pytest.raises(ValueError):
        tables.Table().read(spark, schemas.FARMS)


def test_workspace_opens_tables(spark, tmp_path):
    frames = {
        "detections": schemas.DETECTIONS, "inferences": schemas.INFERENCES,
        "tenants": schemas.TENANTS, "farms": schemas.FARMS, "cameras": schemas.CAMERAS,
    }
    for name, schema in frames.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    where = tables.Tables(**{n: tables.Table(path=str(tmp_path / n)) for n in frames})
    assert Workspace.open(spark, where).farms.count() == 0


def test_mismatches_are_reported(spark):
    df = spark.createDataFrame([(1, "t")], "farm_id int, tenant_id string")
    with pytest.raises(schemas.SchemaMismatch) as problem:
        schemas.conform(df, schemas.FARMS)
    assert "farm_id is int" in str(problem.value) and "farm_name is missing" in str(problem.value)
    votes = spark.createDataFrame([], schemas.INFERENCES).withColumn(
        "model_votes", F.array(F.struct(F.lit("m").alias("model")))
    )
    with pytest.raises(schemas.SchemaMismatch):
        schemas.conform(votes, schemas.INFERENCES)


def test_parsed_responses_become_text(spark):
    raw = F.struct(F.lit(1).alias("k"))
    df = detections(spark, [ROW]).withColumn("gemini_raw_response", raw)
    assert schemas.conform(df, schemas.DETECTIONS).first().gemini_raw_response == '{"k":1}'


SITE_1 = {
    "tenant": {"uuid": "t"},
    "farms": [
        {"name": "Farm 1", "uuid": "f1", "cameras": [
            {"name": "Cam 1", "uuid": "c1"}, {"name": "Off", "uuid": "c2", "disabled": True},
            {"uuid": "c3"}, {"name": "No id"}]},
        {"uuid": "f2"},
        {"name": "No id", "cameras": [{"name": "Cam 4", "uuid": "c4"}]},
    ],
}
SITE_2 = {"farms": [{"name": "Farm 3", "uuid": "f3", "cameras": []}]}
FARMS = [("f1", "Farm 1"), ("f2", "Unknown Farm"), ("f3", "Farm 3")]
CAMERAS = [
    ("c1", "Cam 1", "Farm 1", "f1"),
    ("c2", "Off", "Farm 1", "f1"),
    ("c3", "Unknown Camera", "Farm 1", "f1"),
    ("c4", "Cam 4", "No id", ""),
]


def check_site(configs):
    assert sorted(tuple(r) for r in dims.site_farms(configs).collect()) == FARMS
    assert sorted(tuple(r) for r in dims.site_cameras(configs).collect()) == CAMERAS


def test_json_site_files(spark, tmp_path):
    for i, site in enumerate([SITE_1, SITE_2, {}, {"other": 1}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(site, indent=2))
    (tmp_path / "broken.json").write_text("{farms: [")
    check_site(site_config.read_json_configs(spark, str(tmp_path)))


def test_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    contents = {"a.jpg": b"aaa", "in/b.jpg": b"", "c.txt": b"text"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    listed = objects.list_objects(spark, str(tmp_path), "*.jpg").collect()
    assert sorted((r.uri.rsplit("/", 1)[1], r.n_bytes) for r in listed) == [("a.jpg", 3)]
