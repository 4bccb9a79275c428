from __future__ import annotations

from pyspark.sql import Row
from tables import at, cameras, detections, farms

from stagetrace import schemas
from stagetrace.functions.choices import chosen
from stagetrace.operators import dims, facets, lookup

DAY = "2024-01-10"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_choices():
    entry = Row(pos=3, label="X", id="x")
    assert [chosen(v) for v in (None, "", "All", {"id": "All"}, Row(id=""))] == [None] * 5
    assert [chosen(v) for v in ("x", entry, 7, {"label": "X", "id": 7})] == ["x", "x", "7", "7"]


def test_dimensions(spark):
    tenants = spark.createDataFrame(
        [("t1", "T1", "u", None), ("t2", "", None, "s"), ("tenant_id", "tenant_name", "", ""),
         (None, "lost", "", ""), ("", "no id", "", "")],
        schemas.TENANTS,
    )
    farm_rows = spark.createDataFrame(
        [("f1", "F1", "t1"), ("f2", "", "t2"), ("f3", None, "gone"), ("f4", "F4", None),
         ("f5", "F5", ""), ("farm_id", "farm_name", "tenant_id"), (None, "lost", "t1")],
        schemas.FARMS,
    )
    dim = dims.tenant_dim(tenants)
    assert rows(dim) == [("", "no id", "", ""), ("t1", "T1", "u", ""), ("t2", "Unknown Tenant", "", "s")]
    assert rows(dims.farm_dim(farm_rows, dim)) == [
        ("f1", "F1", "t1", "T1"),
        ("f2", "Unknown Farm", "t2", "Unknown Tenant"),
        ("f3", "Unknown Farm", "gone", "Unknown Tenant"),
        ("f4", "F4", "", "Unknown Tenant"),
        ("f5", "F5", "", "Unknown Tenant"),
    ]
    raw = cameras(spark, [("c1", "C1"), ("c2", None), ("camera_id", "camera_name"), (None, "x")])
    assert rows(dims.camera_dim(raw)) == [("c1", "C1"), ("c2", "Unknown Camera")]


def test_last_row_of_a_key_wins(spark):
    df = spark.createDataFrame(
        [("a", "old", 1), ("a", "new", 2), ("a", None, 0), ("b", "only", 9)],
        "id string, name string, seq int",
    )
    assert rows(dims.latest_per_key(df, "id", ["seq"])) == [("a", "new", 2), ("b", "only", 9)]
    assert rows(dims.latest_per_key(df, "id")) == [("a", "old", 1), ("b", "only", 9)]


def test_names_and_info(spark):
    dim = farms(spark, [("f1", "F1", "t1", "T1")])
    df = spark.createDataFrame([("f1",), ("f9",), (None,)], "farm_id string")
    named = lookup.with_display_name(df, dim, "farm_id", "farm_name", "n", "N/A")
    assert {r.farm_id: r.n for r in named.collect()} == {"f1": "F1", "f9": "f9", None: "N/A"}
    known = df.where("farm_id IS NOT NULL")
    assert rows(lookup.farm_info(known, dim)) == [
        ("f1", "F1", "t1", "T1"),
        ("f9", "f9", "", "Unknown"),
    ]
    seen = spark.createDataFrame([("c1",), ("c9",)], "camera_id string")
    assert rows(lookup.camera_info(seen, cameras(spark, [("c1", "C1")]))) == [
        ("c1", "C1"),
        ("c9", "c9"),
    ]
    site = spark.createDataFrame(
        [("c1", "C1", "F1", "f1")],
        "camera_id string, camera_name string, farm_name string, farm_id string",
    )
    assert rows(lookup.camera_info(seen, site)) == [
        ("c1", "C1", "F1", "f1"),
        ("c9", "c9", "Unknown", ""),
    ]


def events_of(spark, pairs):
    return detections(
        spark,
        [
            {"farm_id": f, "camera_id": c, "processing_timestamp": at(f"{DAY} 00:00:00")}
            for f, c in pairs
        ]
        + [{"farm_id": "late", "camera_id": "late", "processing_timestamp": at("2024-01-11 00:00:00")}],
    )


def entries(df):
    return [(r.label, r.id) for r in sorted(df.collect(), key=lambda r: r.pos)]


def test_facets(spark):
    events = events_of(spark, [("f1", "c1"), ("f1", "c2"), ("f2", "c1"), ("f9", None), (None, "c3")])
    dim = farms(
        spark,
        [("f1", "Z", "t1", "Same"), ("f2", "A", "t2", "Same"), ("f9", "Q", "", "Unknown Tenant"),
         ("f7", "Unseen", "t7", "T7")],
    )
    assert entries(facets.tenant_facet(events, dim, DAY)) == [
        ("All", "All"), ("Same", "t1"), ("Same", "t2"),
    ]
    assert entries(facets.farm_facet(events, dim, DAY)) == [
        ("All", "All"), ("A", "f2"), ("Q", "f9"), ("Z", "f1"),
    ]
    assert entries(facets.farm_facet(events, dim, DAY, {"label": "Same", "id": "t1"})) == [
        ("All", "All"), ("Z", "f1"),
    ]
    names = cameras(spark, [("c1", "Zed"), ("c3", "Amy")])
    assert entries(facets.camera_facet(events, names, DAY)) == [
        ("All", "All"), ("Amy", "c3"), ("Zed", "c1"), ("c2", "c2"),
    ]
    assert entries(facets.camera_facet(events, names, DAY, "f1")) == [
        ("All", "All"), ("Zed", "c1"), ("c2", "c2"),
    ]
    assert entries(facets.camera_facet(events, names, "2023-01-01")) == [("All", "All")]


def test_lists_are_whole_and_limits_come_last(spark):
    farm_ids = [f"f{i:03d}" for i in range(120)]
    events = events_of(spark, [(f, "c") for f in farm_ids])
    dim = farms(spark, [(f, f"N{f}", "t1" if i >= 95 else "t0", "T") for i, f in enumerate(farm_ids)])
    assert len(entries(facets.farm_facet(events, dim, DAY))) == 121
    assert [i for _, i in entries(facets.farm_facet(events, dim, DAY, "t1"))] == ["All", *farm_ids[95:]]
    cut = facets.farm_facet(events, dim, DAY, "t1", limit=5)
    assert [i for _, i in entries(cut)] == ["All", *farm_ids[95:100]]
    # a limit is by id even when names sort the other way round
    reverse = farms(spark, [(f, f"N{999 - i}", "t", "T") for i, f in enumerate(farm_ids)])
    listed = [i for _, i in entries(facets.farm_facet(events, reverse, DAY, limit=100))]
    assert listed == ["All", *reversed(farm_ids[:100])]


def test_the_last_entry_of_a_site_document_counts(spark):
    configs = spark.createDataFrame(
        [(1, [("F", "f1", [("Zed", "c"), ("Amy", "c"), ("One", "d")]), ("G", "f1", [("Two", "d")])]),
         (2, [("H", "f2", [("Bob", "e")])]), (3, [("Ann", "f2", [("Abe", "e")])])],
        "doc int, farms array<struct<name: string, uuid: string, cameras: array<struct<name: string, uuid: string>>>>",
    )
    assert rows(dims.site_cameras(configs, ["doc"])) == [
        ("c", "Amy", "F", "f1"), ("d", "Two", "G", "f1"), ("e", "Abe", "Ann", "f2"),
    ]
    assert rows(dims.site_farms(configs, ["doc"])) == [("f1", "G"), ("f2", "Ann")]
