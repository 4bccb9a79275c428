"""The library's input tables, derived from the test tables by Spark.

Every table grows with the test tables.  Unusual cases are planted by the value
of the event id, so that each of them occurs at every scale; no row is left out
to make a query smaller.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagetrace.operators import colocated, linkage
from stagetrace.plans.dashboard import Workspace
from stagetrace.sources.site_config import parse_configs

# Cameras per site configuration document.
CAMERAS_PER_DOCUMENT = 50


# Declared, so that no job is run to look into the files.
_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "documents": "doc_id bigint, text string",
    "pages": "page_id bigint, url string",
    "conversations": "conv_id bigint, turn bigint, text string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int, remainder: int = 0) -> Column:
    return F.col("event_id") % n == remainder


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _stem() -> Column:
    """The part of a frame or video name that carries the linkage keys."""
    return F.concat(
        F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"),
        F.lit("_"),
        F.lpad(_text("event_id"), 7, "0"),
        F.lit("_cam_"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    )


def _share(factor: int) -> Column:
    """A value between 0 and 1 with three decimals."""
    return ((F.col("event_id") * factor) % 1001).cast("double") / F.lit(1000.0)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.lit("gs://b/frames-to-analyze/")
    good = F.concat(folder, F.lit("c"), _text("user_id"), F.lit("/"), _stem(), F.lit("_f"))
    prefix = F.when(_every(31), F.concat(folder, F.lit("bad"))).otherwise(good)
    frames = F.array(*(F.concat(prefix, F.lit(f"{i}.jpg")) for i in range(3)))
    # without a length the slice, and so the whole array, is null
    count = F.when(~_every(53), F.least(F.col("event_id") % 5, F.lit(3)).cast("int"))
    kind = F.col("event_type")
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("sess-"), _text("event_id")).alias("session_id"),
        F.when(~_every(89), (F.col("user_id") % 27).cast("string")).alias("farm_id"),
        F.when(~_every(97), _text("user_id")).alias("camera_id"),
        # on every day some rows lie in the last second of the working hours
        F.when(
            (F.col("event_id") + F.dayofmonth("ts")) % 11 == 0,
            F.timestamp_add("MILLISECOND", F.lit(61_259_900), F.col("ts").cast("date").cast("timestamp_ntz")),
        )
        .otherwise(F.col("ts"))
        .alias("processing_timestamp"),
        F.when(kind == "purchase", "animal_husbandry")
        .when(kind == "error", "down_cow")
        .when(kind == "click", "quick_movements")
        .otherwise("no_event")
        .alias("highest_probability_category"),
        ((F.round(F.col("value") * 100).cast("bigint") % 1001).cast("double") / F.lit(1000.0))
        .alias("highest_probability_value"),
        F.when(kind != "signup", kind.isin("error", "click")).alias("should_forward"),
        F.slice(frames, F.lit(1), count).alias("frame_uris"),
        _share(3).alias("probability_animal_husbandry"),
        _share(5).alias("probability_down_cow"),
        _share(7).alias("probability_quick_movements"),
        _share(11).alias("probability_no_event"),
        F.when(_every(11), F.lit("{bad")).when(~_every(19), F.col("props"))
        .alias("gemini_raw_response"),
    )


def inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forwarded events lead to none, one or two inferences."""
    kind = F.col("event_type")
    runs = (
        F.when(_every(6), F.array().cast("array<int>"))
        .when(_every(13), F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))
    )
    forwarded = _read(spark, sf_dir, "events").where(kind.isin("error", "click"))
    return forwarded.withColumn("run", F.explode(runs)).select(
        F.concat(F.lit("inf-"), _text("event_id"), F.lit("-"), _text("run")).alias("inference_id"),
        _text("user_id").alias("camera_id"),
        F.timestamp_add("HOUR", ((F.col("event_id") % 4) * 20).cast("int"), F.col("ts"))
        .alias("inference_timestamp"),
        F.when(kind == "error", "down_cow").otherwise("quick_movements").alias("classification"),
        _share(13).alias("max_probability_score"),
        (kind == "error").alias("should_forward"),
        F.when(~_every(17), F.concat(F.lit("gs://b/videos/"), _text("event_id"), F.lit(".mp4")))
        .alias("video_gcs_path"),
        F.when(_every(31), F.lit("bad.mp4")).otherwise(F.concat(_stem(), F.lit(".mp4")))
        .alias("file_name"),
        F.array(F.struct(F.lit("m0").alias("model"), F.col("props").alias("raw_response")))
        .alias("model_votes"),
    )


def _plus(df: DataFrame, *rows: tuple) -> DataFrame:
    """Add rows as a loader would have left them in a mapping table."""
    one = df.sparkSession.range(1, numPartitions=1)
    for row in rows:
        values = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, df.schema)]
        df = df.unionByName(one.select(*values))
    return df


def tenant_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = _read(spark, sf_dir, "region").select(
        _text("r_regionkey").alias("tenant_id"),
        F.when(F.col("r_regionkey") == 4, "").otherwise(F.col("r_name")).alias("tenant_name"),
        F.lit(None).cast("string").alias("tenant_ui_url"),
        F.lower("r_name").alias("tenant_slug"),
    )
    header = ("tenant_id", "tenant_name", "tenant_ui_url", "tenant_slug")
    return _plus(tenants, header, (None, "orphan", None, None))


def farm_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    farms = _read(spark, sf_dir, "nation").select(
        key.cast("string").alias("farm_id"),
        F.when(key != 3, F.col("n_name")).alias("farm_name"),
        F.when(key == 9, "no-such").when(key % 7 != 6, _text("n_regionkey")).alias("tenant_id"),
    )
    return _plus(farms, ("farm_id", "farm_name", "tenant_id"))


def camera_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    cameras = _read(spark, sf_dir, "supplier").select(
        key.cast("string").alias("camera_id"),
        F.when(key == 5, "").otherwise(F.col("s_name")).alias("camera_name"),
    )
    return _plus(cameras, ("camera_id", "camera_name"))


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    return Workspace(
        detections(spark, sf_dir),
        inferences(spark, sf_dir),
        tenant_map(spark, sf_dir),
        farm_map(spark, sf_dir),
        camera_map(spark, sf_dir),
    )


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three videos are in the store."""
    path = F.concat(F.lit("gs://b/videos/"), _text("event_id"), F.lit(".mp4"))
    return _read(spark, sf_dir, "events").where(~_every(3)).select(path.alias("uri"))


def object_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URIs of every shape: those of the events, damaged ones, and web addresses."""
    event = _text("event_id")
    uri = (
        F.when(_every(9, 0), F.concat(F.lit("gs://b"), event))
        .when(_every(9, 1), F.concat(F.lit("gs://b"), event, F.lit("/")))
        .when(_every(9, 2), F.concat(F.lit("s3://b/"), event))
        .when(_every(9, 3), F.lit(""))
        .when(_every(9, 5), F.concat(F.lit("gs://my_bucket/x/"), event))
        .when(_every(9, 6), F.concat(F.lit("gs://b/gs://c/"), event))
        .when(~_every(9, 4), F.concat(F.lit("gs://b/v/"), event, F.lit(".jpg")))
    )
    events = _read(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), event).alias("id"), uri.alias("uri")
    )
    pages = _read(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), _text("page_id")).alias("id"), F.col("url").alias("uri")
    )
    return events.unionByName(pages)


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of every shape, with whole documents and turns among them."""
    props, event = F.col("props"), _text("event_id")
    raw = (
        F.when(_every(10, 1), F.concat(F.lit("{bad "), event))
        .when(_every(10, 2), F.lit(""))
        .when(_every(10, 4), F.concat(F.lit("[1, "), props, F.lit("]")))
        .when(_every(10, 5), F.concat(props, F.lit(" x")))
        .when(_every(10, 6), F.concat(F.lit('{"a":\\n '), event, F.lit("}")))
        .when(_every(10, 7), F.concat(F.lit('{"a": "x\\ny'), event, F.lit('"}')))
        .when(_every(10, 8), F.concat(F.lit('{\\"a\\": '), event, F.lit("}")))
        .when(_every(10, 9), F.concat(F.lit('{"a": NaN, "a": '), event, F.lit("}")))
        .when(~_every(10, 3), props)
    )
    events = _read(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), event).alias("id"), raw.alias("raw")
    )
    documents = _read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), _text("doc_id")).alias("id"), F.col("text").alias("raw")
    )
    escaped = F.replace(
        F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')
    )
    turns = _read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("turn-"), _text("conv_id"), F.lit("-"), _text("turn")).alias("id"),
        F.concat(F.lit('{"text": "'), escaped, F.lit('"}')).alias("raw"),
    )
    return events.unionByName(documents).unionByName(turns)


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site configuration as JSON text, a bounded number of cameras in each.

    A farm with more cameras than fit is described by several documents, and one
    without cameras by a document of its own.
    """
    key = F.col("s_suppkey")
    cameras = _read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"),
        F.floor(key / CAMERAS_PER_DOCUMENT).alias("_part"),
        F.struct(F.col("s_name").alias("name"), key.cast("string").alias("uuid")).alias("camera"),
    )
    farms = _read(spark, sf_dir, "nation").join(cameras, "n_nationkey", "left")
    filled = farms.groupBy("n_nationkey", "n_name", "_part").agg(
        F.array_sort(F.collect_list("camera")).alias("cameras")
    )
    # some cameras have an earlier entry, which must not count
    earlier = F.transform(
        F.filter("cameras", lambda c: c["uuid"].cast("int") % 10 == 0),
        lambda c: F.struct(F.lit("Zed").alias("name"), c["uuid"].alias("uuid")),
    )
    farm = F.struct(
        F.col("n_name").alias("name"),
        _text("n_nationkey").alias("uuid"),
        F.concat(earlier, "cameras").alias("cameras"),
    )
    return filled.select(F.to_json(F.struct(F.array(farm).alias("farms"))).alias("doc"))


def site_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_configs(site_documents(spark, sf_dir), "doc")


def repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension in which most keys occur many times."""
    return _read(spark, sf_dir, "events").select(
        _text("user_id").alias("id"), F.col("event_type").alias("name"), "ts", "event_id"
    )


def struct_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections whose response comes parsed."""
    parsed = F.struct(F.col("session_id").alias("session"), F.col("should_forward").alias("forward"))
    return detections(spark, sf_dir).withColumn("gemini_raw_response", parsed)


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="stagetrace-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def inference_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key profile of the inferences, as a loader would have kept it."""
    path = _shared_folder(spark)
    linkage.inference_profile(inferences(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def stored_stages(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Names of both stages as keyed, bucketed tables, written anew."""
    path = _shared_folder(spark)
    names = tuple(f"stagetrace_stage{i}_{uuid.uuid4().hex[:12]}" for i in (1, 2))
    colocated.write_keyed(detections(spark, sf_dir), inferences(spark, sf_dir), *names, buckets=8, path=path)
    return names
