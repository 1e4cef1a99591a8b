"""Readers of track, pose and ground-truth files; every one is a DataFrame plan over text or binary scans."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.geo import ecef_to_latlon, enu_to_latlon, valid_latlon

GROUND_TRUTH = "video_id string, video_url string, city string, vo_segment string, description string, source string, waypoints array<struct<t_sec: double, lat: double, lon: double>>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: the lines of text files, without comments and blanks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    return rows.where(~F.col("line").rlike("^[#%]") & (F.col("line") != ""))


def _field(i: int):
    """The ith comma- or space-separated field of ``line`` as a number; null where there is none."""
    return F.get(F.split("line", r"[,\s]+"), F.lit(i)).try_cast("double")


def oxts(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, t_sec, lat, lon from one text file a frame; frames follow file names at 10 Hz."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line"))
    fixes = whole.select("file", F.regexp_extract("file", r"^(.*)/[^/]*$", 1).alias("track"), _field(0).alias("lat"), _field(1).alias("lon"))
    seq = F.row_number().over(Window.partitionBy("track").orderBy("file")) - 1
    return fixes.withColumn("seq", seq).withColumn("t_sec", F.col("seq") / 10.0)


def timestamps(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, t_sec: seconds from a file's first stamp; digits beyond microseconds are cut."""
    rows = _lines(spark, path).withColumn("at", F.to_timestamp(F.substring("line", 1, 26)))
    w = Window.partitionBy("file").orderBy("at")
    micros = F.unix_micros("at")
    return rows.select("file", (F.row_number().over(w) - 1).alias("seq"), ((micros - F.min(micros).over(Window.partitionBy("file"))) / 1e6).alias("t_sec"))


def _timed(rows: DataFrame, t0: float | None) -> DataFrame:
    """Rebase the clock on the first row of a file, or on an absolute second."""
    base = F.min("t").over(Window.partitionBy("file")) if t0 is None else F.lit(t0)
    seq = F.row_number().over(Window.partitionBy("file").orderBy("t")) - 1
    return rows.where(valid_latlon("lat", "lon")).select("file", seq.alias("seq"), (F.col("t") - base).alias("t_sec"), "lat", "lon")


def malaga(spark: SparkSession, path: str, t0: float | None = None) -> DataFrame:
    """Fixes with radians in columns 1 and 2 behind a time in seconds."""
    rows = _lines(spark, path).select("file", _field(0).alias("t"), F.degrees(_field(1)).alias("lat"), F.degrees(_field(2)).alias("lon"))
    return _timed(rows.where("t is not null"), t0)


def brno(spark: SparkSession, path: str, tick: float = 1e-9) -> DataFrame:
    """Fixes with degrees behind a time in nanoseconds; rows out of range drop."""
    rows = _lines(spark, path).select("file", (_field(0) * tick).alias("t"), _field(1).alias("lat"), _field(2).alias("lon"))
    return _timed(rows.where("t is not null"), None)


def boreas(spark: SparkSession, origin_path: str, poses_path: str) -> DataFrame:
    """Camera poses in local metres about the first row of the origin file (radians), microsecond clock."""
    origin = spark.read.csv(origin_path, header=True, inferSchema=False).select(F.degrees(F.col("latitude").cast("double")).alias("lat0"), F.degrees(F.col("longitude").cast("double")).alias("lon0"), F.col("easting").cast("double").alias("e0"), F.col("northing").cast("double").alias("n0")).limit(1)
    placed = F.when((F.col("e0") == 0) & (F.col("n0") == 0), F.col("lat0")).otherwise(F.raise_error(F.lit("the origin row is not at (0, 0)")).cast("double"))
    poses = spark.read.csv(poses_path, header=True, inferSchema=False).select(F.col("_metadata.file_path").alias("file"), (F.col("GPSTime").cast("double") / 1e6).alias("t"), F.col("easting").cast("double").alias("e"), F.col("northing").cast("double").alias("n"))
    rows = poses.crossJoin(F.broadcast(origin.withColumn("lat0", placed)))  # one row
    lat, lon = enu_to_latlon("e", "n", "lat0", "lon0")
    return _timed(rows.select("file", "t", lat.alias("lat"), lon.alias("lon")), None)


def npy_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, seq and one double column for each column of saved numpy arrays."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("seq", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in columns])

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                array = array.reshape(len(array), -1)[:, : len(columns)].astype(float)
                arrays = [pa.array([file] * len(array)), pa.array(range(len(array)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(array[:, i]) for i in range(len(columns))]], names=["file", "seq", *columns])

    return files.mapInArrow(read, schema)


def comma_segments(spark: SparkSession, root: str) -> DataFrame:
    """segment, seq, t_sec, lat, lon from frame_positions (ECEF) and frame_times of segments below ``root``."""
    name = F.regexp_extract("file", r"([^/]+)/(?:global_pose/)?[^/]+$", 1).alias("segment")
    places = npy_columns(spark, f"{root}/*/frame_positions", ["x", "y", "z"]).withColumn("segment", name)
    times = npy_columns(spark, f"{root}/*/frame_times", ["t"]).withColumn("segment", name)
    lat, lon = ecef_to_latlon("x", "y", "z")
    rows = places.join(times.select("segment", "seq", "t"), ["segment", "seq"])
    return rows.select("segment", "seq", (F.col("t") - F.min("t").over(Window.partitionBy("segment"))).alias("t_sec"), lat.alias("lat"), lon.alias("lon"))


def lay_end_to_end(segments: DataFrame, route: str, segment: str = "segment", gap: float = 0.05) -> DataFrame:
    """One clock for a route: each segment starts a gap after the one before."""
    spans = segments.groupBy(route, segment).agg((F.max("t_sec") + gap).alias("_d"))
    before = Window.partitionBy(route).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    shifts = spans.withColumn("_o", F.coalesce(F.sum("_d").over(before), F.lit(0.0))).drop("_d")
    return segments.join(shifts, [route, segment]).withColumn("t_sec", F.col("t_sec") + F.col("_o")).drop("_o")


def pose_text(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, x, z from rows of a 3x4 or 4x4 pose matrix; the row's number is its frame."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    cells = rows.withColumn("line", F.trim("line")).withColumn("n", F.size(F.split("line", r"[,\s]+")))
    return cells.where("n in (12, 16)").select("file", "seq", _field(3).alias("x"), _field(11).alias("z"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """video_id, seq, t_sec, lat, lon of all waypoints; malformed documents and bad coordinates raise."""
    return waypoints(spark.read.schema(GROUND_TRUTH).option("mode", "FAILFAST").option("multiLine", True).json(path))


def waypoints(docs: DataFrame) -> DataFrame:
    """One row a waypoint of ground-truth documents; a document without any, or with a bad place, raises."""
    checked = docs.withColumn("waypoints", F.when(F.size("waypoints") > 0, F.col("waypoints")).otherwise(F.raise_error(F.concat(F.lit("no waypoints in "), F.coalesce("video_id", F.lit("?")))).cast("array<struct<t_sec: double, lat: double, lon: double>>")))
    rows = checked.select("video_id", F.posexplode("waypoints").alias("seq", "w")).select("video_id", "seq", "w.*")
    lat = F.when(valid_latlon("lat", "lon"), F.col("lat")).otherwise(F.raise_error(F.concat(F.lit("bad waypoint in "), F.coalesce("video_id", F.lit("?")))).cast("double"))
    return rows.withColumn("lat", lat)


def rank_cached_inputs(files: DataFrame, path: str = "path", modified: str = "modificationTime") -> DataFrame:
    """Files by preference: mp4, mkv, webm, others; the newest, then the name."""
    kind = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    order = F.when(kind == "mp4", 0).when(kind == "mkv", 1).when(kind == "webm", 2).otherwise(3)
    w = Window.partitionBy(F.regexp_extract(path, r"^(.*?)(?:\.[^./]*)?$", 1)).orderBy(order, F.desc(modified), path)
    return files.withColumn("preference", F.row_number().over(w))


def local_video(files: DataFrame, path: str = "path") -> DataFrame:
    """path, title, video_id: the stem, and a digest of the path."""
    return files.select(path, F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), F.concat(F.lit("local-"), F.substring(F.sha2(path, 256), 1, 12)).alias("video_id"))


def frame_sample(frames: DataFrame, clip: str, index: str, first: int, last: int, stride: int, most: int | None = None) -> DataFrame:
    """Every ``stride``-th frame of [first, last), at most ``most`` a clip."""
    rows = frames.where((F.col(index) >= first) & (F.col(index) < last) & (F.pmod(F.col(index) - first, F.lit(stride)) == 0))
    if most is None:
        return rows
    n = F.row_number().over(Window.partitionBy(clip).orderBy(index))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
