"""Result documents as rows of text or JSON; Spark's commit protocol makes the writes atomic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.sequence import linspace_rounded


def ground_truth_json(fixes: DataFrame, key: str, most: int = 40) -> DataFrame:
    """key, document: at most ``most`` evenly spaced waypoints, coordinates to 6 and times to 1 decimals."""
    few = linspace_rounded(fixes, key, most)
    point = F.struct("seq", F.struct(F.round("t_sec", 1).alias("t_sec"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).alias("w"))
    made = few.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["w"]).alias("waypoints"), F.min("t_sec").alias("a"), F.max("t_sec").alias("b"))
    segment = F.concat_ws(":", F.col("a").cast("int"), F.col("b").cast("int"))
    return made.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("video_id"), segment.alias("vo_segment"), "waypoints")).alias("document"))


def map_urls(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Links to a place on two public maps."""
    return (
        F.format_string("https://www.google.com/maps?q=%.6f,%.6f", lat, lon),
        F.format_string("https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=18/%.6f/%.6f", lat, lon, lat, lon),
    )


def position_report(routes: DataFrame, key: str, most: int = 50) -> DataFrame:
    """key, start, end, center, route: WGS84 places of a route, evenly thinned; no report for invalid routes."""
    from tracemill.functions.geo import valid_latlon

    whole = Window.partitionBy(key)
    sound = F.min(F.coalesce(valid_latlon("lat", "lon"), F.lit(False)).cast("int")).over(whole) == 1
    rows = routes.withColumn("_sound", sound).where("_sound").drop("_sound")
    point = F.struct("lat", "lon")
    ends = rows.groupBy(key).agg(F.min_by(point, "seq").alias("start"), F.max_by(point, "seq").alias("end"), F.struct(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).alias("center"))
    thin = linspace_rounded(rows, key, most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("route"))
    return ends.join(thin, key)


def ply_rows(points: DataFrame) -> DataFrame:
    """ASCII PLY vertex rows; the header needs the count and is written by ``ply_header``."""
    return points.select(F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", "r", "g", "b").alias("value"))


def ply_header(n: int) -> str:
    fields = "".join(f"property {kind} {c}\n" for kind, cs in (("float", "xyz"), ("uchar", ("red", "green", "blue"))) for c in cs)
    return f"ply\nformat ascii 1.0\nelement vertex {n}\n{fields}end_header\n"


def position_summary(lat: Column, lon: Column, level: Column) -> Column:
    return F.format_string("Position %.6f, %.6f (%s confidence)", lat, lon, level)
