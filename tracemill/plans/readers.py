"""Registered queries: track files written from the tables and read again."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import grouped as P
from tracemill.operators.components import shared_folder
from tracemill.plans.tables import TRACKS, query, table, tracks
from tracemill.sources import citygml, sinks
from tracemill.sources import tracks as readers

PLACES = f"{TRACKS}, p as (select user_id, seq, epoch_us(ts) as us, 48 + y / 1000 as lat, 9 + x / 1000 as lon, x, y from tracks join (select event_id, ts from events) using (event_id))"


def _places(spark, sf_dir):
    """Tracks with their times in microseconds: user_id, seq, us, lat, lon, x, y."""
    at = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = tracks(spark, sf_dir).join(at, "event_id")
    return rows.select("user_id", "seq", "us", (48 + F.col("y") / 1000).alias("lat"), (9 + F.col("x") / 1000).alias("lon"), "x", "y")


def _written(rows, order: str, *head: str, kind: str = "text") -> str:
    """A folder with one file of lines for each user, after some header lines."""
    folder = f"{shared_folder(rows.sparkSession).rstrip('/')}/tracks-{uuid.uuid4().hex}"
    # the header goes with a user's first line: as rows of a union it may be dealt to another task, and so to another file
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(order)) == 1
    value = F.when(first, F.concat(F.lit("".join(f"{line}\n" for line in head)), "value")).otherwise(F.col("value"))
    lines = rows.select("user_id", F.col(order).alias("o"), value.alias("value"))
    lines.repartition("user_id").sortWithinPartitions("user_id", "o").drop("o").write.partitionBy("user_id").text(folder)
    return folder


def _user(rows):
    return rows.withColumn("user_id", F.regexp_extract("file", r"user_id=(\d+)", 1).cast("long"))


@query(f"with {PLACES} select user_id, round((us - min(us) over (partition by user_id)) / 1e6) as t_sec, round(lat, 7) as lat, round(lon, 7) as lon from p")
def s26_malaga(spark, sf_dir):
    line = F.concat_ws(" ", (F.col("us") / 1e6).cast("string"), F.radians("lat").cast("string"), F.radians("lon").cast("string"), F.lit("500 1 9"))
    folder = _written(_places(spark, sf_dir).withColumn("value", line), "seq", "% t lat lon alt fix sats")
    return _user(readers.malaga(spark, f"{folder}/*/*.txt")).select("user_id", F.round("t_sec").alias("t_sec"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(f"with {PLACES} select user_id, round((us - min(us) over (partition by user_id)) / 1e6) as t_sec, round(lat, 7) as lat, round(lon, 7) as lon from p")
def s29_brno(spark, sf_dir):
    """Nanosecond clock, fields divided by commas; a row out of range drops."""
    line = F.concat_ws(", ", (F.col("us") * 1000).cast("string"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit("1"))
    folder = _written(_places(spark, sf_dir).withColumn("value", line), "seq", "# ns, lat, lon, fix", "1000, 999, 16.6, 1")
    return _user(readers.brno(spark, f"{folder}/*/*.txt")).select("user_id", F.round("t_sec").alias("t_sec"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query(f"""with {PLACES} select user_id, round((us - min(us) over (partition by user_id)) / 1e6) as t_sec,
  round(43.78215 + y * 10 / (111132.954 - 559.822 * cos(2 * radians(43.78215)) + 1.175 * cos(4 * radians(43.78215))), 8) as lat,
  round(-79.46611 + x * 10 / (pi() / 180 * 6378137.0 * cos(radians(43.78215)) / sqrt(1 - (1 / 298.257223563) * (2 - 1 / 298.257223563) * sin(radians(43.78215)) ** 2)), 8) as lon from p""")
def s27_boreas(spark, sf_dir):
    """Poses in local metres about an origin that must stand at (0, 0)."""
    line = F.concat_ws(",", F.col("us").cast("string"), (F.col("x") * 10).cast("string"), (F.col("y") * 10).cast("string"))
    folder = _written(_places(spark, sf_dir).withColumn("value", line), "seq", "GPSTime,easting,northing")
    origin = f"{folder}-origin"
    spark.range(1).select(F.lit("latitude,longitude,easting,northing\n0.7641426710526,-1.3869452607,0,0").alias("value")).write.text(origin)
    rows = readers.boreas(spark, f"{origin}/*.txt", f"{folder}/*/*.txt")
    lat, lon = 43.78215, -79.46611  # the origin file's radians, to nine places
    shift = lambda c, base, radians: F.round(F.col(c) - F.degrees(F.lit(radians)) + base, 8).alias(c)
    return _user(rows).select("user_id", F.round("t_sec").alias("t_sec"), shift("lat", lat, 0.7641426710526), shift("lon", lon, -1.3869452607))


@query(f"with {PLACES} select user_id, seq, round((us - min(us) over (partition by user_id)) / 1e6, 6) as t_sec from p")
def s23_timestamps(spark, sf_dir):
    """Stamps with digits beyond microseconds, as seconds from a file's first."""
    line = F.concat(F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("789"))
    folder = _written(_places(spark, sf_dir).withColumn("value", line), "seq")
    return _user(readers.timestamps(spark, f"{folder}/*/*.txt")).select("user_id", F.col("seq").cast("long").alias("seq"), F.round("t_sec", 6).alias("t_sec"))


@query(f"with {PLACES} select user_id, seq, round(x, 6) as x, round(y, 6) as z from p")
def s39_pose_text(spark, sf_dir):
    """Rows of 12 or 16 numbers of which the fourth and the twelfth are the place."""
    x, z = F.col("x").cast("string"), F.col("y").cast("string")
    line = F.concat_ws(" ", F.lit("1 0 0"), x, F.lit("0 1 0 0 0 0 1"), z)
    line = F.when(F.col("seq") % 2 == 0, line).otherwise(F.concat_ws(" ", line, F.lit("0 0 0 1")))
    folder = _written(_places(spark, sf_dir).withColumn("value", line), "seq")
    return _user(readers.pose_text(spark, f"{folder}/*/*.txt")).select("user_id", F.col("seq").cast("long").alias("seq"), F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


@query(f"""with {PLACES}, n as (select user_id, max(seq) as last from p group by user_id), few as (select distinct user_id, cast(round_even(last * i / 39.0, 0) as bigint) as seq from n, range(40) r(i) where last >= 40 union select user_id, unnest(range(last + 1)) from n where last < 40)
select cast(user_id as varchar) as video_id, row_number() over (partition by user_id order by seq) - 1 as seq, round(lat, 6) as lat, round(lon, 6) as lon from p join few using (user_id, seq)""")
def s40_ground_truth(spark, sf_dir):
    """Ground-truth documents of tracks, written, read and validated."""
    fixes = _places(spark, sf_dir).withColumn("t_sec", F.col("us") / 1e6)
    folder = f"{shared_folder(spark).rstrip('/')}/truth-{uuid.uuid4().hex}"
    sinks.ground_truth_json(fixes, "user_id", 40).select(F.col("document").alias("value")).write.text(folder)
    rows = spark.read.text(folder)
    return readers.waypoints(rows.select(F.from_json("value", readers.GROUND_TRUTH, {"mode": "FAILFAST"}).alias("d")).select("d.*")).select("video_id", F.col("seq").cast("long").alias("seq"), "lat", "lon")


@query("select c_custkey as id, 'clip ' || c_custkey as title, 'local-' || substr(sha256('/videos/' || c_nationkey || '/clip ' || c_custkey || '.mp4'), 1, 12) as video_id from customer")
def s01_local_video(spark, sf_dir):
    path = F.concat(F.lit("/videos/"), "c_nationkey", F.lit("/clip "), "c_custkey", F.lit(".mp4"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), path.alias("path"))
    return readers.local_video(files).join(files, "path").select("id", "title", "video_id")


@query("select user_id, seq from (select *, row_number() over (partition by user_id order by seq) as n from (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events) where seq >= 3 and seq < 60 and (seq - 3) % 5 = 0) where n <= 8")
def s07_frame_sample(spark, sf_dir):
    """Every fifth frame of an interval, eight at most."""
    return readers.frame_sample(tracks(spark, sf_dir), "user_id", "seq", 3, 60, 5, 8).select("user_id", "seq")


@query("""with b as (select s_suppkey as k, (4 + s_suppkey % 9)::double as w, (5 + s_suppkey % 7)::double as d, (3 + s_suppkey % 11)::double as h, (30 + s_nationkey)::double as z from supplier)
select 'tile-' || k as tile, 10::bigint as triangles, round(2 * (w + d) * h + w * d, 5) as area, round(z, 6) as ground from b""")
def s33_citygml(spark, sf_dir):
    """A box for each supplier as CityGML, parsed and triangulated again; holes and loose lists do not count."""
    k = F.col("s_suppkey")
    sizes = table(spark, sf_dir, "supplier").select(k.alias("k"), *[c.cast("double").alias(n) for n, c in (("w", 4 + k % 9), ("d", 5 + k % 7), ("h", 3 + k % 11), ("z", 30 + F.col("s_nationkey")))])
    corner = {"a": ("0", "0"), "b": ("w", "0"), "c": ("w", "d"), "d": ("0", "d")}

    def ring(*names: str):
        """The closed ring of corners; an upper-case one stands on the roof."""
        cells = []
        for n in [*names, names[0]]:
            x, y = (F.lit(0.0) if c == "0" else F.col(c) for c in corner[n.lower()])
            cells += [x, y, F.col("z") + F.col("h") if n.isupper() else F.col("z")]
        text = F.concat_ws(" ", *[c.cast("string") for c in cells])
        return F.concat(F.lit("<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>"), text, F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"))

    hole = F.lit("<gml:Polygon><gml:interior><gml:LinearRing><gml:posList>1 1 1 2 1 1 2 2 1 1 1 1</gml:posList></gml:LinearRing></gml:interior></gml:Polygon><gml:posList>1 2 3 4 5 6</gml:posList>")
    faces = F.concat(*[ring(*f) for f in ("abBA", "bcCB", "cdDC", "daAD", "ABCD")])
    document = F.concat(F.lit('<c:CityModel xmlns:c="c" xmlns:gml="g" xmlns:b="b"><b:Building>'), faces, hole, F.lit("</b:Building></c:CityModel>"))
    files = sizes.select(F.concat(F.lit("tile-"), "k").alias("path"), document.cast("binary").alias("content"))
    mesh = citygml.buildings(files)
    side = lambda p, c: F.col(f"{p}{c}") - F.col(f"a{c}")
    cross = [side("b", i) * side("c", j) - side("b", j) * side("c", i) for i, j in ("yz", "zx", "xy")]
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
    return mesh.groupBy("tile").agg(F.count("*").alias("triangles"), F.round(F.sum(area), 5).alias("area"), F.round(F.min("ground_z"), 6).alias("ground"))


@query("""with t as (select p_partkey as k, case p_partkey % 5 when 0 then '12.5 m' when 1 then null when 2 then '9999' else null end as height, case p_partkey % 5 when 1 then '4' else null end as levels, (3 + p_size % 7)::double as w, (4 + p_size % 5)::double as d from part),
h as (select k, w, d, case when height = '12.5 m' then 12.5 when levels = '4' then 13.0 else 8.0 end::double as h from t)
select k, h as height, 10::bigint as triangles, round(2 * (w + d) * h + w * d, 5) as area from h""")
def s38_osm_mesh(spark, sf_dir):
    """Footprints with tagged heights as meshes of walls and roofs."""
    from tracemill.functions.text import osm_height

    k = F.col("p_partkey") % 5
    tags = F.when(k == 0, F.create_map(F.lit("height"), F.lit("12.5 m"))).when(k == 1, F.create_map(F.lit("building:levels"), F.lit("4"))).when(k == 2, F.create_map(F.lit("height"), F.lit("9999"))).otherwise(F.create_map(F.lit("building"), F.lit("yes")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), osm_height(tags).alias("height"), (3.0 + F.col("p_size") % 7).alias("w"), (4.0 + F.col("p_size") % 5).alias("d"))

    def fold(g):
        out = []
        for k, h, w, d in zip(g["k"], g["height"], g["w"], g["d"]):
            mesh = P.extrude([(0, 0), (w, 0), (w, d), (0, d)], h)
            area = np.linalg.norm(np.cross(mesh[:, 1] - mesh[:, 0], mesh[:, 2] - mesh[:, 0]), axis=1).sum() / 2
            out.append((int(k), float(h), len(mesh), round(float(area), 5)))
        return out

    return P.per_group(rows.withColumn("g", F.col("k") % 64), "g", "g long, k long, height double, triangles long, area double", fold, ["k"]).drop("g")
