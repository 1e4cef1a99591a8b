"""Registered queries: pose chains, camera centres, map crops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracemill.functions import geo as G
from tracemill.operators import grouped as P
from tracemill.operators import poses as O
from tracemill.plans.tables import TRACKS, query, table, tracks

STEPS_OF_POSES = f"{TRACKS}, s as (select user_id, seq, event_type <> 'error' as ok, radians(y / 10) as yaw, 0.1 * (seq % 3) as tx, x / 100 as tz from tracks)"


@query(f"""with {STEPS_OF_POSES}, h as (select *, sum(case when ok then yaw else 0.0 end) over w as heading from s window w as (partition by user_id order by seq rows unbounded preceding))
select user_id, seq, round(heading, 6) as heading, round(sum(case when ok then -(cos(heading) * tx - sin(heading) * tz) else 0.0 end) over w, 5) as x, round(sum(case when ok then -(sin(heading) * tx + cos(heading) * tz) else 0.0 end) over w, 5) as z
from h window w as (partition by user_id order by seq rows unbounded preceding)""")
def x06_pose_chain(spark, sf_dir):
    """Centres of cameras chained by relative turns and shifts; a failed step holds the pose."""
    t = tracks(spark, sf_dir)
    steps = t.select("user_id", "seq", (F.col("event_type") != "error").alias("ok"), F.radians(F.col("y") / 10).alias("yaw"), (0.1 * (F.col("seq") % 3)).alias("tx"), (F.col("x") / 100).alias("tz"))
    out = O.chain_level(steps, "user_id", F.col("ok"))
    return out.select("user_id", "seq", F.round("heading", 6).alias("heading"), F.round("x", 5).alias("x"), F.round("z", 5).alias("z"))


@query("select event_id, round(-(cos(radians(value)) * user_id - sin(radians(value)) * 3), 6) as x, round(-(sin(radians(value)) * user_id + cos(radians(value)) * 3), 6) as z from events")
def x07_camera_center(spark, sf_dir):
    x, z = O.camera_center(F.radians("value"), F.col("user_id"), F.lit(3.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 6).alias("x"), F.round(z, 6).alias("z"))


@query()
def x04_driving_plane(spark, sf_dir):
    """Lengths of a track on its driving plane, by dropping the vertical and by dropping the flattest axis."""

    def fold(g):
        points = np.c_[g["x"], 0.1 * g["x"] + 0.01 * g["seq"], g["y"]]
        both = [np.linalg.norm(np.diff(O.driving_plane(points, flattest=f), axis=0), axis=1).sum() for f in (False, True)]
        return [tuple(round(float(v), 4) for v in both)]

    return P.per_group(tracks(spark, sf_dir), "user_id", "user_id long, level double, flattest double", fold, ["seq"])


def sql_mercator(lat: str) -> str:
    return f"(6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2)))"


@query(f"""with b as (select c_custkey as id, 48 + (c_custkey % 50) / 100.0::double as s, 9 + (c_custkey % 70) / 100.0::double as w0, 0.01 + (c_custkey % 7) / 50.0::double as d from customer),
p as (select id, {sql_mercator('s')} as y0, {sql_mercator('s + d')} as y1, radians(w0) * 6378137.0 as x0, radians(w0 + d) * 6378137.0 as x1, {sql_mercator('48')} as bottom, {sql_mercator('48.6')} as top, radians(9) * 6378137.0 as l, radians(9.8) * 6378137.0 as r from b),
c as (select id, round_even((x0 - l) / (r - l) * 1024, 0)::bigint as c0, round_even((x1 - l) / (r - l) * 1024, 0)::bigint as c1, round_even((top - y1) / (top - bottom) * 768, 0)::bigint as r0, round_even((top - y0) / (top - bottom) * 768, 0)::bigint as r1 from p),
d as (select id, greatest(0, least(c0, 1023)) as col0, c1, greatest(0, least(r0, 767)) as row0, r1 from c)
select id, col0, greatest(col0 + 1, least(c1, 1024)) as col1, row0, greatest(row0 + 1, least(r1, 768)) as row1 from d""")
def x30_mercator_crop(spark, sf_dir):
    """The pixels of a Mercator mosaic that a box of degrees covers, one at least."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (48 + k % 50 / 100.0).alias("s"), (9 + k % 70 / 100.0).alias("w0"), (0.01 + k % 7 / 50.0).alias("d"))
    rect = G.mercator_crop((F.col("s"), F.col("w0"), F.col("s") + F.col("d"), F.col("w0") + F.col("d")), (48.0, 9.0, 48.6, 9.8), 1024, 768)
    return rows.select("id", *[c.alias(n) for n, c in zip(("col0", "col1", "row0", "row1"), rect)])
