"""Registered queries: streams replayed from the events table, sinks, skylines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill.operators import skyline as K
from tracemill.sources import sinks
from tracemill.streaming import tracks as M
from tracemill.plans.tables import query, table, tracks


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _replayed(stream, mode="append"):
    return M.run_to_end(stream, f"replay_{uuid.uuid4().hex}", mode)


@query("""with w as (select user_id, ts, value, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as b from events), h as (
  select user_id, value, unnest([b, b - interval 6 hour]) as start from w
) select user_id, start::timestamp as start, count(*) as n_rows, round(avg(value), 6) as mean_value from h group by user_id, start""")
def m01_hopping_windows(spark, sf_dir):
    out = _replayed(M.hopping(_stream(spark, sf_dir), "user_id", "12 hours", "6 hours"), "complete")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query()
def m02_plausible_fixes(spark, sf_dir):
    fixes = _stream(spark, sf_dir).select("user_id", "ts", (48 + F.col("value") / 20000).alias("lat"), F.lit(9.0).alias("lon"))
    return _replayed(M.plausible(fixes, "user_id", 1.0))


@query("select distinct user_id from events")
def m03_first_seen(spark, sf_dir):
    return _replayed(M.first_seen(_stream(spark, sf_dir), "user_id", "3650 days")).select("user_id")


@query("""select user_id, time_bucket(interval 1 day, ts, timestamp '1970-01-01')::timestamp as start, round(median(value), 6) as motion, median(value) >= 20 as valid from events group by all""")
def m04_moving_steps(spark, sf_dir):
    out = _replayed(M.moving(_stream(spark, sf_dir), "user_id", "1 day", 20.0), "complete")
    return out.withColumn("motion", F.round("motion", 6))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 12 hour as "end", count(*) as n_rows from s group by user_id, k""")
def m05_drives(spark, sf_dir):
    return _replayed(M.drives(_stream(spark, sf_dir), "user_id", "12 hours"), "complete")


@query("""select c_custkey as id, format('https://www.google.com/maps?q={:.6f},{:.6f}', 48 + c_custkey / 1e5, 9 + c_custkey / 2e5) as url,
  format('Position {:.6f}, {:.6f} ({} confidence)', 48 + c_custkey / 1e5, 9 + c_custkey / 2e5, c_mktsegment) as summary from customer""")
def k13_map_urls(spark, sf_dir):
    k = F.col("c_custkey")
    lat, lon = 48 + k / 1e5, 9 + k / 2e5
    return table(spark, sf_dir, "customer").select(k.alias("id"), sinks.map_urls(lat, lon)[0].alias("url"), sinks.position_summary(lat, lon, F.col("c_mktsegment")).alias("summary"))


@query()
def k03_ground_truth_json(spark, sf_dir):
    fixes = tracks(spark, sf_dir).select("user_id", "seq", "t_sec", (48 + F.col("x") / 1e4).alias("lat"), (9 + F.col("y") / 1e4).alias("lon"))
    return sinks.ground_truth_json(fixes, "user_id", 12)


@query()
def k14_position_report(spark, sf_dir):
    routes = tracks(spark, sf_dir).select("user_id", "seq", (48 + F.col("x") / 1e4).alias("lat"), (9 + F.col("y") / 1e4).alias("lon"))
    return sinks.position_report(routes, "user_id")


SKY = """cols as (select l_orderkey as k, l_linenumber as c, l_quantity / 5 as m, (l_quantity + l_linenumber) / 5 as f from lineitem)"""


@query(f"""with {SKY}, d as (select k, f - m as d, abs(f - m) <= 1.0 as explained, f - m > 3.0 as contradicts, m > 0.5 as shared from cols)
select k, round(avg(case when shared then 1.0 else 0.0 end), 6) as shared_frac, round(avg(case when shared and explained then 1.0 else 0.0 end), 6) as explain_frac,
  round(avg(case when contradicts then 1.0 else 0.0 end), 6) as contradiction_frac, round(coalesce(stddev_pop(d), 0), 6) as spread, round(exp(-median(abs(d)) / 3), 6) as score from d group by k""")
def a27_skyline_compare(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("c"), (F.col("l_quantity") / 5).alias("model"), ((F.col("l_quantity") + F.col("l_linenumber")) / 5).alias("frame"))
    out = K.compare_skylines(li, ["k"], 1.0, 3.0, 0.5)
    return out.select("k", *[F.round(c, 6).alias(c) for c in ("shared_frac", "explain_frac", "contradiction_frac", "spread", "score")])


@query("""with m as (select user_id, event_id % 40 as col, event_id % 30 as row from events) select user_id, col, min(row) as sky_row, round(degrees(atan2(15.0 - min(row), 25.0)), 6) as elevation from m group by all""")
def x38_skyline_from_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("col"), (F.col("event_id") % 30).alias("row"))
    return K.skyline_from_mask(e, ["user_id"], 15.0, 25.0).withColumn("elevation", F.round("elevation", 6))


@query("""select event_id, case when v > 15 then round((u - 20) / 25.0 * (1.5 * 25 / (v - 15)), 6) end as right_m, case when v > 15 then round(1.5 * 25 / (v - 15), 6) end as forward_m
from (select event_id, event_id % 40 as u, event_id % 30 as v from events)""")
def x25_image_to_ground(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 40).alias("u"), (F.col("event_id") % 30).alias("v"))
    right, forward = K.image_to_ground(F.col("u"), F.col("v"), 25.0, 20.0, 15.0, 1.5, 0.0)
    return e.select("event_id", F.round(right, 6).alias("right_m"), F.round(forward, 6).alias("forward_m"))
