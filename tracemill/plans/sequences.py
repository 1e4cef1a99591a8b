"""Registered queries: ordered tracks and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions.geo import round_half_away
from tracemill.operators import sequence as S
from tracemill.plans.tables import STEPS, TRACKS, query, resampled, table, tracks, wrapped

HEADINGS = f"""headings as (
  select user_id, seq, case when seq > 0 then atan2(dy, dx) end as h from arc
), deltas as (
  select user_id, seq, {wrapped('lead(h) over w - h')} as delta from headings window w as (partition by user_id order by seq)
  qualify lead(h) over w is not null and h is not null
)"""


@query(f"with {STEPS} select user_id, seq, round(s, 6) as s from arc")
def x01_arc_length(spark, sf_dir):
    return S.arc_length(tracks(spark, sf_dir), "user_id").select("user_id", "seq", F.round("s", 6).alias("s"))


@query(f"with {STEPS}, {resampled(16)} select user_id, seq, round(x, 6) as x, round(y, 6) as y from points")
def x02_resample_uniform(spark, sf_dir):
    return S.resample_uniform(tracks(spark, sf_dir), "user_id", 16).select("user_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"with {STEPS}, {HEADINGS} select user_id, seq, round(delta, 9) as delta from deltas")
def x03_heading_deltas(spark, sf_dir):
    return S.heading_deltas(tracks(spark, sf_dir), "user_id").select("user_id", "seq", round_half_away("delta", 9).alias("delta"))


@query(f"""with {STEPS}, {resampled(32)}, moves as (
  select user_id, seq, atan2(y - lag(y) over w, x - lag(x) over w) as h from points window w as (partition by user_id order by seq)
) select user_id, seq, round({wrapped('lead(h) over w - h')}, 6) as delta from moves window w as (partition by user_id order by seq) qualify lead(h) over w is not null and h is not null""")
def x03_bearing_signature(spark, sf_dir):
    return S.bearing_signature(tracks(spark, sf_dir), "user_id", 32).select("user_id", "seq", F.round("delta", 6).alias("delta"))


@query(f"with {STEPS}, {HEADINGS} select user_id, seq, round(sum(delta) over (partition by user_id order by seq rows between 8 preceding and 8 following), 8) as turn from deltas")
def w03_windowed_turn(spark, sf_dir):
    return S.windowed_turn(tracks(spark, sf_dir), "user_id").select("user_id", "seq", round_half_away("turn", 8).alias("turn"))


@query(f"""with {TRACKS}, sizes as (select user_id, max(seq) + 1 as n from tracks group by user_id), starts as (
  select user_id, n, unnest(range(0, greatest(n - 24, 0) + 1, 12)) as start from sizes
  union select user_id, n, greatest(n - 24, 0) from sizes
) select t.user_id, cast(s.start as int) as start, count(*) as n_rows, min(t.seq) as first_seq, round(avg(t.x), 6) as mean_x
  from starts s join tracks t on t.user_id = s.user_id and t.seq >= s.start and t.seq < s.start + 24 group by t.user_id, s.start""")
def w05_hopping_windows(spark, sf_dir):
    rows = S.hopping_windows(tracks(spark, sf_dir), "user_id", 24, 12)
    return rows.groupBy("user_id", "start").agg(F.count("*").alias("n_rows"), F.min("seq").cast("long").alias("first_seq"), F.round(F.avg("x"), 6).alias("mean_x"))


@query(f"""with {STEPS}, ends as (
  select user_id, max(s) as total, arg_min(x, seq) as x0, arg_min(y, seq) as y0, arg_max(x, seq) as x1, arg_max(y, seq) as y1 from arc group by user_id
) select a.user_id, a.seq, round(a.x - coalesce(a.s / nullif(e.total, 0), 0) * (e.x1 - e.x0), 6) as x, round(a.y - coalesce(a.s / nullif(e.total, 0), 0) * (e.y1 - e.y0), 6) as y
  from arc a join ends e using (user_id)""")
def x11_drift_ramp(spark, sf_dir):
    return S.drift_ramp(tracks(spark, sf_dir), "user_id").select("user_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""with {STEPS}, sums as (select user_id, sum(step * sin(atan2(dx, dy))) as a, sum(step * cos(atan2(dx, dy))) as b from arc group by user_id)
select user_id, round(degrees(atan2(a, b)) - 360 * floor(degrees(atan2(a, b)) / 360), 6) as bearing from sums""")
def x47_mean_bearing(spark, sf_dir):
    steps = S.with_steps(tracks(spark, sf_dir), "user_id")
    h = F.atan2("dx", "dy")
    sums = steps.groupBy("user_id").agg(F.sum(F.col("step") * F.sin(h)).alias("a"), F.sum(F.col("step") * F.cos(h)).alias("b"))
    return sums.select("user_id", F.round(F.pmod(F.degrees(F.atan2("a", "b")), F.lit(360.0)), 6).alias("bearing"))


@query(f"""with {STEPS}, turns as (
  select user_id, (dx * lag(dx) over w + dy * lag(dy) over w) / nullif(step * lag(step) over w, 0) as c from arc window w as (partition by user_id order by seq)
) select user_id, round(avg(case when c < -0.5 then 1.0 else 0.0 end), 9) as reversal_share, avg(case when c < -0.5 then 1.0 else 0.0 end) <= 0.15 as plausible from turns where c is not null group by user_id""")
def f09_reversal_share(spark, sf_dir):
    w = S.ordered("user_id")
    steps = S.with_steps(tracks(spark, sf_dir), "user_id")
    c = F.try_divide(F.col("dx") * F.lag("dx").over(w) + F.col("dy") * F.lag("dy").over(w), F.col("step") * F.lag("step").over(w))
    share = F.avg(F.when(F.col("c") < -0.5, 1.0).otherwise(0.0))
    return steps.withColumn("c", c).where("c is not null").groupBy("user_id").agg(F.round(share, 9).alias("reversal_share"), (share <= 0.15).alias("plausible"))


@query(f"""with {TRACKS}, pairs as (
  select p.user_id, p.event_id as probe_id, v.event_id as nearest_id, abs(v.t_sec - p.t_sec) as gap,
         row_number() over (partition by p.user_id, p.event_id order by abs(v.t_sec - p.t_sec), v.event_id) as k
  from tracks p join tracks v on p.user_id = v.user_id and p.event_type = 'purchase' and v.event_type = 'view'
) select user_id, probe_id, nearest_id, round(gap, 6) as gap from pairs where k = 1""")
def j09_nearest_in_time(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    found = S.nearest_in_time(rows.where("event_type = 'purchase'"), rows.where("event_type = 'view'"), "user_id", "t_sec", "event_id")
    return found.withColumn("gap", F.round("gap", 6))


@query(f"""with {TRACKS}, n as (select user_id, max(seq) as last from tracks group by user_id)
select user_id, event_id from tracks join n using (user_id) where last < 10 or seq in (select unnest(list_transform(range(10), lambda i: i * last // 9)))""")
def v14_linspace_truncated(spark, sf_dir):
    return S.linspace_truncated(tracks(spark, sf_dir), "user_id", 10).select("user_id", "event_id")


@query(f"""with {TRACKS}, n as (select user_id, max(seq) as last from tracks group by user_id)
select user_id, event_id from tracks join n using (user_id) where last < 10 or list_contains(list_transform(range(10), lambda i: cast(round_even(i * last / 9.0, 0) as bigint)), seq)""")
def v15_linspace_rounded(spark, sf_dir):
    return S.linspace_rounded(tracks(spark, sf_dir), "user_id", 10).select("user_id", "event_id")


@query("select p_partkey, p_name from part order by sha1(cast(p_partkey as varchar)), p_partkey limit 50")
def v16_hash_threshold_sample(spark, sf_dir):
    return S.hash_threshold_sample(table(spark, sf_dir, "part"), "p_partkey", 50).select("p_partkey", "p_name")


@query(f"with {TRACKS} select user_id, event_id from tracks qualify seq % 7 = 0 or seq = max(seq) over (partition by user_id)")
def x32_every_nth(spark, sf_dir):
    return S.every_nth(tracks(spark, sf_dir), "user_id", 7).select("user_id", "event_id")


@query(f"""with {TRACKS}, spans as (select *, min(t_sec) over (partition by user_id) as lo, max(t_sec) over (partition by user_id) as hi from tracks), strata as (
  select *, least(5, cast(floor(coalesce((t_sec - lo) / nullif(hi - lo, 0), 0) * 6) as int)) as bucket from spans
), turns as (select *, row_number() over (partition by user_id, bucket order by x desc, event_id) as turn from strata)
select user_id, event_id, cast(bucket as int) as bucket, cast(row_number() over (partition by user_id order by turn, bucket) as int) as pick from turns qualify pick <= 12""")
def o14_time_strata(spark, sf_dir):
    return S.time_strata(tracks(spark, sf_dir), "user_id", "t_sec", "x", "event_id", 6, 12).select("user_id", "event_id", "bucket", "pick")
