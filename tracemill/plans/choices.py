"""Registered queries: acceptance gates, run parameters, small set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import gates as C
from tracemill.functions import geo as G
from tracemill.operators import ranking as R
from tracemill.operators import sequence as S
from tracemill.plans.tables import STEPS, TRACKS, query, table, tracks
from tracemill.plans.texts import sql_haversine

RESIDUALS = "residuals as (select event_id, case when event_id % 7 = 0 then 'nan'::double when event_id % 11 = 0 then 'inf'::double else value end as r from events)"


@query(f"with {RESIDUALS} select event_id, r from residuals where isfinite(r)")
def f05_finite_residuals(spark, sf_dir):
    k = F.col("event_id")
    r = F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(k, r.alias("r")).where(C.finite(F.col("r")))


SPOTS = "spots as (select c_custkey as id, c_nationkey as k, 48 + (c_custkey * 37 % 1000) / 1000.0::double as lat, 9 + (c_custkey * 91 % 1000) / 1000.0::double as lon, c_acctbal as w from customer)"
SITES = "sites as (select s_suppkey as id, s_nationkey as k, 48 + (s_suppkey * 53 % 1000) / 1000.0::double as lat, 9 + (s_suppkey * 29 % 1000) / 1000.0::double as lon from supplier)"


def spots(spark, sf_dir):
    """Customers as places: id, k, lat, lon, w."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(k.alias("id"), F.col("c_nationkey").alias("k"), (48 + k * 37 % 1000 / 1000.0).alias("lat"), (9 + k * 91 % 1000 / 1000.0).alias("lon"), F.col("c_acctbal").alias("w"))


def sites(spark, sf_dir):
    """Suppliers as places: id, k, lat, lon."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("id"), F.col("s_nationkey").alias("k"), (48 + k * 53 % 1000 / 1000.0).alias("lat"), (9 + k * 29 % 1000 / 1000.0).alias("lon"))


@query(f"""with {SPOTS}, {SITES}, boxes as (select k, min(lat) as s, min(lon) as w0, max(lat) as n, max(lon) as e from sites group by k)
select p.id from spots p join boxes b using (k) where p.lat between s - 0.02 and n + 0.02 and p.lon between w0 - 0.02 and e + 0.02""")
def f06_inside_graph_box(spark, sf_dir):
    box = sites(spark, sf_dir).groupBy("k").agg(F.min("lat").alias("s"), F.min("lon").alias("w0"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    met = spots(spark, sf_dir).join(box, "k")
    return met.where(C.inside_box(*map(F.col, ("lat", "lon", "s", "w0", "n", "e")), margin=0.02)).select("id")


def sql_near_prior(most: int) -> str:
    return f"""with {SPOTS}, {SITES}, prior as (select k, median(lat) as a, median(lon) as b from sites group by k)
select id, round({sql_haversine('a', 'b', 'lat', 'lon')}, 3) as metres from spots join prior using (k) where {sql_haversine('a', 'b', 'lat', 'lon')} <= {most}"""


def _near_prior(spark, sf_dir, most):
    prior = sites(spark, sf_dir).groupBy("k").agg(F.median("lat").alias("a"), F.median("lon").alias("b"))
    return spots(spark, sf_dir).join(prior, "k").select("id", F.round(G.haversine_m("a", "b", "lat", "lon"), 3).alias("metres")).where(F.col("metres") <= most)


@query(sql_near_prior(1500))
def f10_near_prior(spark, sf_dir):
    return _near_prior(spark, sf_dir, 1500)


@query(sql_near_prior(15000))
def f21_inside_city(spark, sf_dir):
    return _near_prior(spark, sf_dir, 15000)


@query(f"""with {TRACKS}, seen as (select user_id, event_id, t_sec, y % 3 = 0 as direction from tracks where event_type = 'click'), met as (
  select a.user_id, a.event_id, d.direction, row_number() over (partition by a.event_id order by abs(a.t_sec - d.t_sec), d.event_id) as n from tracks a join seen d using (user_id) where a.event_type <> 'click'
) select user_id, event_id from tracks where event_type <> 'click' and event_id not in (select event_id from met where n = 1 and direction)""")
def f11_drop_direction_anchors(spark, sf_dir):
    """Anchors whose nearest detection in time is a direction sign are dropped; without detections all stay."""
    rows = tracks(spark, sf_dir)
    anchors, seen = rows.where("event_type <> 'click'"), rows.where("event_type = 'click'")
    near = S.nearest_in_time(anchors, seen, "user_id", "t_sec", "event_id")
    signs = seen.where("y % 3 = 0").select(F.col("event_id").alias("nearest_id"))
    dropped = near.join(signs, "nearest_id", "left_semi").select(F.col("probe_id").alias("event_id"))
    return anchors.join(dropped, "event_id", "left_anti").select("user_id", "event_id")


@query("""with m as (select o_custkey as k, median(case when o_orderstatus = 'F' then o_totalprice end) / 500000 as a, median(case when o_orderstatus <> 'F' then o_totalprice end) / 500000 as b, min(o_totalprice) / 1000 as moved from orders group by o_custkey)
select k, b >= a - 0.02 as second_pass, b <= 1.1 * a and moved <= 100 as refined, case when a > 0 and b / a between 0.33 and 3.0 and abs(b / a - 1) > 0.15 and b < 0.9 * a then 'other' else 'base' end as scale from m where a is not null and b is not null""")
def f14_two_pass_gates(spark, sf_dir):
    """Whether a second search, a refined place, another scale replaces the first."""
    f, p = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.median(F.when(f, p)) / 500000).alias("a"), (F.median(F.when(~f, p)) / 500000).alias("b"), (F.min(p) / 1000).alias("moved"))
    m = m.where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    other = F.coalesce(C.scale_arbitrated(a, b, F.try_divide(b, a)), F.lit(False))
    return m.select("k", C.second_pass_accepted(a, b).alias("second_pass"), C.refinement_accepted(a, b, F.col("moved")).alias("refined"), F.when(other, "other").otherwise("base").alias("scale"))


@query(f"""with {TRACKS}, b as (select user_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from tracks group by user_id)
select user_id, x0 <= 60 and 20 <= x1 and y0 <= 40 and 10 <= y1 as meets from b""")
def f17_line_meets_window(spark, sf_dir):
    b = tracks(spark, sf_dir).groupBy("user_id").agg(*[f(c).alias(f"{c}{i}") for i, f in enumerate((F.min, F.max)) for c in "xy"])
    meets = C.boxes_meet(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), tuple(map(F.lit, (20, 10, 60, 40))))
    return b.select("user_id", meets.alias("meets"))


@query("""select s_suppkey as id, substr(sha1('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}'), 1, 10) as tag from supplier""")
def f19_signature(spark, sf_dir):
    """A cache entry is valid while the fingerprint of what it was made from is the same."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), C.fingerprint("s_suppkey", "s_name").alias("tag"))


@query("""with c as (select l_orderkey as clip, l_linenumber as walk, l_discount * 10 as coverage, l_tax as score, l_returnflag <> 'R' as ok from lineitem)
select clip, min(coverage) >= 0.2 as mesh, max(score) > 0 as active, sum(ok::int) >= greatest(2, floor(0.8 * count(*))) as broad from c group by clip""")
def f22_channel_gates(spark, sf_dir):
    """all walks covered, some score above zero, enough scored candidates."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip"))
    ok = F.sum((F.col("l_returnflag") != "R").cast("int"))
    return rows.agg((F.min(F.col("l_discount") * 10) >= 0.2).alias("mesh"), (F.max("l_tax") > 0).alias("active"), (ok >= F.greatest(F.lit(2), F.floor(0.8 * F.count("*")))).alias("broad"))


@query("""with p as (select p_partkey as id, case p_partkey % 5 when 0 then ' EPSG:32632 ' when 1 then '  ' when 2 then 'None' when 3 then null else p_brand end as crs from part)
select id, case when trim(crs) <> '' and lower(trim(crs)) <> 'none' then trim(crs) end as crs from p""")
def f25_usable_crs(spark, sf_dir):
    k = F.col("p_partkey") % 5
    crs = F.when(k == 0, " EPSG:32632 ").when(k == 1, "  ").when(k == 2, "None").when(k == 3, None).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.usable_crs(crs).alias("crs"))


@query(f"""with {TRACKS}, n as (select user_id, count(*) as n, max(t_sec) as d from tracks group by user_id)
select user_id, greatest(64, least(64 + 11 * 16, n)) as size, cast(greatest(3, ceil(d * 30 / 4800)) as bigint) as stride from n""")
def w06_auto_sizes(spark, sf_dir):
    """Resample size by the number of windows, stride by the number of frames."""
    n = tracks(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("t_sec").alias("d"))
    return n.select("user_id", C.resample_size(64, 16, F.col("n")).alias("size"), C.frame_stride(F.col("d"), 30.0).alias("stride"))


@query(f"""with {TRACKS}, r as (select user_id, seq, x, row_number() over (partition by user_id order by seq) as a, row_number() over (partition by user_id order by seq desc) as b, count(*) over (partition by user_id) as n from tracks)
select user_id, seq, a <= greatest(5, n // 16) as head, b <= greatest(5, n // 16) as tail from r where a <= greatest(5, n // 16) or b <= greatest(5, n // 16)""")
def w09_track_ends(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("user_id"))
    k = F.greatest(F.lit(5).cast("long"), F.floor(n / 16))
    ends = rows.withColumn("head", F.row_number().over(S.ordered("user_id")) <= k).withColumn("tail", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seq"))) <= k)
    return ends.where("head or tail").select("user_id", "seq", "head", "tail")


@query("""with p as (select l_orderkey as o, l_linenumber as l, l_partkey % 300 as i, l_suppkey % 300 + 100 as j, 400 + l_linenumber as nf, 50 + l_orderkey % 400 as np from lineitem),
m as (select *, case when nf = np then i else cast(round_even(i * ((np - 1) / (nf - 1)), 0) as bigint) end as a, case when nf = np then j else cast(round_even(j * ((np - 1) / (nf - 1)), 0) as bigint) end as b from p)
select o, l, case when 0 <= a and a < b and b < np then a end as i, case when 0 <= a and a < b and b < np then b end as j from m""")
def x12_remap_frame_pair(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    pair = C.remap_pair(F.col("l_partkey") % 300, F.col("l_suppkey") % 300 + 100, (400 + n).cast("long"), 50 + o % 400)
    return li.withColumn("p", pair).select(o.alias("o"), n.alias("l"), "p.i", "p.j")


@query(f"""with {TRACKS}, s as (select user_id, min(t_sec) as a, max(t_sec) as b, count(*) as n from tracks group by user_id having count(*) > 1)
select user_id, i, round(a + (b - a) * i / 39.0, 6) as t from s, range(40) r(i)""")
def x13_spread_timestamps(spark, sf_dir):
    """The clip's time span spread over the rows of a pose track of another length."""
    span = tracks(spark, sf_dir).groupBy("user_id").agg(F.min("t_sec").alias("a"), F.max("t_sec").alias("b"), F.count("*").alias("n")).where("n > 1")
    return span.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("i"), "a", "b").select("user_id", "i", F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / 39.0, 6).alias("t"))


@query(f"""with {STEPS}, v as (select user_id, seq, t_sec, s, lead(t_sec) over w as t2, lead(s) over w as s2, max(s) over (partition by user_id) as total from arc window w as (partition by user_id order by seq)),
ends as (select user_id, min(t_sec) as a, max(t_sec) as b, max(s) as total from arc group by user_id having max(s) > 1e-9), q as (select user_id, i, a + (b - a) * i / 20.0 as t, total from ends, range(21) r(i))
select q.user_id, q.i, round(least(1, greatest(0, (v.s + case when v.t2 > v.t_sec then (q.t - v.t_sec) / (v.t2 - v.t_sec) else 0 end * (coalesce(v.s2, v.s) - v.s)) / q.total)), 6) as fraction
from q join v on v.user_id = q.user_id and v.t_sec <= q.t qualify row_number() over (partition by q.user_id, q.i order by v.seq desc) = 1""")
def x14_arc_fractions(spark, sf_dir):
    """Share of a track's length run at each of 21 times between its ends."""
    arc = S.arc_length(tracks(spark, sf_dir), "user_id")
    ends = arc.groupBy("user_id").agg(F.min("t_sec").alias("a"), F.max("t_sec").alias("b"), F.max("s").alias("total")).where("total > 1e-9")
    times = ends.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long")))).withColumn("t", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / 20.0)
    return S.arc_fraction_at(arc, times, "user_id").select("user_id", "i", F.round("fraction", 6).alias("fraction"))


@query(f"""with {STEPS}, v as (select user_id, seq, s, x, y, lead(s) over w as s2, lead(x) over w as x2, lead(y) over w as y2, max(s) over (partition by user_id) as total from arc window w as (partition by user_id order by seq)),
q as (select distinct user_id, i, total * i / 10.0 as at from v, range(1, 10) r(i) where total > 1e-9)
select q.user_id, q.i, round(v.x + (q.at - v.s) / (v.s2 - v.s) * (v.x2 - v.x), 5) as x, round(v.y + (q.at - v.s) / (v.s2 - v.s) * (v.y2 - v.y), 5) as y, round((v.x2 - v.x) / (v.s2 - v.s), 5) as dx, round((v.y2 - v.y) / (v.s2 - v.s), 5) as dy
from q join v on v.user_id = q.user_id and v.s <= q.at and v.s2 > q.at""")
def x15_pose_at_fraction(spark, sf_dir):
    """Place and direction of the segment at each tenth of a track's length."""
    arc = S.arc_length(tracks(spark, sf_dir), "user_id")
    total = arc.groupBy("user_id").agg(F.max("s").alias("total")).where("total > 1e-9")
    spots_ = total.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long")))).withColumn("at", F.col("total") * F.col("i") / 10.0)
    return S.pose_at(arc, spots_, "user_id").select("user_id", "i", *[F.round(c, 5).alias(c) for c in ("x", "y", "dx", "dy")])


@query(f"with {STEPS}, l as (select user_id, max(s) as total from arc group by user_id) select t.user_id, t.seq, round(1.5 * (cos(0.3) * x - sin(0.3) * y) + 7, 6) as x, round(1.5 * (sin(0.3) * x + cos(0.3) * y) - 4, 6) as y, round(1.5 * total, 5) as length from tracks t join l using (user_id)")
def x17_apply_similarity(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    length = S.arc_length(rows, "user_id").groupBy("user_id").agg(F.max("s").alias("total"))
    c, s = 1.5 * F.cos(F.lit(0.3)), 1.5 * F.sin(F.lit(0.3))
    moved = rows.join(length, "user_id")
    return moved.select("user_id", "seq", F.round(c * F.col("x") - s * F.col("y") + 7, 6).alias("x"), F.round(s * F.col("x") + c * F.col("y") - 4, 6).alias("y"), F.round(1.5 * F.col("total"), 5).alias("length"))


@query(f"""with {SITES}, d as (select id, lat, lon, 300.0 + id % 9 * 400 as r from sites), g as (select id, lat, lon, r, i - 6 as i, j - 6 as j from d, range(13) a(i), range(13) b(j) where r > 700 * 1.3)
select id, lat, lon from (select id, round(lat, 8) as lat, round(lon, 8) as lon from d where r <= 700 * 1.3
union all select id, round(lat + i * 980 / 111320.0, 8), round(lon + j * 980 / (111320.0 * greatest(0.2, cos(radians(lat)))), 8) from g where abs(i) <= ceil(r / 980) and abs(j) <= ceil(r / 980) and sqrt((i * 980) ** 2 + (j * 980) ** 2) <= r + 700)""")
def x24_sub_discs(spark, sf_dir):
    d = sites(spark, sf_dir).select("id", "lat", "lon", (300.0 + F.col("id") % 9 * 400).alias("r"))
    return G.sub_discs(d, "r", 700.0).select("id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query(f"""with {TRACKS}, n as (select user_id, max(seq) as last from tracks group by user_id), spots as (select distinct user_id, cast(round_even(last * i / 49.0, 0) as bigint) as seq from n, range(50) r(i) where last >= 50 union select user_id, unnest(range(last + 1)) from n where last < 50)
select user_id, seq, x, y from tracks join spots using (user_id, seq)""")
def x31_route_sample(spark, sf_dir):
    """At most 50 vertices of a route, both ends among them."""
    return S.linspace_rounded(tracks(spark, sf_dir), "user_id", 50).select("user_id", "seq", "x", "y")


@query(f"""with {TRACKS}, v as (select user_id, event_id, row_number() over (partition by user_id order by seq) - 1 as seq from tracks where event_type <> 'error'), n as (select user_id, max(seq) as last from v group by user_id),
spots as (select distinct user_id, cast(floor(last * i / 11.0) as bigint) as seq from n, range(12) r(i) where last >= 12 union select user_id, unnest(range(last + 1)) from n where last < 12)
select user_id, event_id from v join spots using (user_id, seq)""")
def x33_keyframes(spark, sf_dir):
    """Evenly spaced rows among the valid ones."""
    valid = tracks(spark, sf_dir).where("event_type <> 'error'").withColumn("seq", (F.row_number().over(S.ordered("user_id")) - 1).cast("long"))
    return S.linspace_truncated(valid, "user_id", 12).select("user_id", "event_id")


@query(f"with {TRACKS} select user_id, round(avg(48 + y / 1000), 8) as lat, round(avg(9 + x / 1000), 8) as lon from tracks group by user_id")
def x43_candidate_center(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg(48 + F.col("y") / 1000), 8).alias("lat"), F.round(F.avg(9 + F.col("x") / 1000), 8).alias("lon"))


@query("""with i as (select p_partkey as id, 480 + p_size * 16 as h, case p_partkey % 3 when 0 then 'top' when 1 then 'bottom' else 'full' end as region from part)
select id, cast(case when region = 'bottom' then h - greatest(1, floor(h * 0.18)) else 0 end as bigint) as first, cast(case when region = 'top' then greatest(1, floor(h * 0.18)) else h end as bigint) as last from i""")
def x49_region_crop(spark, sf_dir):
    k = F.col("p_partkey")
    region = F.when(k % 3 == 0, "top").when(k % 3 == 1, "bottom").otherwise("full")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), (480 + F.col("p_size") * 16).cast("long").alias("h"), region.alias("region"))
    first, last = C.region_rows(F.col("h"), F.col("region"))
    return rows.select("id", first.cast("long").alias("first"), last.cast("long").alias("last"))


@query("""with r as (select 'a' as source, c_custkey as ref, c_nationkey as k from customer union all select 'b', s_suppkey, s_nationkey from supplier), n as (select k, source from r group by k, source having count(*) >= 5) select r.k, r.source, r.ref from r join n using (k, source)""")
def u02_pooled_references(spark, sf_dir):
    """References of all sources that have at least five in a region; sources are not deduplicated against each other."""
    a = table(spark, sf_dir, "customer").select(F.lit("a").alias("source"), F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.lit("b").alias("source"), F.col("s_suppkey").alias("ref"), F.col("s_nationkey").alias("k"))
    pool = a.unionByName(b)
    enough = pool.groupBy("k", "source").count().where("count >= 5").select("k", "source")
    return pool.join(enough, ["k", "source"]).select("k", "source", "ref")


@query("""select c_custkey as ref from customer except select o_custkey from orders where o_orderstatus = 'F' and o_totalprice < 200000""")
def u06_references_to_fetch(spark, sf_dir):
    """Wanted references without those in store."""
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice < 200000").select("o_custkey")
    return table(spark, sf_dir, "customer").join(stored, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("ref")).distinct()


@query("""with a as (select o_custkey as k, o_orderkey as c, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders),
b as (select o_custkey as k, o_orderkey as c, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders)
select k, c, cast(n as bigint) as ord from a where n <= 5 union all select b.k, b.c, 5 + row_number() over (partition by b.k order by b.n) from b where not exists (select 1 from a where a.k = b.k and a.c = b.c and a.n <= 5)""")
def u07_pool_with_tail(spark, sf_dir):
    """The best five candidates, then the others in the order of another criterion."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("c"), "o_totalprice", "o_orderdate")
    rows = o.withColumn("n", R.rank_by("k", F.desc("o_totalprice"), "c"))
    tail = rows.where("n > 5").withColumn("n", 5 + R.rank_by("k", "o_orderdate", "c"))
    return rows.where("n <= 5").unionByName(tail).select("k", "c", F.col("n").cast("long").alias("ord"))


@query(f"""with {TRACKS}, n as (select user_id, max(seq) as last from tracks group by user_id), heads as (select user_id, seq from tracks join n using (user_id) where seq < 4), tails as (select user_id, seq from tracks join n using (user_id) where seq > last - 4)
select distinct h.user_id, h.seq as i, t.seq as j from heads h join tails t on t.user_id = h.user_id and h.seq + 8 <= t.seq""")
def u08_loop_pairs(spark, sf_dir):
    """Frame pairs from a track's first to its last four rows that lie apart, each once."""
    ends = tracks(spark, sf_dir).withColumn("last", F.max("seq").over(Window.partitionBy("user_id")))
    heads = ends.where("seq < 4").select("user_id", F.col("seq").alias("i"))
    tails = ends.where("seq > last - 4").select("user_id", F.col("seq").alias("j"))
    return heads.join(tails, "user_id").where("i + 8 <= j").distinct()


TITLES = """titles as (select c_custkey as id, case c_custkey % 8 when 0 then '4K Driving in Ulm, Germany ' || c_custkey when 1 then 'Paris dashcam ' || c_name when 2 then 'Tokyo night drive' when 3 then 'Scenic views (Neu Ulm, Bavaria)'
  when 4 then 'Best Dashcam walk' when 5 then 'no city at all' when 6 then 'walk   through São Paulo – part ' || c_custkey else null end as title, c_custkey % 8 as f from customer)"""


@query(f"with {TITLES} select id, case f when 0 then 'Ulm, Germany' when 1 then 'Paris' when 2 then 'Tokyo' when 3 then 'Neu Ulm' when 6 then 'São Paulo' end as guess, coalesce(case when id % 5 = 0 then 'Wien' end, case f when 0 then 'Ulm, Germany' when 1 then 'Paris' when 2 then 'Tokyo' when 3 then 'Neu Ulm' when 6 then 'São Paulo' end, 'Ulm') as city from titles")
def t08_city_from_title(spark, sf_dir):
    """The city a title names; an explicit one goes first, a default last."""
    k = F.col("c_custkey")
    f = k % 8
    title = (
        F.when(f == 0, F.concat(F.lit("4K Driving in Ulm, Germany "), k)).when(f == 1, F.concat(F.lit("Paris dashcam "), "c_name")).when(f == 2, "Tokyo night drive").when(f == 3, "Scenic views (Neu Ulm, Bavaria)")
        .when(f == 4, "Best Dashcam walk").when(f == 5, "no city at all").when(f == 6, F.concat(F.lit("walk   through São Paulo – part "), k))
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), C.city_of_title(title).alias("guess"))
    return rows.withColumn("city", F.coalesce(F.when(F.col("id") % 5 == 0, "Wien"), "guess", F.lit("Ulm")))


@query("""with b as (select l_orderkey as o, l_linenumber as l, l_partkey % 500 as x0, l_suppkey % 300 as y0, l_partkey % 500 + 20 + l_linenumber as x1, l_suppkey % 300 + 10 as y1 from lineitem)
select o, l, x0, y0, x1, y1, cast(greatest(0, floor(x0 - (x1 - x0) * 0.6)) as bigint) as cx0, cast(greatest(0, floor(y0 - (y1 - y0) * 0.6)) as bigint) as cy0, cast(least(512, ceil(x1 + (x1 - x0) * 0.6)) as bigint) as cx1, cast(least(300, ceil(y1 + (y1 - y0) * 0.6)) as bigint) as cy1 from b""")
def t17_boxes_and_crops(spark, sf_dir):
    """The box of a text's polygon, and the crop around it."""
    x, y, w = F.col("l_partkey") % 500, F.col("l_suppkey") % 300, 20 + F.col("l_linenumber")
    corners = F.array(*[F.struct((x + dx).cast("long").alias("x"), (y + dy).cast("long").alias("y")) for dx, dy in ((0, 10), (w, 0), (w, 10), (0, 0))])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), C.box_of_polygon(corners).alias("b"))
    rows = rows.withColumn("c", C.crop_box(F.col("b"), F.lit(512), F.lit(300), 0.6))
    return rows.select("o", "l", "b.*", *[F.col(f"c.{n}").alias(f"c{n}") for n in ("x0", "y0", "x1", "y1")])


@query("select p_partkey as id, 'name' || p_size as local from part")
def t19_local_name(spark, sf_dir):
    tag = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("{http://www.opengis.net/gml}name"), "p_size")).otherwise(F.concat(F.lit("name"), "p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.local_name(tag).alias("local"))


@query("""select s_suppkey as id, case s_suppkey % 4 when 0 then 'Ulm' when 1 then 'Berlin' when 2 then 'München' end as district from supplier""")
def t20_districts(spark, sf_dir):
    """The district of a plate's code by a dictionary, null for codes it lacks."""
    k = F.col("s_suppkey") % 4
    code = F.when(k == 0, "UL").when(k == 1, "B").when(k == 2, "M").otherwise("XX")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.try_element_at(C.districts({"UL": "Ulm", "B": "Berlin", "M": "München"}), code).alias("district"))


@query("""select p_partkey as id, case p_partkey % 5 when 0 then 'transit' when 1 then 'transit' when 2 then 'poi' when 3 then 'housename' end as kind from part""")
def t21_feature_kind(spark, sf_dir):
    from tracemill.functions.text import feature_kind

    k = F.col("p_partkey") % 5
    tag = lambda on, key, value: F.when(on, F.create_map(F.lit(key), value))
    tags = F.coalesce(tag(k == 0, "highway", F.lit("bus_stop")), tag(k == 1, "railway", F.lit("station")), tag(k == 2, "name", F.col("p_name")), tag(k == 3, "addr:housename", F.col("p_name")), F.create_map(F.lit("other"), F.lit("x")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), feature_kind(tags).alias("kind"))


@query("""with f as (select o_custkey as k, o_orderkey as c, o_totalprice as p from orders), near as (select * from f where p < 50000) select k, c from near union all select k, c from f where k not in (select k from near)""")
def g05_gate_fallback(spark, sf_dir):
    """Candidates behind a gate; all of them where the gate leaves none."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("c"), (F.col("o_totalprice") < 50000).alias("near"))
    some = F.max("near").over(Window.partitionBy("k"))
    return rows.withColumn("some", some).where("near or not some").select("k", "c")


@query("""with a as (select l_orderkey as clip, avg(l_quantity) as v from lineitem where l_returnflag = 'R' group by l_orderkey), m as (select l_orderkey as clip, avg(l_quantity) as v from lineitem group by l_orderkey)
select m.clip, round(coalesce(a.v, m.v), 6) as position, case when a.v is null then 'matcher' else 'anchored' end as source from m left join a using (clip)""")
def k15_headline_report(spark, sf_dir):
    """The anchored report where there is one, else the matcher's."""
    q = F.col("l_quantity")
    both = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip")).agg(F.avg(F.when(F.col("l_returnflag") == "R", q)).alias("a"), F.avg(q).alias("m"))
    return both.select("clip", F.round(F.coalesce("a", "m"), 6).alias("position"), F.when(F.col("a").isNull(), "matcher").otherwise("anchored").alias("source"))


@query("""with f as (select p_partkey % 400 as stem, p_partkey as id, p_size as size, case p_partkey % 4 when 0 then 'marker' when 1 then 'mp4' when 2 then 'webm' else 'part' end as ext from part)
select stem, id, ext from f where ext <> 'part' qualify row_number() over (partition by stem order by case ext when 'marker' then 0 when 'mp4' then 1 else 2 end, id) = 1""")
def s04_resume_lookup(spark, sf_dir):
    """The file to resume a download from: its marker, else an .mp4, else any that is no intermediate."""
    k = F.col("p_partkey")
    ext = F.when(k % 4 == 0, "marker").when(k % 4 == 1, "mp4").when(k % 4 == 2, "webm").otherwise("part")
    files = table(spark, sf_dir, "part").select((k % 400).alias("stem"), k.alias("id"), ext.alias("ext")).where("ext <> 'part'")
    order = F.when(F.col("ext") == "marker", 0).when(F.col("ext") == "mp4", 1).otherwise(2)
    return R.best_per(files, "stem", order, "id").select("stem", "id", "ext")


@query("""with w as (select o_custkey as k, count(*) as refs, count(*) filter (where o_orderstatus <> 'P') as stored from orders group by o_custkey)
select k, refs, stored, stored = refs or (stored >= 0.9 * refs and stored >= 30) as warm from w""")
def s18_warm_cache(spark, sf_dir):
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("refs"), F.count(F.when(F.col("o_orderstatus") != "P", 1)).alias("stored"))
    full = (F.col("stored") == F.col("refs")) | ((F.col("stored") >= 0.9 * F.col("refs")) & (F.col("stored") >= 30))
    return w.withColumn("warm", full)


@query("""with c as (select l_orderkey as clip, l_linenumber as ord, l_quantity::bigint % 8 + 1 as n_rows from lineitem), f as (select l_orderkey as clip, count(*) as n from lineitem group by l_orderkey)
select clip, min(ord) as ord from c join f using (clip) where n_rows = n group by clip""")
def s42_pose_cache(spark, sf_dir):
    """The first cached track whose rows match the number of frames."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity").cast("long") % 8 + 1).alias("n_rows"))
    frames = F.count("*").over(Window.partitionBy("clip"))
    return rows.withColumn("n", frames).where("n_rows = n").groupBy("clip").agg(F.min("ord").alias("ord"))


@query(f"""with {SPOTS}, b as (select k, min(lat) as s, min(lon) as w0, max(lat) as n, max(lon) as e from spots group by k)
select k, round((s + n) / 2, 8) as lat, round((w0 + e) / 2, 8) as lon, round({sql_haversine('s', 'w0', 'n', 'e')} / 2, 3) as radius from b""")
def s13_city_extent(spark, sf_dir):
    b = spots(spark, sf_dir).groupBy("k").agg(F.min("lat").alias("s"), F.min("lon").alias("w0"), F.max("lat").alias("n"), F.max("lon").alias("e"))
    return b.select("k", F.round((F.col("s") + F.col("n")) / 2, 8).alias("lat"), F.round((F.col("w0") + F.col("e")) / 2, 8).alias("lon"), F.round(G.haversine_m("s", "w0", "n", "e") / 2, 3).alias("radius"))
