"""Registered queries: alignment, consensus, distances, clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.operators import align as A
from tracemill.operators import sequence as S
from tracemill.plans.tables import STEPS, TRACKS, query, resampled, table, tracks

PAIRS = f"""{STEPS}, {resampled(16)}, pairs as (
  select a.user_id, a.x as sx, a.y as sy, b.x as tx, b.y as ty from points a join points b on b.user_id = a.user_id + 1 and a.seq = b.seq
), sums as (
  select user_id, count(*) as n, count(*) * (covar_pop(sx, tx) + covar_pop(sy, ty)) as a, count(*) * (covar_pop(sx, ty) - covar_pop(sy, tx)) as b,
         count(*) * (var_pop(sx) + var_pop(sy)) as p, count(*) * (var_pop(tx) + var_pop(ty)) as q from pairs group by user_id having count(*) * (var_pop(sx) + var_pop(sy)) > 1e-12
)"""


def _pairs(spark, sf_dir):
    points = S.resample_uniform(tracks(spark, sf_dir), "user_id", 16)
    a = points.select("user_id", "seq", F.col("x").alias("sx"), F.col("y").alias("sy"))
    b = points.select((F.col("user_id") - 1).alias("user_id"), "seq", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return a.join(b, ["user_id", "seq"])


@query(f"with {PAIRS} select user_id, n, round(atan2(b, a), 5) as theta, round(sqrt(a * a + b * b) / p, 6) as scale, round(sqrt(greatest(0, q - (a * a + b * b) / p) / n), 4) as rms from sums")
def a02_procrustes_free(spark, sf_dir):
    fit = A.similarity_sums(_pairs(spark, sf_dir), ["user_id"])
    return fit.select("user_id", "n", F.round("theta", 5).alias("theta"), F.round("scale", 6).alias("scale"), F.round(A.free_rms(), 4).alias("rms"))


@query(f"with {PAIRS} select user_id, round(sqrt(greatest(0, 0.25 * p + q - sqrt(a * a + b * b)) / n), 4) as rms from sums")
def a03_procrustes_fixed(spark, sf_dir):
    return A.similarity_sums(_pairs(spark, sf_dir), ["user_id"]).select("user_id", F.round(A.fixed_rms(0.5), 4).alias("rms"))


@query(f"with {PAIRS} select user_id, round(greatest(-1, least(1, coalesce(covar_pop(sx, tx) / nullif(sqrt(var_pop(sx) * var_pop(tx)), 0), 0))), 6) as corr from pairs group by user_id")
def a01_pearson(spark, sf_dir):
    return A.pearson(_pairs(spark, sf_dir), ["user_id"], "sx", "tx").select("user_id", F.round("corr", 6).alias("corr"))


ANCHORS = f"{TRACKS}, anchors as (select user_id, seq, x, y, 2 * x - y + (seq % 3) * 5 as wx, x + 2 * y - (seq % 4) * 3 as wy from tracks)"


def _anchors(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    return rows.select("user_id", "seq", "x", "y", (2 * F.col("x") - F.col("y") + F.col("seq") % 3 * 5).alias("wx"), (F.col("x") + 2 * F.col("y") - F.col("seq") % 4 * 3).alias("wy"))


@query(f"""with {ANCHORS}, pairs as (
  select a.user_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as d, sqrt((a.wx - b.wx) ** 2 + (a.wy - b.wy) ** 2) as w from anchors a join anchors b on a.user_id = b.user_id and a.seq < b.seq
) select user_id, round(median(w / d), 6) as scale, count(*) as n_pairs from pairs where d > 1e-6 and w > 1 group by user_id""")
def a05_pair_ratio_scale(spark, sf_dir):
    return A.pair_ratio_scale(_anchors(spark, sf_dir), "user_id", "seq").withColumn("scale", F.round("scale", 6))


@query(f"""with {ANCHORS}, sizes as (select user_id, count(*) as n from anchors group by user_id), drawn as (
  select user_id, i, j from (select user_id, n, unnest(range(n)) as i from sizes where n * (n - 1) // 2 <= 500), lateral (select unnest(range(i + 1, n)) as j)
  union select user_id, least(i, j), greatest(i, j) from (select user_id, (k * 7919 + 104729) % n as i, ((k * 7919 + 104729) % n + 1 + (k * 15485863) % (n - 1)) % n as j from sizes, range(500) r(k) where n * (n - 1) // 2 > 500)
), pairs as (
  select a.user_id, a.seq as i, b.seq as j, a.x, a.y, a.wx, a.wy,
    ((b.x - a.x) * (b.wx - a.wx) + (b.y - a.y) * (b.wy - a.wy)) / nullif((b.x - a.x) ** 2 + (b.y - a.y) ** 2, 0) as c,
    ((b.x - a.x) * (b.wy - a.wy) - (b.y - a.y) * (b.wx - a.wx)) / nullif((b.x - a.x) ** 2 + (b.y - a.y) ** 2, 0) as s
  from drawn d join anchors a on a.user_id = d.user_id and a.seq = d.i join anchors b on b.user_id = d.user_id and b.seq = d.j
), fits as (
  select p.user_id, p.i, p.j, q.seq, sqrt((p.wx + c * (q.x - p.x) - s * (q.y - p.y) - q.wx) ** 2 + (p.wy + s * (q.x - p.x) + c * (q.y - p.y) - q.wy) ** 2) <= 12.5 as hit
  from pairs p join anchors q using (user_id) where c is not null
), best as (
  select user_id, i, j, sum(hit::bigint)::bigint as inliers from fits group by user_id, i, j qualify row_number() over (partition by user_id order by inliers desc, i, j) = 1
), kept as (
  select b.*, q.x as sx, q.y as sy, q.wx as tx, q.wy as ty from best b join fits f using (user_id, i, j) join anchors q on q.user_id = b.user_id and q.seq = f.seq where f.hit
), sums as (
  select user_id, i, j, inliers, count(*) * (covar_pop(sx, tx) + covar_pop(sy, ty)) as a, count(*) * (covar_pop(sx, ty) - covar_pop(sy, tx)) as b,
    count(*) * (var_pop(sx) + var_pop(sy)) as p, count(*) * (var_pop(tx) + var_pop(ty)) as q, sqrt((max(tx) - min(tx)) ** 2 + (max(ty) - min(ty)) ** 2) as baseline from kept group by all
) select user_id, i, j, inliers, round(sqrt(a * a + b * b) / p, 6) as scale, round(sqrt(greatest(0, q - (a * a + b * b) / p) / inliers), 4) as rms, round(baseline, 6) as baseline
from sums where inliers >= 3 and baseline >= 60 and p > 1e-12 and a * a + b * b > 0""")
def a06_ransac_similarity(spark, sf_dir):
    fit = A.ransac_similarity(_anchors(spark, sf_dir), "user_id", "seq", 12.5, least_baseline=60.0)
    return fit.withColumns({"scale": F.round("scale", 6), "rms": F.round("rms", 4), "baseline": F.round("baseline", 6)})


CUSTOMERS = "points as (select c_nationkey as k, c_custkey as i, (c_custkey * 37) % 1000 as x, (c_custkey * 91) % 1000 as y, c_acctbal + 1000 as w from customer)"


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"), (F.col("c_custkey") * 37 % 1000).alias("x"), (F.col("c_custkey") * 91 % 1000).alias("y"), (F.col("c_acctbal") + 1000).alias("w"))


@query(f"""with {CUSTOMERS}, sums as (
  select a.k, a.i, sum(b.w) as weight from points a join points b on a.k = b.k and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 150 group by a.k, a.i
) select k, i, round(weight, 4) as weight from sums qualify row_number() over (partition by k order by round(weight, 6) desc, i) = 1""")
def a09_densest_cluster(spark, sf_dir):
    return A.densest_neighbourhood(_customers(spark, sf_dir), "k", "i", 150.0).withColumn("weight", F.round("weight", 4))


@query(f"""with {TRACKS}, v as (select user_id, x, sum(y + 1) as w from tracks group by user_id, x), r as (
  select user_id, x, sum(w) over (partition by user_id order by x rows unbounded preceding) as run, sum(w) over (partition by user_id) as total from v
) select user_id, min(x) as median from r where run >= 0.5 * total group by user_id""")
def a11_weighted_median(spark, sf_dir):
    return A.weighted_median(tracks(spark, sf_dir).withColumn("w", F.col("y") + 1), "user_id", "x", "w")


@query(f"with {CUSTOMERS} select a.k, round(median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) as spread from points a join points b on a.k = b.k and a.i < b.i group by a.k")
def j25_pairwise_spread(spark, sf_dir):
    return A.pairwise_spread(_customers(spark, sf_dir), "k", "i").withColumn("spread", F.round("spread", 6))


SEGMENTS = """segments as (
  select user_id, seq, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from tracks window w as (partition by user_id order by seq) qualify lead(x) over w is not null
)"""


def sql_segment_distance(px: str, py: str) -> str:
    t = f"greatest(0, least(1, coalesce((({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0), 0)))"
    return f"sqrt(({px} - x1 - {t} * (x2 - x1)) ** 2 + ({py} - y1 - {t} * (y2 - y1)) ** 2)"


@query(f"""with {TRACKS}, {SEGMENTS} select p.user_id, p.seq, round(min({sql_segment_distance('p.x', 'p.y')}), 6) as distance
from tracks p join segments s on s.user_id = p.user_id + 1 group by p.user_id, p.seq""")
def j04_point_to_polyline(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    lines = A.segments(rows, "user_id").withColumn("user_id", F.col("user_id") - 1)
    points = rows.select("user_id", "seq", F.col("x").alias("px"), F.col("y").alias("py"))
    return points.join(lines, "user_id").groupBy("user_id", "seq").agg(F.round(F.min(A.segment_distance()), 6).alias("distance"))


@query(f"""with {TRACKS}, {SEGMENTS}, steps as (
  select *, cast(greatest(1, ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 50)) as int) as n from segments
), dense as (
  select distinct user_id, x1 + (x2 - x1) * i / n as px, y1 + (y2 - y1) * i / n as py from (select *, unnest(range(n + 1)) as i from steps)
) select d.user_id, round(min({sql_segment_distance('d.px', 'd.py')}), 5) as distance from dense d join segments s on s.user_id = d.user_id + 1 group by d.user_id""")
def j05_polyline_to_polyline(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    dense = A.densify(rows, "user_id", 50.0)
    lines = A.segments(rows, "user_id").withColumn("user_id", F.col("user_id") - 1)
    return dense.join(lines, "user_id").groupBy("user_id").agg(F.round(F.min(A.segment_distance()), 5).alias("distance"))


@query(f"""with {TRACKS}, {SEGMENTS}, d as (
  select p.user_id, p.seq, min({sql_segment_distance('p.x', 'p.y')}) as d from tracks p join segments s on s.user_id = p.user_id + 1 group by p.user_id, p.seq
), st as (
  select p.user_id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as start_error from tracks p join tracks q on q.user_id = p.user_id + 1 and p.seq = 0 and q.seq = 0
) select d.user_id, round(any_value(start_error), 6) as start_error, round(avg(d), 6) as mean_error, round(max(d), 6) as max_error from d join st using (user_id) group by d.user_id""")
def a21_waypoint_errors(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    lines = A.segments(rows, "user_id").withColumn("user_id", F.col("user_id") - 1)
    points = rows.select("user_id", "seq", F.col("x").alias("px"), F.col("y").alias("py"))
    near = points.join(lines, "user_id").groupBy("user_id", "seq").agg(F.min(A.segment_distance()).alias("d"))
    start = rows.where("seq = 0")
    other = start.select((F.col("user_id") - 1).alias("user_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    starts = start.join(other, "user_id").select("user_id", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("e"))
    return near.join(starts, "user_id").groupBy("user_id").agg(F.round(F.first("e"), 6).alias("start_error"), F.round(F.avg("d"), 6).alias("mean_error"), F.round(F.max("d"), 6).alias("max_error"))


@query("""with nodes as (select i as node_id, (i % 70) * 100.0 as x, (i // 70) * 100.0 as y from range(4900) r(i)),
anchors as (select s_suppkey as a, (s_suppkey * 613) % 7000 as x, (s_suppkey * 227) % 7000 as y from supplier)
select n.node_id, round(min(sqrt((n.x - a.x) ** 2 + (n.y - a.y) ** 2)), 6) as distance from nodes n join anchors a on sqrt((n.x - a.x) ** 2 + (n.y - a.y) ** 2) <= 300
group by n.node_id order by distance, n.node_id limit 40""")
def j13_disc_seed_nodes(spark, sf_dir):
    nodes = spark.range(4900).select(F.col("id").alias("node_id"), (F.col("id") % 70 * 100.0).alias("ax"), (F.floor(F.col("id") / 70) * 100.0).alias("ay"))
    anchors = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 613 % 7000).alias("bx"), (F.col("s_suppkey") * 227 % 7000).alias("by"))
    near = A.near_pairs(nodes, anchors, 300.0).groupBy("node_id").agg(F.round(F.min("distance"), 6).alias("distance"))
    return near.orderBy("distance", "node_id").limit(40)


@query(f"""with {CUSTOMERS}, cells as (select distinct cast(floor(x / 60) as bigint) as i, cast(floor(y / 60) as bigint) as j from points where k % 5 = 0),
bounds as (select min(i) as i0, max(i) as i1, min(j) as j0, max(j) as j1 from cells),
wide as (select distinct i + a as i, j + b as j from cells, (values (-1), (0), (1)) u(a), (values (-1), (0), (1)) v(b), bounds where i + a between i0 and i1 and j + b between j0 and j1)
select p.k, round(avg(case when w.i is null then 0.0 else 1.0 end), 9) as coverage from points p left join wide w on w.i = floor(p.x / 60) and w.j = floor(p.y / 60) where p.k % 5 <> 0 group by p.k""")
def j22_grid_coverage(spark, sf_dir):
    points = _customers(spark, sf_dir).withColumns({"i": F.floor(F.col("x") / 60), "j": F.floor(F.col("y") / 60)})
    cells = points.where("k % 5 = 0").select("i", "j").distinct()
    bounds = cells.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    wide = cells.withColumn("a", F.explode(step)).withColumn("b", F.explode(step)).select((F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).distinct()
    wide = wide.crossJoin(F.broadcast(bounds)).where("i between i0 and i1 and j between j0 and j1").select("i", "j", F.lit(1.0).alias("hit"))
    return points.where("k % 5 <> 0").join(wide, ["i", "j"], "left").groupBy("k").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("coverage"))


def sql_turned(angle: str) -> str:
    return f"round(sqrt((x0 + cos(radians({angle})) * (x - x0) - sin(radians({angle})) * (y - y0) - ox) ** 2 + (y0 + sin(radians({angle})) * (x - x0) + cos(radians({angle})) * (y - y0) - oy) ** 2), 6)"


def sql_medians(name: str, rows: str) -> str:
    """CTEs that end in ``name`` (user_id, angle, median) from rows (user_id, angle, d, w)."""
    return f"""{name}_v as (select user_id, angle, d, sum(w) as w from {rows} group by all),
{name}_r as (select *, sum(w) over (partition by user_id, angle order by d rows unbounded preceding) as run, sum(w) over (partition by user_id, angle) as total from {name}_v),
{name} as (select user_id, angle, min(d) as median from {name}_r where run >= 0.5 * total group by user_id, angle)"""


@query(f"""with {TRACKS}, o as (select user_id, x as x0, y as y0 from tracks where seq = 0),
f as (select t.user_id, x, y, x0, y0, x - 0.2 * y as ox, y + 0.3 * x as oy, 1 + seq % 3 as w from tracks t join o using (user_id)),
large as (select user_id from f group by user_id having count(*) >= 8 and max(sqrt((x - x0) ** 2 + (y - y0) ** 2)) >= 100),
turned as (select user_id, a * 2.0 - 180 as angle, {sql_turned('(a * 2.0 - 180)')} as d, w from f join large using (user_id), range(180) r(a)), {sql_medians('coarse', 'turned')},
around as (select user_id, angle as middle from coarse qualify row_number() over (partition by user_id order by median, angle) = 1),
near as (select user_id, middle + a * 0.25 - 2 as angle, {sql_turned('(middle + a * 0.25 - 2)')} as d, w from f join around using (user_id), range(17) r(a)), {sql_medians('fine', 'near')},
unturned as (select user_id, 0.0 as angle, {sql_turned('0.0')} as d, w from f join large using (user_id)), {sql_medians('plain', 'unturned')},
best as (select user_id, angle, median from fine qualify row_number() over (partition by user_id order by median, angle) = 1)
select b.user_id, cast(b.angle as double) as angle, p.median as base, b.median, b.median < 0.75 * p.median and p.median - b.median >= 20 and b.median <= 300 as accepted from best b join plain p using (user_id)""")
def p08_rotation_refine(spark, sf_dir):
    rows = tracks(spark, sf_dir)
    seen = rows.select("user_id", "seq", (F.col("x") - 0.2 * F.col("y")).alias("ox"), (F.col("y") + 0.3 * F.col("x")).alias("oy"), (1 + F.col("seq") % 3).alias("w"))
    return A.rotation_refine(rows.select("user_id", "seq", "x", "y"), seen, "user_id")
