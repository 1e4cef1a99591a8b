"""Registered queries: scans, gates, joins and small transforms that are single plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import geo as G
from tracemill.operators import align as A
from tracemill.operators import ranking as R
from tracemill.operators import sequence as S
from tracemill.operators import skyline as K
from tracemill.plans.tables import STEPS, TRACKS, query, resampled, table, tracks, wrapped
from tracemill.sources import tracks as readers


@query("""with f as (select 'clips/' || (page_id % 60) || '.' || ['mp4', 'mkv', 'webm', 'avi'][page_id % 4 + 1] as path, page_id as m from pages)
select path, m, cast(row_number() over (partition by regexp_extract(path, '^(.*?)(\\.[^./]*)?$', 1) order by case regexp_extract(path, '[.]([^.]+)$', 1) when 'mp4' then 0 when 'mkv' then 1 when 'webm' then 2 else 3 end, m desc, path) as int) as preference from f""")
def s05_rank_cached_inputs(spark, sf_dir):
    k = F.col("page_id")
    ext = F.element_at(F.array(*map(F.lit, ("mp4", "mkv", "webm", "avi"))), (k % 4 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("clips/"), k % 60, F.lit("."), ext).alias("path"), k.alias("m"))
    return readers.rank_cached_inputs(files, "path", "m")


@query(f"with {TRACKS} select user_id, seq from tracks where seq >= 10 and seq < 80 and (seq - 10) % 5 = 0 qualify row_number() over (partition by user_id order by seq) <= 6")
def s06_frame_sample(spark, sf_dir):
    return readers.frame_sample(tracks(spark, sf_dir), "user_id", "seq", 10, 80, 5, 6).select("user_id", "seq")


@query(f"""with {TRACKS}, s as (select user_id, seq // 20 as segment, seq, t_sec - min(t_sec) over (partition by user_id, seq // 20) as t_sec from tracks), d as (
  select user_id, segment, coalesce(sum(max(t_sec) + 0.05) over (partition by user_id order by segment rows between unbounded preceding and 1 preceding), 0) as o from s group by user_id, segment
) select user_id, seq, round(t_sec + o, 6) as t_sec from s join d using (user_id, segment)""")
def s25_route_clock(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("segment", F.floor(F.col("seq") / 20))
    t = t.withColumn("t_sec", F.col("t_sec") - F.min("t_sec").over(Window.partitionBy("user_id", "segment"))).select("user_id", "segment", "seq", "t_sec")
    return readers.lay_end_to_end(t, "user_id").select("user_id", "seq", F.round("t_sec", 6).alias("t_sec"))


@query("""with p as (select c_custkey as id, c_acctbal / 50 as lat, c_acctbal / 40 as lon from customer)
select id, abs(lat) <= 90 and abs(lon) <= 180 and not (abs(lat) < 1e-6 and abs(lon) < 1e-6) as valid, lat between -10 and 40 and lon between -10 and 60 as in_box from p""")
def f01_valid_latlon(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 50).alias("lat"), (F.col("c_acctbal") / 40).alias("lon"))
    return p.select("id", G.valid_latlon("lat", "lon").alias("valid"), (F.col("lat").between(-10, 40) & F.col("lon").between(-10, 60)).alias("in_box"))


@query("""with b as (select n_nationkey as ord, n_name as provider, n_nationkey * 300.0 - 900 as lo, n_nationkey * 300.0 + 300 as hi from nation)
select c_custkey as id, arg_min(provider, ord) as provider from customer join b on c_acctbal >= lo and c_acctbal <= hi group by c_custkey""")
def f07_provider_lookup(spark, sf_dir):
    k = F.col("n_nationkey")
    boxes = table(spark, sf_dir, "nation").select(k.alias("ord"), F.col("n_name").alias("provider"), (k * 300.0 - 900).alias("lo"), (k * 300.0 + 300).alias("hi"))
    met = table(spark, sf_dir, "customer").join(F.broadcast(boxes), (F.col("c_acctbal") >= F.col("lo")) & (F.col("c_acctbal") <= F.col("hi")))  # 25 declared boxes
    return met.groupBy(F.col("c_custkey").alias("id")).agg(F.min_by("provider", "ord").alias("provider"))


@query("""select o_custkey as clip, count(*) as n, median(o_totalprice) as mid, count(*) >= 12 as enough, min(o_totalprice) >= 1000 as covered, max(o_totalprice) > 400000 as active,
  sum(cast(o_orderstatus = 'F' as bigint))::bigint >= greatest(2, floor(0.4 * count(*))) as broad from orders group by o_custkey""")
def f20_group_gates(spark, sf_dir):
    p = F.col("o_totalprice")
    ok = F.sum((F.col("o_orderstatus") == "F").cast("long"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("clip")).agg(
        F.count("*").alias("n"), F.median(p).alias("mid"), (F.count("*") >= 12).alias("enough"), (F.min(p) >= 1000).alias("covered"), (F.max(p) > 400000).alias("active"), (ok >= F.greatest(F.lit(2), F.floor(0.4 * F.count("*")))).alias("broad")
    )


@query("""select o_orderkey as id, (o_totalprice between 0.5 * 200000 and 2 * 200000) or (o_totalprice between 0.5 * 90000 and 2 * 90000) as sane, o_totalprice between 0.3 * 200000 and 3 * 200000 as plausible from orders""")
def f08_length_sane(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (p.between(100000, 400000) | p.between(45000, 180000)).alias("sane"), p.between(60000, 600000).alias("plausible"))


@query("""with w as (select c_custkey as w, c_nationkey as name, (c_custkey * 37) % 1000 as x, (c_custkey * 91) % 1000 as y from customer), c as (select s_suppkey as c, s_nationkey as name, (s_suppkey * 53) % 1000 as x, (s_suppkey * 29) % 1000 as y from supplier)
select w.w, c.c, w.name = c.name as named from w, c where sqrt((w.x - c.x) ** 2 + (w.y - c.y) ** 2) <= 80 or (w.name = c.name and sqrt((w.x - c.x) ** 2 + (w.y - c.y) ** 2) <= 160)""")
def j06_support_join(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    w = table(spark, sf_dir, "customer").select(k.alias("w"), F.col("c_nationkey").alias("wn"), (k * 37 % 1000).alias("ax"), (k * 91 % 1000).alias("ay"))
    c = table(spark, sf_dir, "supplier").select(s.alias("c"), F.col("s_nationkey").alias("cn"), (s * 53 % 1000).alias("bx"), (s * 29 % 1000).alias("by"))
    # places meet first; then rows of near places, and of farther ones those with the same name, so that every pair made counts
    met = A.near_places(w, c, 160.0).join(c, ["bx", "by"])
    near = w.join(met.where("distance <= 80").hint("merge"), ["ax", "ay"]).select("w", "c", (F.col("wn") == F.col("cn")).alias("named"))
    far = met.where("distance > 80").withColumnRenamed("cn", "wn").hint("merge")
    return near.unionByName(w.join(far, ["ax", "ay", "wn"]).select("w", "c", F.lit(True).alias("named")))


@query("""with g as (select lower(n_name) as gt from nation where n_nationkey % 3 = 0), p as (select c_custkey as id, lower(c_mktsegment) || ' ' || lower(n_name) || ' road' as name from customer join nation on c_nationkey = n_nationkey)
select id, list_sort(list(distinct gt)) as names from p join g on contains(name, gt) group by id""")
def j07_names_contained(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat_ws(" ", F.lower("c_mktsegment"), F.lower("n_name"), F.lit("road")).alias("name"))
    truth = nation.where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("gt"))
    return names.join(F.broadcast(truth), F.col("name").contains(F.col("gt"))).groupBy("id").agg(F.array_sort(F.collect_set("gt")).alias("names"))  # a user's few street names


@query(f"""with {TRACKS}, a as (select *, cast(y as bigint) % 7 as said from tracks), p as (
  select a.user_id, a.event_id, d.event_id as hit, row_number() over (partition by a.event_id order by case when a.said = d.said then 0 else 1 end, abs(a.t_sec - d.t_sec), d.event_id) as k
  from a join a d on a.user_id = d.user_id and d.event_type = 'view' where a.event_type <> 'view'
) select user_id, event_id, hit from p where k = 1""")
def j11_same_text_then_nearest(spark, sf_dir):
    """The nearest detection in time of an anchor's own text; of any text where none has it."""
    rows = tracks(spark, sf_dir).withColumn("said", F.struct("user_id", (F.col("y").cast("long") % 7).alias("t")))
    anchors, seen = rows.where("event_type <> 'view'"), rows.where("event_type = 'view'")
    same = S.nearest_in_time(anchors, seen, "said", "t_sec", "event_id").select("probe_id", F.col("nearest_id").alias("same"))
    near = S.nearest_in_time(anchors, seen, "user_id", "t_sec", "event_id").join(same, "probe_id", "left")
    return near.select("user_id", F.col("probe_id").alias("event_id"), F.coalesce("same", "nearest_id").alias("hit"))


@query(f"""with {TRACKS}, l as (select user_id, seq, event_type, lag(event_type) over (partition by user_id order by seq) as p from tracks)
select user_id, seq, event_type from l where event_type is distinct from p""")
def w11_collapse_repeats(spark, sf_dir):
    w = S.ordered("user_id")
    return tracks(spark, sf_dir).withColumn("p", F.lag("event_type").over(w)).where(~F.col("event_type").eqNullSafe(F.col("p"))).select("user_id", "seq", "event_type")


@query(f"""with {TRACKS}, f as (select user_id, event_type, min(seq) as pos from tracks group by all) select user_id, list(event_type order by pos) as kinds from f group by user_id""")
def w10_first_seen(spark, sf_dir):
    first = tracks(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("seq").alias("at"))
    return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda e: e["event_type"]).alias("kinds"))


@query(f"""with {TRACKS}, f as (select user_id, min(cast(x < 200 as int)) over (partition by user_id order by seq rows unbounded preceding) as run from tracks) select user_id, cast(sum(run) as bigint) as length from f group by user_id""")
def w13_leading_run(spark, sf_dir):
    run = F.min((F.col("x") < 200).cast("int")).over(S.running("user_id"))
    return tracks(spark, sf_dir).withColumn("run", run).groupBy("user_id").agg(F.sum("run").alias("length"))


@query(f"""with {STEPS}, e as (select user_id, max(s) as s, arg_max(x, seq) - arg_min(x, seq) as dx, arg_max(y, seq) - arg_min(y, seq) as dy from arc group by user_id)
select a.user_id, round(abs(sqrt(a.dx ** 2 + a.dy ** 2) / a.s - sqrt(b.dx ** 2 + b.dy ** 2) / b.s) + 0.3 * abs({wrapped('atan2(a.dy, a.dx) - atan2(b.dy, b.dx)')}), 6) as gap from e a join e b on b.user_id = a.user_id + 1 where a.s > 0 and b.s > 0""")
def a39_endpoint_consistency(spark, sf_dir):
    """How two tracks differ in the share of their length that lies between their ends, and in its direction."""
    e = S.arc_length(tracks(spark, sf_dir), "user_id").groupBy("user_id").agg(F.max("s").alias("s"), *[(F.max_by(c, "seq") - F.min_by(c, "seq")).alias(f"d{c}") for c in "xy"]).where("s > 0")
    ends = e.select("user_id", (F.hypot("dx", "dy") / F.col("s")).alias("r"), F.atan2("dy", "dx").alias("h"))
    other = ends.select((F.col("user_id") - 1).alias("user_id"), F.col("r").alias("q"), F.col("h").alias("g"))
    gap = F.abs(F.col("r") - F.col("q")) + 0.3 * F.abs(G.wrap_angle(F.col("h") - F.col("g")))
    return ends.join(other, "user_id").select("user_id", F.round(gap, 6).alias("gap"))


@query(f"""with {STEPS}, {resampled(64)}, st as (select user_id, seq, atan2(y - lag(y) over w, x - lag(x) over w) as h from points window w as (partition by user_id order by seq)), tu as (
  select user_id, seq, coalesce({wrapped('h - lag(h) over (partition by user_id order by seq)')}, 0) as turn from st where h is not null
), r as (select user_id, seq, turn, sum(turn) over (partition by user_id order by seq rows unbounded preceding) as h from tu),
p as (select a.user_id, abs(a.turn) + 1e-3 as w, a.h as a, b.h as b from r a join r b on b.user_id = a.user_id + 1 and b.seq = a.seq),
s as (select user_id, sum(w) as w, sum(w * a) as x, sum(w * b) as y, sum(w * a * b) as xy, sum(w * a * a) as xx, sum(w * b * b) as yy from p group by user_id)
select user_id, round(least(1, greatest(-1, (xy - x * y / w) / (sqrt(greatest(0, xx - x * x / w) * greatest(0, yy - y * y / w)) + 1e-12))), 5) as corr from s""")
def a38_turn_weighted_correlation(spark, sf_dir):
    rows = tracks(spark, sf_dir).select("user_id", "seq", "x", "y")
    out = S.turn_weighted_correlation(rows, rows.withColumn("user_id", F.col("user_id") - 1), "user_id", 64)
    return out.select("user_id", F.round("corr", 5).alias("corr"))


@query("""with c as (select l_orderkey // 20 as clip, l_suppkey % 10 as cand, l_linenumber as sample, case when l_returnflag = 'R' then null else (l_quantity - 25) / 5 + l_suppkey % 10 end as delta, l_discount * 10 as explain, l_tax as contra, l_linestatus = 'F' as informative from lineitem),
f as (select clip, cand, sample, median(delta) as d, min(explain) as explain, max(contra) as contra, bool_or(informative) as informative from c group by all),
n as (select clip, count(distinct sample) as n from c group by clip), o as (select clip, cand, median(d) as off from f group by all), com as (select clip, median(off) as common from o group by clip),
e as (select c.clip, c.cand, c.sample, median(abs(delta - off)) as e from c join o using (clip, cand) group by all),
p as (select e.clip, e.cand, e.e, coalesce(greatest(0, exp(-e.e / 3.0) * least(1, explain / 0.6) * (1 - 0.7 * contra) * case when informative then 1.0 else 0.5 end), 0) as part from e join f using (clip, cand, sample)),
s as (select clip, cand, sum(part) as total, median(e) as error from p group by all)
select clip, cand, round(off, 6) + 0.0::double as pitch, round(error, 6) as error, round(total / n * coalesce(exp(-greatest(0, abs(off - common) - 10.0) / 6.0), 1), 6) as score from s join o using (clip, cand) join com using (clip) join n using (clip)""")
def a28_skyline_scores(spark, sf_dir):
    """Candidates of a clip by how their skylines agree with the seen ones, without the pitch that all share."""
    k, flag = F.col("l_suppkey") % 10, F.col("l_returnflag") == "R"
    delta = F.when(~flag, (F.col("l_quantity") - 25) / 5 + k)
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 20).alias("clip"), k.alias("cand"), F.col("l_linenumber").alias("sample"), delta.alias("delta"), (F.col("l_discount") * 10).alias("explain"), F.col("l_tax").alias("contradiction"), (F.col("l_linestatus") == "F").alias("informative"))
    one = rows.groupBy("clip", "cand", "sample").agg(F.min("explain").alias("explain"), F.max("contradiction").alias("contradiction"), F.max("informative").alias("informative"))
    rows = rows.select("clip", "cand", "sample", "delta").join(one, ["clip", "cand", "sample"])
    out = K.skyline_scores(rows, "clip", "cand", "sample")
    return out.select("clip", "cand", (F.round("offset", 6) + 0.0).alias("pitch"), F.round("error", 6).alias("error"), F.round("score", 6).alias("score"))


@query("""with w as (select user_id, value as deg, (event_id % 10) / 10.0 as conf from events), s as (select user_id, sum(conf * sin(radians(deg))) as a, sum(conf * cos(radians(deg))) as b, count(*) as n, sqrt(sum(conf * sin(radians(deg))) ** 2 + sum(conf * cos(radians(deg))) ** 2) / sum(conf) as r from w where conf >= 0.3 group by user_id)
select user_id, n, round(degrees(atan2(a, b)) - 360 * floor(degrees(atan2(a, b)) / 360), 5) as heading, round(r, 6) as confidence from s""")
def a18_weighted_heading(spark, sf_dir):
    w = table(spark, sf_dir, "events").select("user_id", F.radians("value").alias("h"), (F.col("event_id") % 10 / 10.0).alias("c")).where("c >= 0.3")
    s = w.groupBy("user_id").agg(F.sum(F.col("c") * F.sin("h")).alias("a"), F.sum(F.col("c") * F.cos("h")).alias("b"), F.count("*").alias("n"), F.sum("c").alias("t"))
    return s.select("user_id", "n", F.round(F.pmod(F.degrees(F.atan2("a", "b")), F.lit(360.0)), 5).alias("heading"), F.round(F.hypot("a", "b") / F.col("t"), 6).alias("confidence"))


@query("""with c as (select c_nationkey as k, c_custkey as i, (c_custkey * 37) % 1000 as x, (c_custkey * 91) % 1000 as y from customer), t as (select * from c qualify row_number() over (partition by k order by i) <= 9), z as (select k, arg_min(x, i) as x0, arg_min(y, i) as y0 from t group by k),
n as (select t.k, avg(case when sqrt((x - x0) ** 2 + (y - y0) ** 2) <= 250 then 1.0 else 0.0 end) as share from t join z using (k) group by t.k), s as (select a.k, median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as spread from t a join t b on a.k = b.k and a.i < b.i group by a.k)
select k, round(share, 6) as concentration, round(spread, 6) as spread, case when share >= 0.6 and spread <= 400 then 'high' when share >= 0.3 then 'medium' else 'low' end as level from n join s using (k)""")
def a24_hypothesis_confidence(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), k.alias("i"), (k * 37 % 1000).alias("x"), (k * 91 % 1000).alias("y"))
    t = c.withColumn("n", R.rank_by("k", "i")).where("n <= 9").drop("n")
    first = t.groupBy("k").agg(F.min_by("x", "i").alias("x0"), F.min_by("y", "i").alias("y0"))
    near = t.join(first, "k").groupBy("k").agg(F.avg(F.when(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) <= 250, 1.0).otherwise(0.0)).alias("share"))
    both = near.join(A.pairwise_spread(t, "k", "i"), "k")
    level = F.when((F.col("share") >= 0.6) & (F.col("spread") <= 400), "high").when(F.col("share") >= 0.3, "medium").otherwise("low")
    return both.select("k", F.round("share", 6).alias("concentration"), F.round("spread", 6).alias("spread"), level.alias("level"))


@query(f"""with {TRACKS}, seg as (select user_id, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from tracks window w as (partition by user_id order by seq) qualify lead(x) over w is not null),
grid as (select user_id, x1, y1, x2, y2, i, j from (select *, unnest(range(cast(floor((least(x1, x2) - 10) / 20) as bigint), cast(floor((greatest(x1, x2) + 10) / 20) as bigint) + 1)) as i from seg), lateral (select unnest(range(cast(floor((least(y1, y2) - 10) / 20) as bigint), cast(floor((greatest(y1, y2) + 10) / 20) as bigint) + 1)) as j)),
t as (select *, (i + 0.5) * 20 as px, (j + 0.5) * 20 as py, greatest(0, least(1, coalesce((((i + 0.5) * 20 - x1) * (x2 - x1) + ((j + 0.5) * 20 - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0), 0))) as s from grid),
cells as (select distinct user_id, i, j from t where sqrt((px - x1 - s * (x2 - x1)) ** 2 + (py - y1 - s * (y2 - y1)) ** 2) <= 10),
n as (select user_id, count(*) as n from cells group by user_id), m as (select a.user_id, count(*) as m from cells a join cells b on b.user_id = a.user_id + 1 and a.i = b.i and a.j = b.j group by a.user_id)
select a.user_id, round(coalesce(m, 0) / (a.n + b.n - coalesce(m, 0)), 6) as iou, round(coalesce(m, 0) / least(a.n, b.n), 6) as coverage from n a join n b on b.user_id = a.user_id + 1 left join m on m.user_id = a.user_id""")
def a26_raster_overlap(spark, sf_dir):
    lines = A.segments(tracks(spark, sf_dir), "user_id")
    cells = K.cells_of(lines, ["user_id"], 20.0, 20.0)
    other = cells.select((F.col("user_id") - 1).alias("user_id"), "i", "j")
    paired = cells.select("user_id").distinct().join(other.select("user_id").distinct(), "user_id")
    out = K.overlap(cells.join(paired, "user_id", "left_semi"), other.join(paired, "user_id", "left_semi"), "user_id")
    return out.select("user_id", F.round("iou", 6).alias("iou"), F.round("coverage", 6).alias("coverage"))


@query(f"with {TRACKS} select user_id, seq, round(cos(0.3) * (x - 50) - sin(0.3) * (y - 20) + 50 + 7, 6) as x, round(sin(0.3) * (x - 50) + cos(0.3) * (y - 20) + 20 - 4, 6) as y from tracks")
def x16_rigid_transform(spark, sf_dir):
    c, s, dx, dy = F.cos(F.lit(0.3)), F.sin(F.lit(0.3)), F.col("x") - 50, F.col("y") - 20
    return tracks(spark, sf_dir).select("user_id", "seq", F.round(c * dx - s * dy + 57, 6).alias("x"), F.round(s * dx + c * dy + 16, 6).alias("y"))


@query("""select p_partkey as id, split_part(seg, ':', 1)::double as a, try_cast(nullif(split_part(seg, ':', 2), '') as double) as b from (select p_partkey, p_size || ':' || case when p_partkey % 3 = 0 then '' else cast(p_size + 10 as varchar) end as seg from part)""")
def x46_parse_segment(spark, sf_dir):
    seg = F.concat(F.col("p_size"), F.lit(":"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise((F.col("p_size") + 10).cast("string")))
    parts = F.split(seg, ":")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parts[0].cast("double").alias("a"), F.nullif(parts[1], F.lit("")).try_cast("double").alias("b"))


@query("select event_id, case when v > 15 and 1.5 * 25 / (v - 15) <= 200 then round(1.5 * 25 / (v - 15), 6)::double end as depth from (select event_id, event_id % 30 as v from events)")
def x28_flat_ground_depth(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(K.flat_ground_depth(F.col("event_id") % 30, 25.0, 15.0, 1.5), 6).alias("depth"))


@query("""select c_nationkey as k from customer intersect select s_nationkey from supplier where s_suppkey % 4 = 0""")
def u05_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select("s_nationkey"))
