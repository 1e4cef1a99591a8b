"""Registered queries: rank fusion, gates, votes, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import ranking as R
from tracemill.operators import retrieval as V
from tracemill.plans.tables import TRACKS, query, table, tracks

CANDIDATES = """c as (
  select l_orderkey as k, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as i, l_extendedprice / 1000 as price, l_quantity as qty, case when l_discount > 0.02 then l_discount end as disc, l_tax as tax from lineitem
)"""


def _candidates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), (R.rank_by("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice") - 1).alias("i"), (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("qty"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("disc"), F.col("l_tax").alias("tax"))


@query(f"""with {CANDIDATES}, r as (
  select *, row_number() over (partition by k order by price desc, i) as a, row_number() over (partition by k order by qty desc, i) as b,
    case when disc is null then i + 1 else row_number() over (partition by k order by disc desc nulls last, i) end as d from c
), f as (select k, i, a + b + 0.25 * d + 10 * tax as fused from r)
select k, i, round(fused, 6) as fused, cast(row_number() over (partition by k order by round(fused, 9), i) as int) as final_rank from f""")
def o03_rank_fusion(spark, sf_dir):
    out = R.fuse(_candidates(spark, sf_dir), "k", "i", {"shape": ("price", 1.0), "sliding": ("qty", 1.0), "anchor": ("disc", 0.25)}, {"tax": 10.0})
    return out.select("k", "i", F.round("fused", 6).alias("fused"), "final_rank")


@query(f"""with {CANDIDATES}, r as (
  select *, row_number() over (partition by k order by qty, i) as b, row_number() over (partition by k order by price desc, i) as o from c
) select k, i, cast(row_number() over (partition by k order by case when b <= 3 then 0 else 1 end, case when b <= 3 then round(qty + 0.75 * o, 9) end, case when b > 3 then b end, i) as int) as final_rank from r""")
def o04_rank_fusion_capped(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("o", R.rank_by("k", F.desc("price"), "i"))
    return R.fuse_capped(rows, "k", "i", "qty", "o", 0.75, 3).select("k", "i", "final_rank")


@query(f"""with {CANDIDATES} select k, i, round(15 * greatest(0, (price * 100 - 150) / 1000), 6) as by_distance, round(10 * least(2, qty / 10) * greatest(0, (price * 100 - 1500) / 1000), 6) as by_plate,
  case when tax >= 0.04 then round(5 * greatest(0, (qty * 3 - 30) / 150), 6) else 0.0 end as by_sun from c""")
def o05_penalties(spark, sf_dir):
    d = F.col("price") * 100
    return _candidates(spark, sf_dir).select(
        "k", "i",
        F.round(R.distance_penalty(d), 6).alias("by_distance"),
        F.round(R.plate_penalty(d, F.col("qty") / 10), 6).alias("by_plate"),
        F.round(R.sun_penalty(F.col("qty") * 3, F.when(F.col("tax") >= 0.04, 0.6).otherwise(0.0)), 6).alias("by_sun"),
    )


@query(f"""with {CANDIDATES}, m as (
  select k, i, tax as best, tax - lead(tax) over w as margin, row_number() over w as r from c window w as (partition by k order by tax desc, i)
) select k, i, round(best, 6) as best, round(margin, 6) as margin, round(margin, 6) >= 0.02 and i <= 4 and i > 0 as flips,
  case when margin is null then 0.0 else round(0.4 * (greatest(0, least(1, (margin - 0.005) / 0.015)) ** 2) * (3 - 2 * greatest(0, least(1, (margin - 0.005) / 0.015))), 6) end as weight from m where r = 1""")
def o08_tiebreak_and_weight(spark, sf_dir):
    m = R.top_two_margin(_candidates(spark, sf_dir), "k", "tax", "i")
    flips = (F.round("margin", 6) >= 0.02) & (F.col("i") <= 4) & (F.col("i") > 0)
    return m.select("k", "i", F.round("best", 6).alias("best"), F.round("margin", 6).alias("margin"), flips.alias("flips"), F.round(R.adaptive_weight(F.col("margin"), 0.005, 0.015), 6).alias("weight"))


@query(f"""with {CANDIDATES}, g as (select k, min(qty) as e, arg_min(i, qty * 100 + i) as r, arg_min(qty, i) as e0, min(i) as r0 from c group by k)
select k, case when e <= 0.9 * e0 and e <= e0 - 10 then r else r0 end as i, case when e <= 0.9 * e0 and e <= e0 - 10 then e else e0 end as qty from g""")
def o15_placement_pick(spark, sf_dir):
    return R.pick_placement(_candidates(spark, sf_dir), "k", "i", "qty")


@query(f"""with {CANDIDATES}, m as (select k, i, qty as best, qty - lead(qty) over w as margin, row_number() over w as r from c window w as (partition by k order by qty desc, i))
select k, case when margin is null or margin >= 15 then 'high' when margin >= 5 then 'medium' else 'low' end as confidence from m where r = 1""")
def a25_confidence_class(spark, sf_dir):
    m = R.top_two_margin(_candidates(spark, sf_dir), "k", "qty", "i")
    level = F.when(F.col("margin").isNull() | (F.col("margin") >= 15), "high").when(F.col("margin") >= 5, "medium").otherwise("low")
    return m.select("k", level.alias("confidence"))


@query("""with v as (select user_id, event_type, count(distinct event_id % 10) as votes, min(event_id) as seen from events group by all),
r as (select *, row_number() over w as n, coalesce(lead(votes) over w, 0) as second from v window w as (partition by user_id order by votes desc, seen, event_type))
select user_id, event_type, votes, second, round(votes / greatest(second, 1), 6) as margin, votes >= 2 and votes > 1.5 * second as decided from r where n = 1""")
def a14_district_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("voter", F.col("event_id") % 10)
    return R.vote(rows, "user_id", "event_type", "voter", "event_id").withColumn("margin", F.round("margin", 6))


@query("""with counts as (select event_type as source, user_id, count(*) as votes from events group by all),
r as (select *, row_number() over (partition by source order by votes desc, user_id) as n from counts)
select source, user_id, votes, cast(n as int) as n, cast(row_number() over (order by source, n) as int) as priority from r where n <= 3""")
def a15_priority_votes(spark, sf_dir):
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), "user_id").agg(F.count("*").alias("votes"))
    top = counts.withColumn("n", R.rank_by("source", F.desc("votes"), "user_id")).where("n <= 3")
    return top.withColumn("priority", F.row_number().over(Window.orderBy("source", "n")))  # three rows a source


@query(r"""with t as (select doc_id, regexp_extract(text, '^\s*([^\s]+)', 1) as token, n_chars from documents)
select lower(token) as token, doc_id, n_chars from t where token <> '' qualify row_number() over (partition by lower(token) order by n_chars desc, doc_id) = 1""")
def a17_best_per_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_extract("text", r"^\s*([^\s]+)", 1)).alias("token"), "n_chars")
    return R.best_per(docs.where("token <> ''"), "token", F.desc("n_chars"), "doc_id").select("token", "doc_id", "n_chars")


@query(f"""with {TRACKS}, m as (select user_id, seq // 20 as win, y as cand, seq % 20 as rank, x / 500 - 0.5 as score from tracks),
b as (select user_id, cand, win, min(rank) as rank, max(score) as score from m group by all), n as (select user_id, max(seq) // 20 + 1 as n from tracks group by user_id)
select b.user_id, cast(cand as int) as cand, count(*) as n_windows, round(count(*) / any_value(n.n), 6) as ratio, round(avg(rank), 6) as mean_rank, round(avg(score), 6) as mean_score,
  round(count(*) / any_value(n.n) + 0.25 * greatest(0, avg(score)), 6) as support from b join n using (user_id) group by b.user_id, cand""")
def a23_sliding_support(spark, sf_dir):
    t = tracks(spark, sf_dir)
    m = t.select("user_id", F.floor(F.col("seq") / 20).alias("window"), F.col("y").cast("int").alias("cand"), (F.col("seq") % 20).alias("rank"), (F.col("x") / 500 - 0.5).alias("score"))
    n = t.groupBy("user_id").agg((F.floor(F.max("seq") / 20) + 1).alias("n"))
    out = R.window_support(m.join(n, "user_id"), F.col("n"), ["user_id", "cand", "n"]).drop("n")
    return out.select("user_id", "cand", "n_windows", *[F.round(c, 6).alias(c) for c in ("ratio", "mean_rank", "mean_score", "support")])


COSINE = """with q as (select vec_id, embedding from embeddings where vec_id % 5 = 0), r as (select vec_id, embedding from embeddings where vec_id % 5 <> 0), s as (
  select q.vec_id as query_id, r.vec_id as ref_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(r.embedding as double[])), 9) as sim from q, r
) select query_id, cast(row_number() over (partition by query_id order by sim desc, ref_id) as int) as rank, ref_id, round(sim, 6) as sim from s
qualify row_number() over (partition by query_id order by sim desc, ref_id) <= {}"""


def _cosine(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return V.cosine_top_k(vectors.where("id % 5 = 0"), vectors.where("id % 5 <> 0"), k).select("query_id", "rank", "ref_id", F.round("sim", 6).alias("sim"))


@query(COSINE.format(1))
def p02_cosine_top1(spark, sf_dir):
    return _cosine(spark, sf_dir, 1)


@query(COSINE.format(10))
def j17_cosine_topk(spark, sf_dir):
    return _cosine(spark, sf_dir, 10)


@query("select vec_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as length, round(list_sum(list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))))), 6) as unit_sum from embeddings")
def p01_normalized(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.round(V.norm("embedding"), 6).alias("length"), F.round(F.aggregate(V.normalized("embedding"), F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


@query(f"""with recursive {TRACKS}, refs as materialized (select user_id as clip, seq as ref, x, y from tracks),
moves as materialized (select a.clip, a.ref as p, b.ref, -0.02 * greatest(0.0, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - (30 + 40 * 2.0)) as m from refs a join refs b using (clip)),
sims as materialized (select q.clip, q.ref as q, r.ref, round(1 / (1 + abs(q.x - r.x) / 100), 9) as sim from refs q join refs r using (clip)),
steps(clip, q, ref, score, path) as (
  select clip, q, ref, sim, [ref] from sims where q = 0
  union all
  select z.clip, z.q, z.ref, z.reach + s.sim, z.path from (
    select s.clip, s.q + 1 as q, m.ref, s.score + m.m as reach, list_append(s.path, m.ref) as path, row_number() over (partition by s.clip, m.ref order by s.score + m.m desc, s.ref) as n from steps s join moves m on m.clip = s.clip and m.p = s.ref
  ) z join sims s on s.clip = z.clip and s.q = z.q and s.ref = z.ref where z.n = 1
), best as (select clip, path from steps qualify row_number() over (partition by clip order by q desc, score desc, ref) = 1)
select clip, unnest(range(len(path))) as q, unnest(path) as ref from best""")
def p04_viterbi(spark, sf_dir):
    t = tracks(spark, sf_dir).select(F.col("user_id").cast("long").alias("clip"), F.col("seq").cast("long").alias("seq"), "x", "y")
    q = t.select("clip", F.col("seq").alias("q"), F.col("x").alias("qx"))
    refs = t.select("clip", F.col("seq").alias("ref"), "x", "y")
    sims = q.join(refs, "clip").select("clip", "q", "ref", F.round(1 / (1 + F.abs(F.col("qx") - F.col("x")) / 100), 9).alias("sim"))
    return V.viterbi_decode(sims, refs, "clip", 2.0)
