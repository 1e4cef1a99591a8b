"""Registered queries: road graphs, walks, the matcher."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.operators import graph as N
from tracemill.plans.tables import query, table, tracks

SIZE, TARGET, DEPTH, MOST = 7, 900.0, 12, 6

#: One road graph a region: nodes in uneven rows and columns, every fourth road with a bend.
GRID = f"""grid_nodes as (select r_regionkey::bigint as g, i as node_id, i % {SIZE} * 100.0::double + (i * 37 + r_regionkey * 11) % 7 * 6.0::double as x, i // {SIZE} * 100.0::double + (i * 53 + r_regionkey * 5) % 5 * 8.0::double as y from region, range({SIZE * SIZE}) r(i)),
one_way as (select g, node_id as a, node_id + 1 as b from grid_nodes where node_id % {SIZE} < {SIZE - 1} union all select g, node_id, node_id + {SIZE} from grid_nodes where node_id < {SIZE * SIZE - SIZE}),
ways as (
  select e.g, e.u, e.v, e.u * {SIZE * SIZE} + e.v as ord, (e.u + e.v + e.g) % 4 = 0 as bent, p.x as x1, p.y as y1, q.x as x2, q.y as y2, (p.x + q.x) / 2 + 12 as mx, (p.y + q.y) / 2 - 9 as my
  from (select g, a as u, b as v from one_way union all select g, b, a from one_way) e join grid_nodes p on p.g = e.g and p.node_id = e.u join grid_nodes q on q.g = e.g and q.node_id = e.v
), roads as (
  select g, u, v, ord, bent, x1, y1, x2, y2, mx, my,
    round(case when bent then sqrt((mx - x1) * (mx - x1) + (my - y1) * (my - y1)) + sqrt((x2 - mx) * (x2 - mx) + (y2 - my) * (y2 - my)) else sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) end, 6) as len,
    case when bent then atan2(my - y1, mx - x1) else atan2(y2 - y1, x2 - x1) end as h1, case when bent then atan2(y2 - my, x2 - mx) else atan2(y2 - y1, x2 - x1) end as h2 from ways
)"""
_PLANS = ", ".join(f"({i}, {[p.get(step, 0) for step in range(1, 9)]})" for i, p in enumerate(N.turn_plans()))
WALKS = f"""{GRID}, plans(s, ranks) as (values {_PLANS}),
paths as (
  select g, u as start_node, row_number() over (partition by g, u, s order by len desc, v) as f, s, ranks, [ord] as edges, [least(u, v) * 1000 + greatest(u, v)] as used, u, v, h2 as h, len, 1 as n from roads, plans
  union all
  select g, start_node, f, s, ranks, list_append(edges, ord), list_append(used, und), u2, v2, hh, len + l2, n + 1 from (
    select p.*, r.ord, least(r.u, r.v) * 1000 + greatest(r.u, r.v) as und, r.u as u2, r.v as v2, r.h2 as hh, r.len as l2,
      row_number() over (partition by p.g, p.start_node, p.f, p.s order by round(abs(r.h1 - p.h + pi() - 2 * pi() * floor((r.h1 - p.h + pi()) / (2 * pi())) - pi()), 9), r.ord) - 1 as k,
      count(*) over (partition by p.g, p.start_node, p.f, p.s) as c
    from paths p join roads r on r.g = p.g and r.u = p.v and r.v <> p.u and not list_contains(p.used, least(r.u, r.v) * 1000 + greatest(r.u, r.v)) where p.len < {TARGET} and p.n < {DEPTH}
  ) where k = case when coalesce(ranks[n], 0) < c then coalesce(ranks[n], 0) else 0 end
), ended as (select * from paths qualify n = max(n) over (partition by g, start_node, f, s)),
accepted as (select * from ended where len >= {0.5 * TARGET} qualify row_number() over (partition by g, start_node, edges order by s, f) = 1),
walks as (select *, row_number() over (partition by g, start_node order by s, f) - 1 as walk from accepted qualify row_number() over (partition by g, start_node order by s, f) <= {MOST})"""


def _roads(spark, sf_dir):
    """Nodes, edges and the view of one road graph for each region."""
    g, i = F.col("r_regionkey").cast("long"), F.col("i")
    nodes = table(spark, sf_dir, "region").select(g.alias("graph_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIZE * SIZE - 1).cast("long"))).alias("i"))
    g = F.col("graph_id")
    x, y = i % SIZE * 100.0 + (i * 37 + g * 11) % 7 * 6.0, F.floor(i / SIZE) * 100.0 + (i * 53 + g * 5) % 5 * 8.0
    nodes = nodes.select("graph_id", i.alias("node_id"), x.alias("x"), y.alias("y"))
    pairs = N.grid_roads(spark, SIZE, 100.0)[1].select("u", "v", "edge_ord", "k")
    end = lambda side: nodes.select("graph_id", F.col("node_id").alias(side), F.struct("x", "y").alias(f"p{side}"))
    edges = pairs.join(end("u"), "u").join(end("v"), ["graph_id", "v"])
    middle = F.struct(((F.col("pu.x") + F.col("pv.x")) / 2 + 12).alias("x"), ((F.col("pu.y") + F.col("pv.y")) / 2 - 9).alias("y"))
    bent = (F.col("u") + F.col("v") + g) % 4 == 0
    edges = edges.withColumn("geom", F.when(bent, F.array("pu", middle, "pv")))
    apart = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    length = F.when(bent, apart(F.col("pu"), middle) + apart(middle, F.col("pv"))).otherwise(apart(F.col("pu"), F.col("pv")))
    edges = edges.select("graph_id", "edge_ord", "u", "v", "k", F.round(length, 6).alias("length"), "geom")
    return nodes, edges, N.road_view(nodes, edges)


def _walks(spark, sf_dir):
    _, edges, view = _roads(spark, sf_dir)
    return N.walks(N.start_nodes(edges), view, TARGET, DEPTH, MOST), view


@query(f"with {GRID} select g as graph_id, ord as edge_ord, u, v, x1, y1, x2, y2, round(h1, 9) as heading, round(h2, 9) as end_heading, len as length from roads")
def s10_road_view(spark, sf_dir):
    return _roads(spark, sf_dir)[2].select("graph_id", "edge_ord", "u", "v", "x1", "y1", "x2", "y2", F.round("h1", 9).alias("heading"), F.round("h2", 9).alias("end_heading"), "length")


@query(f"with {GRID}, ends as (select g, u as node_id from roads union all select g, v from roads), d as (select g, node_id, count(*) as degree from ends group by g, node_id having count(*) >= 2) select g as graph_id, node_id, degree from d qualify (row_number() over (partition by g order by node_id) - 1) % 3 = 0")
def f03_start_nodes(spark, sf_dir):
    return N.start_nodes(_roads(spark, sf_dir)[1], 3).select("graph_id", "node_id", "degree")


@query(f"with {GRID} select g as graph_id, cast(least(150, greatest({DEPTH}, ceil(1.5 * 2500 / median(len)))) as int) as depth from roads group by g")
def a31_adaptive_depth(spark, sf_dir):
    return N.adaptive_depth(_roads(spark, sf_dir)[1], 2500.0, DEPTH).select("graph_id", "depth")


@query(f"with recursive {WALKS} select g as graph_id, start_node, cast(walk as int) as walk, edges, round(len, 6) as length from walks")
def g02_walks(spark, sf_dir):
    found, _ = _walks(spark, sf_dir)
    edges = F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_ord"))), lambda e: e["edge_ord"])
    return found.groupBy("graph_id", "start_node", "walk").agg(edges.alias("edges"), F.round(F.sum("length"), 6).alias("length"))


@query(f"""with recursive {WALKS}, steps as (select g, start_node, walk, unnest(edges) as ord, generate_subscripts(edges, 1) as i from walks), pts as (
  select g, start_node, walk, 0 as i, 0 as j, x1 as x, y1 as y from steps join roads using (g, ord) where i = 1
  union all select g, start_node, walk, i, 1, mx, my from steps join roads using (g, ord) where bent union all select g, start_node, walk, i, 2, x2, y2 from steps join roads using (g, ord)
) select g as graph_id, start_node, cast(walk as int) as walk, cast(row_number() over (partition by g, start_node, walk order by i, j) - 1 as int) as seq, x, y from pts""")
def x08_walk_polyline(spark, sf_dir):
    return N.walk_points(*_walks(spark, sf_dir))


@query(f"""with recursive {WALKS}, sets as (select g, start_node, walk, list_distinct(used) as e from walks)
select a.g as graph_id, a.start_node, cast(a.walk as int) as walk, cast(b.walk as int) as other, round(len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e))), 9) as overlap from sets a join sets b on a.g = b.g and a.start_node = b.start_node and a.walk < b.walk""")
def a32_walk_jaccard(spark, sf_dir):
    sets, keys = N.walk_edge_sets(_walks(spark, sf_dir)[0]), ["graph_id", "start_node"]
    a, b = sets.select(*keys, "walk", F.col("edges").alias("e")), sets.select(*keys, F.col("walk").alias("other"), F.col("edges").alias("o"))
    return a.join(b, keys).where("walk < other").select(*keys, "walk", "other", F.round(N.jaccard("e", "o"), 9).alias("overlap"))


@query(f"""with recursive {WALKS}, steps as (select g, start_node, walk, unnest(edges) as ord, generate_subscripts(edges, 1) as i from walks), named as (
  select g, start_node, walk, i, case when abs(u - v) = 1 then 'row ' || (u // {SIZE}) else 'column ' || (u % {SIZE}) end as name from steps join roads using (g, ord)
), firsts as (select g, start_node, walk, name, min(i) as i from named group by all), n as (select g, start_node, walk, count(*) as n_edges from steps group by all)
select g as graph_id, start_node, cast(walk as int) as walk, n_edges, list(name order by i)[:10] as names from firsts join n using (g, start_node, walk) group by g, start_node, walk, n_edges""")
def x42_walk_summary(spark, sf_dir):
    found, _ = _walks(spark, sf_dir)
    keys = ["graph_id", "start_node", "walk"]
    name = F.when(F.abs(F.col("u") - F.col("v")) == 1, F.concat(F.lit("row "), F.floor(F.col("u") / SIZE))).otherwise(F.concat(F.lit("column "), F.col("u") % SIZE))
    first = found.withColumn("name", name).groupBy(*keys, "name").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda e: e["name"])
    return first.groupBy(*keys).agg(F.sum("n").alias("n_edges"), F.slice(listed, 1, 10).alias("names"))


@query()
def g03_match_topk(spark, sf_dir):
    """The five walks, of all graphs, that best explain each track."""
    lines = N.walk_points(*_walks(spark, sf_dir)).withColumn("walk_id", F.col("graph_id") * 1_000_000 + F.col("start_node") * 1000 + F.col("walk"))
    w = N.Window.partitionBy("user_id").orderBy("seq")
    steps = tracks(spark, sf_dir).select(F.col("user_id").alias("clip"), "seq", F.sum("x").over(w).alias("x"), F.sum("y").over(w).alias("y"))
    return N.match(steps, lines.select("walk_id", "seq", "x", "y"), "clip", "walk_id", 32, 500, 5)
