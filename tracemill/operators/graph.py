"""Road graphs: views, start nodes, bounded walk enumeration, walk geometry.

Edges carry (graph_id, edge_ord, u, v, k, length, names, geom); geom is an array
of points in driving order and may be null for a straight edge.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE = "graph_id long, edge_ord long, u long, v long, k int, length double, x1 double, y1 double, x2 double, y2 double, h1 double, h2 double"


def grid_roads(spark: SparkSession, n: int, spacing: float, graph_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """A square grid of two-way roads: node i * n + j stands at (j, i) * spacing."""
    ident = F.col("id")
    nodes = spark.range(n * n).select(F.lit(graph_id).cast("long").alias("graph_id"), ident.alias("node_id"), (ident % n * spacing).alias("x"), (F.floor(ident / n) * spacing).alias("y"))
    row, col = F.floor(ident / n), ident % n
    right = F.when(col < n - 1, F.array(F.struct(ident.alias("u"), (ident + 1).alias("v")), F.struct((ident + 1).alias("u"), ident.alias("v"))))
    up = F.when(row < n - 1, F.array(F.struct(ident.alias("u"), (ident + n).alias("v")), F.struct((ident + n).alias("u"), ident.alias("v"))))
    none = F.array().cast("array<struct<u:bigint,v:bigint>>")
    pairs = spark.range(n * n).select(F.explode(F.concat(F.coalesce(right, none), F.coalesce(up, none))).alias("e")).select("e.*")
    edges = pairs.select(F.lit(graph_id).cast("long").alias("graph_id"), (F.col("u") * n * n + F.col("v")).alias("edge_ord"), "u", "v", F.lit(0).alias("k"), F.lit(float(spacing)).alias("length"))
    return nodes, edges


def road_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with end points and start and end headings; geometry wins over the straight segment.

    Edges with fewer than two points are left out.
    """
    if "geom" not in edges.columns:
        edges = edges.withColumn("geom", F.lit(None).cast("array<struct<x:double,y:double>>"))
    end = lambda side: nodes.select("graph_id", F.col("node_id").alias(side), F.struct("x", "y").alias(f"p{side}"))
    joined = edges.join(end("u"), ["graph_id", "u"]).join(end("v"), ["graph_id", "v"])
    line = joined.withColumn("geom", F.coalesce("geom", F.array("pu", "pv"))).where("size(geom) >= 2")
    at = lambda i, c: F.element_at("geom", i)[c]
    return line.select(
        "graph_id", "edge_ord", "u", "v", "k", "length",
        at(1, "x").alias("x1"), at(1, "y").alias("y1"), at(-1, "x").alias("x2"), at(-1, "y").alias("y2"),
        F.atan2(at(2, "y") - at(1, "y"), at(2, "x") - at(1, "x")).alias("h1"),
        F.atan2(at(-1, "y") - at(-2, "y"), at(-1, "x") - at(-2, "x")).alias("h2"),
        "geom",
    )


def start_nodes(edges: DataFrame, every: int = 1) -> DataFrame:
    """graph_id, node_id, degree: every nth node, by id, that in- and out-edges touch at least twice."""
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node_id"))
    found = ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree")).where("degree >= 2")
    n = F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id"))
    return found.withColumn("_n", n).where((F.col("_n") - 1) % every == 0).drop("_n")


def adaptive_depth(edges: DataFrame, target: float, depth: int, most: int = 150) -> DataFrame:
    """graph_id, depth: enough edges of median length for one and a half targets."""
    mid = edges.groupBy("graph_id").agg(F.median("length").alias("m"))
    return mid.select("graph_id", F.least(F.lit(most), F.greatest(F.lit(depth), F.ceil(1.5 * target / F.col("m")))).cast("int").alias("depth"))


def turn_plans() -> list[dict[int, int]]:
    """At which step of a walk which alternative is taken: none, one turn, two turns, interleaved.

    Positions and ranks are fixed values.
    """
    ones = [{step: rank} for step in (1, 2, 3, 4, 6, 8) for rank in (1, 2)]
    twos = [{a: 1, b: rank} for a, b in ((1, 3), (1, 4), (1, 6), (2, 4), (2, 6), (3, 6), (3, 8), (4, 8)) for rank in (1, 2)]
    plans: list[dict[int, int]] = [{}]
    while ones or twos:
        plans += ones[:2] + twos[:1]
        ones, twos = ones[2:], twos[1:]
    return plans


class _Network:
    def __init__(self, edges: pd.DataFrame):
        self.edges = list(edges.itertuples(index=False))
        self.out = defaultdict(list)
        for e in self.edges:
            self.out[e.u].append(e)

    def follow(self, first, plan: dict[int, int], target: float, depth: int) -> list:
        """Go straight ahead, except where the plan turns off; no road twice, no turning back."""
        path, run = [first], first.length
        used = {(min(first.u, first.v), max(first.u, first.v), first.k)}
        while run < target and len(path) < depth:
            at = path[-1]
            open_ = [e for e in self.out[at.v] if e.v != at.u and (min(e.u, e.v), max(e.u, e.v), e.k) not in used]
            if not open_:
                break
            bend = lambda e: round(abs((e.h1 - at.h2 + math.pi) % (2 * math.pi) - math.pi), 9)
            open_.sort(key=lambda e: (bend(e), e.edge_ord))
            want = plan.get(len(path), 0)
            e = open_[want if want < len(open_) else 0]
            path.append(e)
            used.add((min(e.u, e.v), max(e.u, e.v), e.k))
            run += e.length
        return path

    def walks(self, start: int, target: float, depth: int, most: int, plans: list[dict[int, int]]) -> list[list]:
        firsts = sorted(self.out[start], key=lambda e: (-e.length, e.v, e.k))
        seen, found = set(), []
        for plan in plans:
            for first in firsts:
                path = self.follow(first, plan, target, depth)
                name = tuple(e.edge_ord for e in path)
                if sum(e.length for e in path) >= 0.5 * target and name not in seen:
                    seen.add(name)
                    found.append(path)
                    if len(found) == most:
                        return found
        return found


def walks(starts: DataFrame, view: DataFrame, target: float, depth: int, most: int, chunk: int = 64) -> DataFrame:
    """graph_id, start_node, walk, seq, edge_ord, u, v, length: up to ``most`` walks from each start.

    A graph (a city) is worked in chunks of starts, so cities and starts both
    spread over tasks; a task holds one city's edges.
    """
    chunks = starts.groupBy("graph_id").agg(F.max("node_id").alias("_m")).select("graph_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("_m") / chunk))).alias("chunk"))
    named = lambda *cs: [F.col(c).alias(c) for c in cs]  # both sides may come from one table
    a = starts.select("graph_id", F.floor(F.col("node_id") / chunk).alias("chunk"), "node_id")
    b = view.select(*named(*[c.split()[0] for c in EDGE.split(", ")])).join(chunks.select(*named("graph_id", "chunk")), "graph_id").select(*named("graph_id", "chunk"), *[c.split()[0] for c in EDGE.split(", ")[1:]])
    plans = turn_plans()

    def enumerate_(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            net = _Network(right)
            for start in sorted(left["node_id"]):
                for w, path in enumerate(net.walks(start, target, depth, most, plans)):
                    rows += [(int(e.graph_id), int(start), w, i, int(e.edge_ord), int(e.u), int(e.v), float(e.length)) for i, e in enumerate(path)]
        return pd.DataFrame(rows, columns=["graph_id", "start_node", "walk", "seq", "edge_ord", "u", "v", "length"])

    schema = "graph_id long, start_node long, walk int, seq int, edge_ord long, u long, v long, length double"
    return a.groupBy("graph_id", "chunk").cogroup(b.groupBy("graph_id", "chunk")).applyInPandas(enumerate_, schema)


def walk_points(found: DataFrame, view: DataFrame) -> DataFrame:
    """graph_id, start_node, walk, seq, x, y: a walk's polyline, joints once."""
    keys = ["graph_id", "start_node", "walk"]
    lines = found.join(view.select("graph_id", "edge_ord", "geom"), ["graph_id", "edge_ord"])
    parts = lines.select(*keys, F.col("seq").alias("e"), F.posexplode("geom").alias("i", "p")).where("e = 0 or i > 0")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("e", "i")) - 1
    return parts.select(*keys, n.alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def walk_edge_sets(found: DataFrame) -> DataFrame:
    """graph_id, start_node, walk, edges: undirected edges as an ordered-pair set."""
    pair = F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return found.groupBy("graph_id", "start_node", "walk").agg(F.array_sort(F.collect_set(pair)).alias("edges"))


def jaccard(a: str, b: str):
    """Share of common elements of two sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def match(tracks: DataFrame, lines: DataFrame, track: str, line: str, n: int, prefilter: int, k: int, weight: float = 400.0) -> DataFrame:
    """track, line, corr, rms, score, rank: the k lines that best explain each track.

    Both sides are resampled to n points; heading signatures pick ``prefilter``
    lines by correlation in blocked products, a similarity fit ranks those by
    rms - weight * corr.  Lower is better, ties go to the lower line.
    """
    from tracemill.operators.align import free_rms, similarity_sums
    from tracemill.operators.retrieval import cosine_top_k
    from tracemill.operators.sequence import heading_deltas, resample_uniform

    def sides(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        points = resample_uniform(df, key, n)
        bends = heading_deltas(points, key)
        mean = F.avg("delta").over(Window.partitionBy(key))
        signature = bends.withColumn("delta", F.col("delta") - mean).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("s"))
        return points, signature.select(F.col(key).alias("id"), F.transform("s", lambda e: e["delta"]).alias("embedding"))

    a, sa = sides(tracks, track)
    b, sb = sides(lines, line)
    near = cosine_top_k(sa, sb, prefilter).select(F.col("query_id").alias(track), F.col("ref_id").alias(line), F.round("sim", 6).alias("corr"))
    source = a.select(track, "seq", F.col("x").alias("sx"), F.col("y").alias("sy"))
    target = b.select(line, "seq", F.col("x").alias("tx"), F.col("y").alias("ty"))
    fit = similarity_sums(near.join(source, track).join(target, [line, "seq"]), [track, line, "corr"]).withColumn("rms", F.round(free_rms(), 4))
    scored = fit.withColumn("score", F.round(F.col("rms") - weight * F.col("corr"), 4))
    rank = F.row_number().over(Window.partitionBy(track).orderBy("score", line))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(track, line, "corr", "rms", "score", "rank")
