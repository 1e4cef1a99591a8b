"""Registered queries: order-dependent operators; tests hold them against golden cases."""

from __future__ import annotations

from string import ascii_lowercase

import numpy as np
from pyspark.sql import functions as F

from tracemill.operators import grouped as P
from tracemill.operators import placement as L
from tracemill.operators import sequence as S
from tracemill.plans.tables import query, table, tracks


@query()
def w04_turn_events(spark, sf_dir):
    turns = S.windowed_turn(S.resample_uniform(tracks(spark, sf_dir), "user_id", 64), "user_id", 4)
    fold = lambda g: [(i, round(a, 6)) for i, a in P.turn_events(np.degrees(g["turn"].to_numpy()), 25.0, 4)]
    return P.per_group(turns, "user_id", "user_id long, position int, angle double", fold, ["seq"])


@query()
def p12_turn_distance(spark, sf_dir):
    events = w04_turn_events(spark, sf_dir).withColumn("pair", F.explode(F.array(F.col("user_id"), F.col("user_id") - 1)))

    def fold(g):
        pair = g["pair"].iloc[0]
        a, b = ([(p / 63, t) for u, p, t in zip(g["user_id"], g["position"], g["angle"]) if u == k] for k in (pair, pair + 1))
        return [(round(P.turn_sequence_distance(a, b), 6),)]

    return P.per_group(events, "pair", "pair long, distance double", fold, ["user_id", "position"])


@query()
def o10_leader_clusters(spark, sf_dir):
    fold = lambda g: list(zip(g["seq"].astype(int), P.leader_clusters(list(zip(g["x"], g["y"])), 120.0)))
    return P.per_group(tracks(spark, sf_dir), "user_id", "user_id long, seq int, cluster int", fold, ["seq"])


@query()
def o11_greedy_distinct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sets = li.groupBy((F.col("l_orderkey") % 97).alias("k"), "l_orderkey").agg(F.collect_set(F.col("l_partkey") % 11).alias("s"))
    fold = lambda g: list(zip(g["l_orderkey"], P.greedy_distinct([set(s) for s in g["s"]])))
    return P.per_group(sets, "k", "k long, l_orderkey long, kept boolean", fold, ["l_orderkey"])


@query()
def o12_reject_jumps(spark, sf_dir):
    fixes = tracks(spark, sf_dir).withColumns({"lat": 48 + F.col("x") / 20000, "lon": 9 + F.col("y") / 20000})
    fold = lambda g: list(zip(g["seq"].astype(int), P.reject_jumps(g["t_sec"].tolist(), g["lat"].tolist(), g["lon"].tolist(), 40.0)))
    return P.per_group(fixes, "user_id", "user_id long, seq int, accepted boolean", fold, ["seq"])


@query()
def a08_robust_center(spark, sf_dir):
    seen = tracks(spark, sf_dir).withColumns({"lat": 48 + F.col("x") / 10000, "lon": 9 + F.col("y") / 10000, "sim": 1 / (1 + F.col("x"))})
    fold = lambda g: [tuple(round(v, 8) for v in P.robust_center(g["lat"], g["lon"], g["sim"]))]
    return P.per_group(seen, "user_id", "user_id long, lat double, lon double", fold, ["seq"])


@query()
def p13_stitch_windows(spark, sf_dir):
    windows = S.hopping_windows(tracks(spark, sf_dir), "user_id", 16, 8)

    def fold(g):
        parts = [(w["seq"].astype(int).tolist(), np.c_[w["x"], w["y"]] * (1 + i % 3)) for i, (_, w) in enumerate(g.groupby("start"))]
        return [(f, round(float(p[0]), 4), round(float(p[1]), 4)) for f, p in sorted(P.stitch(parts).items())]

    return P.per_group(windows, "user_id", "user_id long, seq int, x double, y double", fold, ["start", "seq"])


@query()
def p09_elastic_fusion(spark, sf_dir):
    """Every track, bent towards shifted observations of every third vertex; fused is false where a gate kept the rigid one."""

    def fold(g):
        route = np.c_[g["x"], g["y"]]
        at = np.arange(2, len(route), 3)
        bent = P.elastic_fuse(route, at, route[at] + [20.0, -10.0], np.ones(len(at)))
        placed = route if bent is None else bent[0]
        return [(int(s), round(float(p[0]), 4), round(float(p[1]), 4), bent is not None) for s, p in zip(g["seq"], placed)]

    return P.per_group(tracks(spark, sf_dir), "user_id", "user_id long, seq int, x double, y double, fused boolean", fold, ["seq"])


@query()
def j14_fuzzy_streets(spark, sf_dir):
    """Best gazetteer name for each detected word of at least four characters, all words of a document.

    A ratio r needs 2 * matches >= r * (both lengths).  Matches are at most the
    shorter length and at most the characters in common, so neither filter loses
    a pair.  Every distinct word is compared once and joined back to its documents.
    """
    from pyspark.sql.functions import pandas_udf

    from tracemill.functions.text import street_norm

    @pandas_udf("double")
    def ratio(a, b):
        return a.combine(b, P.sequence_ratio).astype(float)

    def counted(rows, side):
        """``rows`` with its length and how often it has each letter, or any other character."""
        rows = rows.withColumn(f"{side}_length", F.length(side))
        letters = {f"{side}_{c}": F.col(f"{side}_length") - F.length(F.replace(F.col(side), F.lit(c), F.lit(""))) for c in ascii_lowercase}
        return rows.withColumns(letters).withColumn(f"{side}_other", F.col(f"{side}_length") - sum(F.col(k) for k in letters))

    least = 0.85
    detected = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w"))
    detected = detected.select("doc_id", street_norm(F.col("w")).alias("w")).where("length(w) >= 4").distinct()
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")).select(street_norm(F.col("name")).alias("name")).where("length(name) >= 4").distinct()
    words, names = counted(detected.select("w").distinct(), "w"), counted(names, "name")
    share = least / (2 - least)
    lengths = F.sequence(F.floor(F.col("name_length") * share).cast("int"), F.ceil(F.col("name_length") / share).cast("int"))
    names = names.withColumn("w_length", F.explode(lengths))
    common = sum(F.least(f"w_{c}", f"name_{c}") for c in [*ascii_lowercase, "other"])
    met = words.join(names, "w_length").where(2 * common >= (least - 1e-6) * (F.col("w_length") + F.col("name_length"))).select("w", "name")
    scored = met.withColumn("ratio", F.round(ratio("w", "name"), 6)).where(F.col("ratio") >= least)
    best = scored.groupBy("w").agg(F.max_by(F.struct("name", "ratio"), F.struct("ratio", "name")).alias("b"))
    return detected.join(best, "w").select("doc_id", "w", "b.name", "b.ratio")


@query()
def x21_extrude(spark, sf_dir):
    rings = tracks(spark, sf_dir)

    def fold(g):
        n = len(g)
        ring = [(10 * np.cos(2 * np.pi * i / n), 10 * np.sin(2 * np.pi * i / n)) for i in range(n)]
        mesh = P.extrude(ring, 5.0 + float(g["y"].iloc[0]) % 7)
        return [(i, *[round(float(v), 6) for v in t.mean(axis=0)]) for i, t in enumerate(mesh)]

    return P.per_group(rings, "user_id", "user_id long, triangle int, x double, y double, z double", fold, ["seq"])


@query()
def a34_track_ends(spark, sf_dir):
    """Robust centres of a track's start, its end and of all of it."""
    seen = tracks(spark, sf_dir).withColumns({"lat": 48 + F.col("x") / 10000, "lon": 9 + F.col("y") / 10000, "sim": 1 / (1 + F.col("x"))})

    def fold(g):
        own = [g[c].to_numpy() for c in ("lat", "lon", "sim")]
        return [tuple(round(v, 8) for place in (*L.track_ends(*own), P.robust_center(*own)) for v in place)]

    return P.per_group(seen, "user_id", "user_id long, start_lat double, start_lon double, end_lat double, end_lon double, lat double, lon double", fold, ["seq"])


@query()
def p07_place_on_track(spark, sf_dir):
    """A turned and shifted copy of each track placed on observations of it; mode null where no pin holds."""

    def fold(g):
        true = np.c_[10 * g["x"], 10 * g["y"]]
        route = L.turned(true, 25.0) + [900.0, -300.0]
        at = np.arange(len(true))
        found = L.place_on_track(route, at, true + np.c_[at % 3, at % 5], 1.0 + at % 2, true[0], true[-1], true.mean(axis=0))
        if found is None:
            return [(int(s), None, None, None, None) for s in g["seq"]]
        placed, mode, _, miss = found
        return [(int(s), round(float(p[0]), 3), round(float(p[1]), 3), mode, round(miss, 3)) for s, p in zip(g["seq"], placed)]

    return P.per_group(tracks(spark, sf_dir), "user_id", "user_id long, seq int, x double, y double, mode string, miss double", fold, ["seq"])


@query()
def o13_distinct_hypotheses(spark, sf_dir):
    """The five best places of ranked candidates that lie apart, with their support."""

    def fold(g):
        clusters = P.leader_clusters(list(zip(g["x"], g["y"])), 120.0)
        return [(rank, int(g["seq"].iloc[i]), n) for rank, i, n in L.distinct_places(clusters)]

    return P.per_group(tracks(spark, sf_dir), "user_id", "user_id long, rank int, seq int, support int", fold, ["seq"])


@query()
def t05_token_set_similarity(spark, sf_dir):
    """Similarity of each part's name with the names of its brand, by characters and by words."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def by_words(a, b):
        return a.combine(b, P.token_set_similarity).astype(float)

    @pandas_udf("double")
    def by_characters(a, b):
        return a.combine(b, P.sequence_ratio).astype(float)

    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.lower(F.concat_ws(" ", "p_brand", "p_name")).alias("other")).distinct()
    return names.select("name", "other", F.round(by_characters("name", "other"), 6).alias("ratio"), F.round(by_words("name", "other"), 6).alias("similarity"))
