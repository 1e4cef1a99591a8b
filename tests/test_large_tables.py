"""Queries that failed on larger tables, held against their SQL on small ones that show why."""

import duckdb
import pytest

from test_queries import plain
from tracemill.operators import align as A
from tracemill.plans import catalog


def same(spark, folder, name, **tables):
    """Rows of a query over small tables, after comparing them with its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    frame = catalog.queries()[name](spark, str(folder))
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = con.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert found == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    return found


def most_rows(frame):
    """Rows that the largest node of a frame's plan puts out, after running it."""
    frame.collect()

    def walk(node):
        metric, name = node.metrics().get("numOutputRows"), node.getClass().getSimpleName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return max([metric.get().value() if metric.isDefined() else 0, *map(walk, inner)])

    return walk(frame._jdf.queryExecution().executedPlan())


def events(*tracks):
    """Tracks of (x, y), one row a second."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(u * 1000 + i, start + timedelta(seconds=i), u, "view", float(x), '{"k": %s}' % y) for u, t in enumerate(tracks) for i, (x, y) in enumerate(t)]
    return rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("name", ["x03_heading_deltas", "w03_windowed_turn"])
def test_turning_back_on_the_line(spark, tmp_path, name):
    back = [([17.17, 12.86, 21.48], [58, 62, 54]), ([9.83, 24.78, -5.12], [87, 93, 81]), ([47.59, 31.59, 47.59], [94, 102, 94]), ([37.74, 37.65, 37.83], [19, 35, 3]), ([85.64, 85.82, 85.28], [65, 82, 31]), ([21.01, 13.03, 17.02, 98.55], [24, 32, 28, 61])]
    found = same(spark, tmp_path, name, events=events(*[list(zip(x, y)) for x, y in back]))
    assert len(found) == 7 and any(v > 3 for row in found for v in row if isinstance(v, float))


def test_turns_that_round_to_zero_keep_their_sign(spark, tmp_path):
    tracks = [[(0, 0), (0.1 * (u + 1), 3 + u), *[(i * (u + 0.37), i * i * 7 % (11 + u)) for i in range(4)]] for u in range(60)]
    tracks = [[*t, (t[-1][0] + t[1][0], t[-1][1] + t[1][1])] for t in tracks]  # the last move repeats the first
    signs = {repr(row[1]) for row in same(spark, tmp_path, "w03_windowed_turn", events=events(*tracks)) if row[1] == 0}
    assert signs == {"0.0", "-0.0"}


def test_halves_are_rounded_as_scaled_doubles(spark):
    from tracemill.functions.geo import round_half_away

    values = [0.285, 1.005, -1.005, 2.675, -2.5e-9, -0.001, 2.5, 0.125, 1e300, float("inf"), -1234.565]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(round_half_away("x", 2).alias("r")).collect()
    wanted = duckdb.connect().execute(f"select round(x, 2) from (select unnest([{', '.join(f"'{v}'::double" for v in values)}]) as x)").fetchall()
    assert [repr(r.r) for r in rows] == [repr(w[0]) for w in wanted]


def test_a_track_and_its_header_are_one_file(spark, tmp_path):
    tracks = [[(u + 3 * i, (u * 7 + i) % 100) for i in range(9)] for u in range(40)]
    small = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    for name, size in small.items():  # as if the table were large: several tasks
        spark.conf.set(name, size)
    try:
        assert len(same(spark, tmp_path, "s27_boreas", events=events(*tracks))) == 360
    finally:
        for name in small:
            spark.conf.unset(name)


def customers(n, places):
    """Customers of two nations, whose keys give ``places`` places."""
    return [(i // places * 9000 + i % places * 17, i % 2, i * 37 % 5000 / 4) for i in range(n)], "c_custkey long, c_nationkey int, c_acctbal double"


def suppliers(n, places):
    return [(i // places * 9000 + i % places * 29, i % 2, i * 53 % 7000 / 4) for i in range(n)], "s_suppkey long, s_nationkey int, s_acctbal double"


@pytest.mark.parametrize("name", ["a09_densest_cluster", "j25_pairwise_spread", "a10_cluster_filter"])
def test_points_of_one_place_do_not_meet_in_pairs(spark, tmp_path, name):
    assert same(spark, tmp_path, name, customer=customers(1200, 15), supplier=suppliers(60, 6))
    assert most_rows(catalog.queries()[name](spark, str(tmp_path))) <= 20 * 1260


def test_spread_of_points_of_one_place(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0), (1, 3, 3.0, 4.0), (2, 1, 5.0, 5.0), (3, 1, 1.0, 1.0), (3, 2, 1.0, 1.0), (4, 1, 0.0, 0.0), (4, 2, 0.0, 2.0), (4, 3, 0.0, 6.0), (4, 4, 0.0, 6.0)], "k int, i int, x double, y double")
    assert dict(A.pairwise_spread(rows, "k", "i").collect()) == {1: 5.0, 3: 0.0, 4: 4.0}


def test_triangles_and_ground_of_poses_of_one_place(spark, tmp_path):
    parts = [(i // 12 * 3000 + i % 12 * 41, i % 3 * 20) for i in range(600)], "p_partkey long, p_size int"
    assert same(spark, tmp_path, "j20_triangles_near", customer=customers(600, 10), part=parts)
    assert most_rows(catalog.queries()["j20_triangles_near"](spark, str(tmp_path))) <= 10 * 600
    assert same(spark, tmp_path, "j21_local_ground", customer=customers(1200, 10), supplier=suppliers(60, 6))
    assert most_rows(catalog.queries()["j21_local_ground"](spark, str(tmp_path))) <= 1200


def test_neighbours_are_not_sent_to_the_driver(spark):
    a = spark.range(50).selectExpr("id as i", "id * 1.0 as ax", "0.0 as ay")
    plan = A.near_pairs(a, a.selectExpr("i as j", "ax as bx", "ay as by"), 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_support_meets_by_places(spark, tmp_path, monkeypatch):
    met, near_pairs = [], A.near_pairs
    monkeypatch.setattr(A, "near_pairs", lambda a, b, cell: met.append((a.count(), b.count())) or near_pairs(a, b, cell))
    assert same(spark, tmp_path, "j06_support_join", customer=customers(240, 24), supplier=suppliers(90, 30))
    assert met == [(24, 30)]


def test_angles_of_a_rotation_are_no_rows(spark, tmp_path):
    tracks = [[(i * 31 % (97 + u), i * (53 + u) % 89) for i in range(n)] for u, n in enumerate((1, 7, 8, 40, 90))] + [[(300, 2), (0, 1)] * 5]
    table = events(*tracks)
    assert len(same(spark, tmp_path, "p08_rotation_refine", events=table)) >= 2
    assert most_rows(catalog.queries()["p08_rotation_refine"](spark, str(tmp_path))) <= len(table[0])


def test_streets_link_squares_not_nodes(spark, tmp_path, monkeypatch):
    linked, components = [], A.components
    monkeypatch.setattr(A, "components", lambda links, a, b: linked.append(links.count()) or components(links, a, b))
    orders = [(i * 211 + i % 3, i % 40 * 37 + i // 40 * 5000) for i in range(1200)], "o_orderkey long, o_custkey long"
    found = same(spark, tmp_path, "a33_street_components", orders=orders)
    assert len(found) == 2400 and linked[0] < len(found) / 4


def test_single_linkage_steps_by_the_radius_and_no_more(spark):
    rows = spark.createDataFrame([(1, 5, 0.0, 0.0), (1, 9, 3.0, 4.0), (1, 2, 8.0, 4.0), (1, 3, 13.01, 4.0), (1, 7, 13.01, -0.99), (2, 1, 0.0, 0.0), (1, 8, -3.5, -3.5), (1, 6, -40.0, 0.0)], "k int, i int, x double, y double")
    found = A.single_linkage(rows, "k", "i", 5.0).collect()
    assert {(r.k, r.i): r.root for r in found} == {(1, 5): 2, (1, 9): 2, (1, 2): 2, (1, 3): 3, (1, 7): 3, (2, 1): 1, (1, 8): 2, (1, 6): 6}
