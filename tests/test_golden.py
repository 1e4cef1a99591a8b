"""Hand-derived cases for operators that SQL cannot express, and for the readers."""

import io
import math
import random

import numpy as np
import pytest

from tracemill.operators import grouped as P
from tracemill.operators import retrieval as V
from tracemill.sources import citygml, tracks


def test_turn_events_of_an_l():
    turn = np.zeros(60)
    turn[28:33] = [20, 60, 90, 60, 20]
    assert P.turn_events(turn, 25.0, 8) == [(30, 90.0)]
    assert P.turn_events(-turn, 25.0, 8) == [(30, -90.0)]
    assert P.turn_events(np.full(60, 3.0), 25.0, 8) == []


def test_turn_distance():
    left, right = [(0.5, 90.0)], [(0.5, -90.0)]
    assert P.turn_sequence_distance(left, left) == 0
    assert P.turn_sequence_distance(left, right) == 2.0  # a gap on each side is cheaper than 2.5
    assert P.turn_sequence_distance([], []) == 0 and P.turn_sequence_distance([], left) == P.turn_sequence_distance(left, []) == 1.0


def test_leader_clusters_follow_the_seed():
    assert P.leader_clusters([(0, 0), (50, 0), (1000, 0), (1020, 10)], 150) == [0, 0, 1, 1]
    assert P.leader_clusters([(0, 0), (140, 0), (280, 0)], 150) == [0, 0, 1]


def test_greedy_distinct_compares_with_kept_ones_only():
    assert P.greedy_distinct([{1, 2, 3, 4}, {1, 2, 3}, {9}, set()]) == [True, False, True, True]


def test_jump_rejection():
    t, lat, lon = [0, 1, 2, 3, 4], [48.0, 48.0001, 48.2, 48.0002, 48.0003], [9.0] * 5
    assert P.reject_jumps(t, lat, lon, 40.0) == [True, True, False, True, True]
    assert P.reject_jumps([0, 1], [48, 60], [9, 9], 1.0) == [True, True]


def test_geometric_median_and_robust_center():
    from tracemill.operators.align import geometric_median

    x, y = geometric_median([(0, 0), (0, 0), (0, 0), (100, 100)], [1, 1, 1, 1])
    assert math.hypot(x, y) < 0.01
    rng = random.Random(1)
    lat = [48.4 + rng.gauss(0, 1e-4) for _ in range(30)] + [48.9] * 3
    a, b = P.robust_center(np.array(lat), np.full(33, 9.98), np.ones(33))
    assert abs(a - 48.4) < 3e-4 and abs(b - 9.98) < 1e-6


def test_rigid_fit_recovers_a_similarity():
    rng = np.random.default_rng(0)
    source, angle = rng.normal(size=(20, 2)), math.radians(37)
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    scale, rotation, shift = P.rigid_fit(source, 4.5 * source @ turn.T + [10, -3])
    assert abs(scale - 4.5) < 1e-9 and np.allclose(rotation, turn) and np.allclose(shift, [10, -3])


def test_stitch_keeps_the_first_frame():
    line = np.c_[np.arange(10.0), np.zeros(10)]
    placed = P.stitch([(list(range(6)), line[:6]), (list(range(4, 10)), 3 * line[4:10] + 7)])
    assert np.allclose([placed[i] for i in range(10)], line)


def drifted(n=300, seen=40, noise=15.0):
    """A true route, the same with a drift that grows to 160 m, and noisy sights of the true one."""
    rng = np.random.default_rng(0)
    truth = np.c_[np.linspace(0, 3000, n), 200 * np.sin(np.linspace(0, 3, n))]
    at = np.linspace(0, n - 1, seen).round().astype(int)
    return truth, truth + np.c_[np.zeros(n), 160 * np.linspace(0, 1, n) ** 2], at, truth[at] + rng.normal(0, noise, (seen, 2))


def test_elastic_fusion_pins_the_start_and_bends():
    truth, route, at, seen = drifted()
    fused, before, after = P.elastic_fuse(route, at, seen, np.ones(len(at)))
    assert np.allclose(fused[0], route[0]) and np.linalg.norm(fused[-1] - truth[-1]) < 45 and after < 0.85 * before
    # a block of far sights is no reason to bend, few sights or a good fit are none either
    wrong = seen.copy()
    wrong[10:16] += [0, 2000.0]
    bent = P.elastic_fuse(route, at, wrong, np.ones(len(at)))
    assert bent is not None and np.abs(bent[0] - truth).max() < 120
    assert P.elastic_fuse(route, at[:19], seen[:19], np.ones(19)) is None
    assert P.elastic_fuse(truth, at, seen, np.ones(len(at))) is None


def test_banded_solve_equals_dense():
    rng = np.random.default_rng(1)
    n = 30
    a = np.diag(rng.uniform(8, 9, n)) + sum(np.diag(rng.normal(0, 1, n - k), k) for k in (1, 2))
    a = np.triu(a) + np.triu(a, 1).T
    right = rng.normal(0, 1, (n, 2))
    assert np.allclose(P.solve_banded([np.diag(a), np.diag(a, 1), np.diag(a, 2)], right), np.linalg.solve(a, right))


def test_simplex_finds_a_minimum():
    best, value = P.simplex_minimum(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, np.zeros(2), np.ones(2), 200)
    assert value < 1e-6 and np.allclose(best, [3, -1], atol=1e-3)


def test_viterbi_prefers_a_continuous_path():
    sims = np.full((5, 6), 0.1)
    for i in range(5):
        sims[i, i] = 0.8
    sims[2, 2], sims[2, 5] = 0.60, 0.95
    places = np.array([[0, 100.0 * i] for i in range(5)] + [[3000.0, 0]])
    assert V.viterbi(sims, places, 2.0) == [0, 1, 2, 3, 4] and sims[2].argmax() == 5
    assert V.viterbi(0.9 * np.eye(4) + 0.05, np.array([[0, 60.0 * i] for i in range(4)]), 2.0) == [0, 1, 2, 3]


def test_token_set_similarity_punishes_fragments():
    assert P.token_set_similarity("muenster", "muenster") == 1.0
    assert P.token_set_similarity("am", "am alten muensterplatz in ulm") < 0.87


def test_ear_clip_covers_the_polygon():
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    area = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2 for t in P.ear_clip(ring) for a, b, c in [[ring[i] for i in t]])
    assert len(P.ear_clip(ring)) == 3 and abs(area - 10) < 1e-9
    assert len(P.extrude([(0, 0), (1, 0), (1, 1), (0, 1)], 3.0)) == 10


GML = """<core:CityModel xmlns:core="c" xmlns:gml="g" xmlns:b="b"><b:Building><b:wall>
<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 34 10 0 34 10 0 40 0 0 40 0 0 34</gml:posList></gml:LinearRing></gml:exterior>
<gml:interior><gml:LinearRing><gml:posList>2 0 35 3 0 35 3 0 36 2 0 36 2 0 35</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></b:wall>
<b:roof><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 40 10 0 40 10 8 40 0 8 40 0 0 40</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></b:roof>
<gml:posList>1 2 3 4 5 6</gml:posList></b:Building></core:CityModel>"""


def test_citygml(spark):
    (_, triangles, ground), *rest = citygml.parse(GML.encode())
    assert len(triangles) == 4 and not rest and ground[2] == 34
    files = spark.createDataFrame([("a", bytearray(GML.encode())), ("b", bytearray(b"<html>no</html"))], "path string, content binary")
    assert citygml.buildings(files).count() == 4
    assert [r[0] for r in files.select(citygml.is_citygml(files.content)).collect()] == [True, False]


def test_track_readers(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i:010d}.txt").write_text(f"{48 + i / 1000} 9.0 1 2 3")
    rows = tracks.oxts(spark, f"{tmp_path}/*.txt").orderBy("seq").collect()
    assert [(r.seq, r.t_sec, round(r.lat, 3)) for r in rows] == [(0, 0.0, 48.0), (1, 0.1, 48.001), (2, 0.2, 48.002)]
    (tmp_path / "m.gps").write_text("% header\n10.5 0.64 -0.08 1 2\n11.5 0.64 -0.08 1 2\n")
    rows = tracks.malaga(spark, f"{tmp_path}/m.gps").orderBy("seq").collect()
    assert len(rows) == 2 and rows[1].t_sec == 1.0 and abs(rows[0].lat - math.degrees(0.64)) < 1e-9
    (tmp_path / "b.rtk").write_text("# c\n1000000000, 49.2, 16.6, 1\n2000000000, 999, 16.6, 1\n3000000000 49.3 16.6 1\n")
    assert [r.t_sec for r in tracks.brno(spark, f"{tmp_path}/b.rtk").orderBy("seq").collect()] == [0.0, 2.0]
    (tmp_path / "poses").write_text("\n".join(["1 0 0 5 0 1 0 6 0 0 1 7", "bad", " ".join(map(str, range(16)))]))
    assert [(r.seq, r.x, r.z) for r in tracks.pose_text(spark, f"{tmp_path}/poses").collect()] == [(0, 5.0, 7.0), (2, 3.0, 11.0)]


def test_npy_and_route_clock(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"s{k}").mkdir()
        for name, array in (("frame_positions", np.array([[4177000.0, 855000, 4727000]] * 3)), ("frame_times", np.array([5.0, 5.05, 5.1]))):
            buffer = io.BytesIO()
            np.save(buffer, array)
            (tmp_path / f"s{k}" / name).write_bytes(buffer.getvalue())
    rows = tracks.comma_segments(spark, str(tmp_path)).selectExpr("*", "1 as route")
    laid = tracks.lay_end_to_end(rows, "route").orderBy("segment", "seq").collect()
    assert [round(r.t_sec, 2) for r in laid] == [0.0, 0.05, 0.1, 0.15, 0.2, 0.25] and 47 < laid[0].lat < 49


def test_ground_truth_is_validated(spark, tmp_path):
    from pyspark.errors import PySparkException

    good = '{"video_id": "v", "waypoints": [{"t_sec": 0, "lat": 48.4, "lon": 9.9}, {"t_sec": 1, "lat": 48.5, "lon": 9.9}]}'
    (tmp_path / "good.json").write_text(good)
    assert tracks.ground_truth(spark, f"{tmp_path}/good.json").count() == 2
    for i, bad in enumerate((good.replace("48.5", "148.5"), '{"video_id": "v", "waypoints": []}')):
        (tmp_path / f"bad{i}.json").write_text(bad)
        with pytest.raises(PySparkException):
            tracks.ground_truth(spark, f"{tmp_path}/bad{i}.json").collect()


def test_raster_overlap(spark):
    from tracemill.operators.skyline import cells_of, overlap

    line = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "k int, x1 double, y1 double, x2 double, y2 double")
    far = line.selectExpr("k", "x1", "y1 + 500 as y1", "x2", "y2 + 500 as y2")
    own = cells_of(line, ["k"], 5.0, 20.0)
    assert overlap(own, own, "k").first().score == 1.0
    assert overlap(own, cells_of(far, ["k"], 5.0, 20.0), "k").first().score == 0.0


def test_nothing_outside_imports_the_text_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "tracemill"
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "tracemill.llm" in p.read_text()]


def test_jumps_follow_the_seed_and_the_median():
    # a first fix that is a kilometre off does not turn the others away
    t, lat = list(range(8)), [48.4 + i * 1e-4 for i in range(8)]
    lat[0] += 0.01
    assert P.reject_jumps(t, lat, [9.98] * 8, 60.0) == [False] + [True] * 7
    assert P.reject_jumps([0, 1, 2], [48.0, 49.0, 50.0], [9.0] * 3, 10.0) == [False, True, False]


def test_place_on_track():
    from tracemill.operators import placement as L

    truth = np.r_[np.c_[np.linspace(0, 1000, 100), np.zeros(100)], np.c_[np.full(100, 1000.0), np.linspace(0, 500, 100)]]
    at = np.linspace(0, 199, 40).round().astype(int)
    seen, weight = truth[at] + np.random.default_rng(0).normal(0, 15, (40, 2)), np.ones(40)
    place = lambda route: L.place_on_track(route, at, seen, weight, truth[0], truth[-1], truth.mean(axis=0))
    placed, mode, angle, miss = place(L.turned(truth, 30.0) + [5000, 0])
    assert mode.startswith("startpin+turn") and abs(angle + 30) <= 1 and miss < 40
    assert place(truth * 2.2 + 70)[1].startswith("startpin_scaled")
    assert place(truth + [10.0, 0])[1] == "startpin"
    assert L.place_on_track(truth, at, seen + 9000, weight, truth[0] + 9000, truth[-1] + 9000, truth.mean(axis=0)) is None
    assert L.distinct_places([0, 0, 1, 0, 2, 1]) == [(1, 0, 3), (2, 2, 2), (3, 4, 1)]


def test_components_of_any_key(spark):
    from pyspark.sql import functions as F

    from tracemill.operators.components import components

    links = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 2, 3), ("a", 7, 8), ("a", 5, 5)], "s string, p int, q int")
    found = components(links, F.struct("s", F.col("p").alias("n")), F.struct("s", F.col("q").alias("n"))).collect()
    assert {tuple(r.node): r.root.n for r in found} == {("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("b", 2): 2, ("b", 3): 2, ("a", 7): 7, ("a", 8): 7}


def test_city_of_title(spark):
    from pyspark.sql import functions as F

    from tracemill.functions.gates import city_of_title

    cases = {"4K Driving in Ulm, Germany - rain": "Ulm, Germany", "Paris dashcam": "Paris", "Vienna downtown walk": "Vienna", "City tour (Neu Ulm)": "Neu Ulm", "walk in City, at night": None, "nothing here": None}
    rows = spark.createDataFrame(list(cases.items()), "title string, city string").withColumn("found", city_of_title(F.col("title"))).collect()
    assert {r.title: r.found for r in rows} == cases


def test_pose_chain_and_driving_plane():
    from tracemill.operators import poses as O

    turn = lambda a: np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    steps = [(turn(0.1 * i), np.array([0.1, 0.02 * i, -1.0])) if i != 2 else None for i in range(6)]
    rotation, shift, expected = np.eye(3), np.zeros(3), [np.zeros(3)]
    for step in steps:  # world to camera: R <- R_rel R, t <- R_rel t + t_rel
        if step is not None:
            rotation, shift = step[0] @ rotation, step[0] @ shift + step[1]
        expected.append(-rotation.T @ shift)
    assert np.allclose(O.chain_poses(steps), expected)
    # a left turn seen from above stays one, whatever the signs of the axes
    path = np.array([[0, 0, z] for z in np.linspace(0, 10, 20)] + [[-x, 0, 10] for x in np.linspace(0.5, 8, 16)], float)
    for tilt in (0.0, 0.2):
        flat = O.driving_plane(path + np.c_[np.zeros(36), tilt * path[:, 2], np.zeros(36)])
        a, b = flat[10] - flat[0], flat[-1] - flat[-5]
        assert a[0] * b[1] - a[1] * b[0] > 0
    assert np.allclose(O.driving_plane(path[:2]), path[:2, [0, 2]])
