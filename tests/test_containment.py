"""Indexed containment, exact neighbours and nearest land against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import shapes
from tesserae.operators import containment as C

POLYGONS = "polygons array<array<array<struct<x:double,y:double>>>>"


def rows(rings):
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in rings]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def star(n, rng, far=1000.0):
    return [(math.cos(2 * math.pi * k / n) * r, math.sin(2 * math.pi * k / n) * r) for k in range(n) for r in [far * (0.4 + 0.6 * rng.random())]]


def test_edge_rows_leave_out_what_has_no_length(spark):
    df = spark.createDataFrame([(1, rows([[box(0, 0, 3, 4)], [[(0, 0), (0, 0), (3, 4)]]])), (2, []), (3, None)], f"region long, {POLYGONS}")
    found = C.edge_rows(df).collect()
    assert len(found) == 4 + 2 and all(abs(math.hypot(r["tx"], r["ty"]) - 1) < 1e-12 for r in found)
    assert {(r["min_x"], r["max_y"]) for r in found if r["edge"]["__p"] == 1} == {(0.0, 4.0)}


def test_against_the_expression_on_corners_walls_and_holes(spark):
    shape = [[box(0, 0, 40, 30), box(10, 10, 20, 20)], [[(50, 0), (70, 0), (60, 25)]], [[(-20, 5), (-5, -15), (-10, 5), (-5, 25)]]]
    df = spark.createDataFrame([(1, rows(shape)), (2, rows([[box(5, 5, 65, 15)]]))], f"region long, {POLYGONS}")
    points = [(float(x), float(y)) for x in range(-22, 74, 2) for y in range(-16, 32, 2)] + [(55.0, 12.5), (65.0, 12.5), (10.0, 10.0), (15.0, 10.0), (15.0, 15.0), (-7.5, 5.0)]
    at = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "id long, x double, y double")
    got = {(r["id"], r["region"]) for r in C.contained(at, C.edge_rows(df), band=7.0).collect()}
    want = {(r["id"], r["region"]) for r in at.crossJoin(df).where(shapes.in_multipolygon(F.col("x"), F.col("y"), F.col("polygons"))).collect()}
    assert got == want and len(got) > 200


def test_a_hundred_thousand_vertices_split_over_tasks(spark):
    rng = random.Random(1)
    ring = star(100_000, rng)
    df = spark.createDataFrame([(1, rows([[ring]]))], f"region long, {POLYGONS}")
    rng2 = np.random.default_rng(2)
    p = rng2.uniform(-1000, 1000, (400, 2))
    at = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "id long, x double, y double")
    got = {r["id"] for r in C.contained(at, C.edge_rows(df)).collect()}
    a, b = np.array(ring), np.roll(np.array(ring), -1, axis=0)
    odd = [int(((a[:, 1] > y) != (b[:, 1] > y)).astype(bool)[x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / np.where(a[:, 1] == b[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0]].sum()) % 2 for x, y in p]
    assert got == {k for k, o in enumerate(odd) if o} and 50 < len(got) < 350


def test_regions_of_other_groups_are_not_met(spark):
    df = spark.createDataFrame([(1, "a", rows([[box(0, 0, 10, 10)]])), (2, "b", rows([[box(0, 0, 10, 10)]]))], f"region long, town string, {POLYGONS}")
    edges = C.edge_rows(df).join(df.select("region", "town"), "region")
    at = spark.createDataFrame([(1, "a", 5.0, 5.0), (2, "b", 5.0, 5.0), (3, "c", 5.0, 5.0)], "id long, town string, x double, y double")
    assert sorted((r["town"], r["id"], r["region"]) for r in C.contained(at, edges, within=("town",)).collect()) == [("a", 1, 1), ("b", 2, 2)]


def brute(points, targets, k):
    out = {}
    for i, x, y in points:
        out[i] = [t for _, t in sorted((math.hypot(px - x, py - y), t) for t, px, py in targets)[:k]]
    return out


def found(points, targets, k, spark, **kw):
    a, b = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(targets, "target long, px double, py double")
    got = C.nearest(a, b, "id", "target", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")), k, **kw)
    out = {i: [] for i, *_ in points}
    for r in got.orderBy("id", "rank").collect():
        out[r["id"]].append(r["target"])
        assert len(out[r["id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_of_clusters_lines_and_far_points(spark, k):
    rng = random.Random(3)
    targets = [(t, rng.gauss(0, 1), rng.gauss(0, 1)) for t in range(150)] + [(200 + t, 5000 + t * 10.0, -3000.0) for t in range(40)] + [(300 + t, 7.0, 7.0) for t in range(12)]
    points = [(i, rng.gauss(0, 3), rng.gauss(0, 3)) for i in range(40)] + [(100 + i, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for i in range(40)] + [(500, 1e6, 1e6), (501, 7.0, 7.0), (502, 5000.0, -3000.0)]
    assert found(points, targets, k, spark) == brute(points, targets, k)
    assert found(points, targets, k, spark, base=0.5) == brute(points, targets, k)


def test_nearest_with_few_or_no_targets_and_missing_points(spark):
    points = [(1, 0.0, 0.0), (2, 50.0, 50.0)]
    assert found(points, [(9, 3.0, 4.0), (8, 3.0, 4.0)], 5, spark) == {1: [8, 9], 2: [8, 9]}
    assert found(points, [], 3, spark) == {1: [], 2: []}
    assert found([(1, 0.0, 0.0), (2, None, 1.0), (3, math.nan, 1.0)], [(9, 1.0, 1.0)], 1, spark) == {1: [9], 2: [], 3: []}


def test_nearest_land_is_the_point_itself_or_on_a_wall(spark):
    shape = [[box(0, 0, 40, 30), box(10, 10, 20, 20)], [star(60, random.Random(5), 30.0)], [[(100, 100), (900, 110), (100, 120)]]]
    df = spark.createDataFrame([(1, rows(shape[:1])), (2, rows([[[(x + 300, y) for x, y in shape[1][0]]]])), (3, rows(shape[2:]))], f"region long, {POLYGONS}")
    rng = random.Random(6)
    points = [(k, rng.uniform(-100, 1000), rng.uniform(-100, 300)) for k in range(120)] + [(500, 15.0, 15.0), (501, 20.0, 30.0), (502, -5.0, 0.0)]
    at = spark.createDataFrame(points, "id long, x double, y double")
    got = {r["id"]: r for r in C.nearest_land(at, df).collect()}
    edges = [(r["ax"], r["ay"], r["bx"], r["by"]) for r in C.edge_rows(df).collect()]
    inside = {r["id"] for r in C.contained(at, C.edge_rows(df)).collect()}
    for k, x, y in points:
        def away(e):
            t = max(0, min(1, ((x - e[0]) * (e[2] - e[0]) + (y - e[1]) * (e[3] - e[1])) / ((e[2] - e[0]) ** 2 + (e[3] - e[1]) ** 2)))
            return math.hypot(x - e[0] - t * (e[2] - e[0]), y - e[1] - t * (e[3] - e[1]))

        want = 0.0 if k in inside else min(map(away, edges))
        assert got[k]["distance"] == pytest.approx(want, abs=1e-9) and math.hypot(got[k]["land_x"] - x, got[k]["land_y"] - y) == pytest.approx(want, abs=1e-9)
    assert got[500]["distance"] == 5 and got[501]["distance"] == 0 and len(got) == len(points)


def test_reachability_needs_a_way_within_the_radius(spark):
    active = box(-1500, -1500, 200, 1500)
    land = spark.createDataFrame([(1, rows([[active]]), rows([[[*active[:2], (200, 1700), (-1500, 1700)]], [box(400, 1550, 600, 1900)]]))], "region long, active array<array<array<struct<x:double,y:double>>>>, allowed array<array<array<struct<x:double,y:double>>>>")
    cases = [(1, 0.0, 0.0, 0.0, True), (2, 0.0, 1600.0, 50.0, False), (3, 0.0, 1600.0, 100.0, True), (4, 500.0, 1600.0, 500.0, False), (5, 0.0, 1701.0, 500.0, False), (6, 200.0, 1500.0, 0.0, True), (7, 300.0, 0.0, 500.0, False), (8, 0.0, 0.0, -3.0, True)]
    points = spark.createDataFrame([(k, 1, x, y, r) for k, x, y, r, _ in cases] + [(99, 2, 0.0, 0.0, 1.0)], "id long, region long, x double, y double, radius double")
    assert {r["id"]: r["reachable"] for r in C.reachable(points, land).collect()} == {k: ok for k, *_, ok in cases} | {99: False}
