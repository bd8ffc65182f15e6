"""Clipping of concave polygons with holes in column expressions, against the overlay kernel."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import shapes
from tesserae.operators import clip
from tesserae.operators import overlay as V

SHAPE = "array<array<struct<x:double,y:double>>>"


def row(polygon):
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in polygon]


def star(rng, n, far=64):
    """A ring around the origin with corners on a fine grid."""
    return [(round(math.cos(2 * math.pi * k / n) * r * 8) / 8, round(math.sin(2 * math.pi * k / n) * r * 8) / 8) for k in range(n) for r in [far * (0.35 + 0.65 * rng.random())]]


def clipped(spark, cases):
    df = spark.createDataFrame([(k, row(p), *map(float, b)) for k, (p, b) in enumerate(cases)], f"id int, p {SHAPE}, a double, b double, c double, d double")
    parts = clip.clip_polygons(df.withColumn("parts", F.array("p")), "parts", F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return {r["id"]: r for r in parts.select("id", "parts", shapes.multipolygon_area(F.col("parts")).alias("area")).collect()}


def same(spark, cases):
    got = clipped(spark, cases)
    for k, (p, (a, b, c, d)) in enumerate(cases):
        box = [[[(a, b), (c, b), (c, d), (a, d), (a, b)]]]
        want = V.overlay([[list(r) for r in p]], box, V.INTERSECTION)
        assert got[k]["area"] == pytest.approx(V.shape_area(want), abs=1e-6), (p, (a, b, c, d))
        assert sorted(len(x) for x in got[k]["parts"]) == sorted(len(x) for x in want), (p, (a, b, c, d))
        own = sorted(V.shape_area([[[(q["x"], q["y"]) for q in r] for r in x]]) for x in got[k]["parts"])
        assert own == pytest.approx(sorted(V.shape_area([x]) for x in want), abs=1e-6)


def test_stars_with_holes(spark):
    rng, cases = random.Random(1), []
    for _ in range(40):
        outer = star(rng, rng.randint(5, 16))
        if rng.random() < 0.5:
            outer = outer[::-1]
        hole = [(round(x * 0.3, 2), round(y * 0.3, 2)) for x, y in outer]
        polygon = [[*outer, outer[0]], [*hole, hole[0]]] if rng.random() < 0.6 else [outer]
        x, y = rng.uniform(-60, 20) + 0.013, rng.uniform(-60, 20) + 0.017
        cases.append((polygon, (x, y, x + rng.uniform(5, 80), y + rng.uniform(5, 80))))
    same(spark, cases)


def test_combs_fall_apart_and_sides_on_the_cut(spark):
    comb = [(0, 0), (70, 0), (70, 50), (60, 50), (60, 10), (50, 10), (50, 50), (40, 50), (40, 10), (30, 10), (30, 50), (20, 50), (20, 10), (10, 10), (10, 50), (0, 50)]
    court = [[(0, 0), (40, 0), (40, 40), (0, 40)], [(10, 10), (30, 10), (30, 30), (10, 30)]]
    cases = [([comb], (-5, 20, 100, 40)), ([comb], (15, 5, 55, 45)), ([comb], (0, 0, 70, 50)), ([comb], (0, 10, 70, 50)), ([comb], (100, 0, 120, 50)), ([comb], (5, 15, 65, 60)), (court, (20, -5, 60, 50)), (court, (5, 5, 35, 35)), (court, (12, 12, 28, 28)), (court, (-5, -5, 50, 50))]
    got = clipped(spark, cases)
    assert [len(got[k]["parts"]) for k in range(10)] == [4, 1, 1, 4, 0, 4, 1, 1, 0, 1]
    assert [got[k]["area"] for k in range(10)] == [4 * 200, 40 * 5 + 2 * 350 + 10 * 0 + 0, 70 * 10 + 4 * 400, 4 * 400, 0, 350 * 2 + 175 * 2, 20 * 40 - 10 * 20, 900 - 400, 0, 1600 - 400]
    assert sum(len(p) for p in got[7]["parts"]) == 2 and len(got[6]["parts"][0]) == 1


def test_touching_corners_and_empty_polygons(spark):
    diamond = [(0, 0), (10, 10), (0, 20), (-10, 10)]
    notch = [(0, 0), (20, 0), (20, 20), (10, 10), (0, 20)]
    got = clipped(spark, [([diamond], (10, 0, 20, 20)), ([diamond], (-10, 0, 10, 20)), ([notch], (0, 10, 20, 20)), ([notch], (-5, -5, 25, 10)), ([], (0, 0, 1, 1))])
    assert [got[k]["area"] for k in range(5)] == [0, 200, 100, 200, 0] and len(got[2]["parts"]) == 2
