import math
import random

import pandas as pd
import pytest

from tesserae.operators import overlay as V
from tesserae.sources import tiles as T


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_overlay_of_overlapping_squares():
    a, b = [[box(0, 0, 4, 4)]], [[box(2, 2, 6, 6)]]
    assert V.overlay_area(a, b, V.UNION) == 28 and V.overlay_area(a, b, V.INTERSECTION) == 4 and V.overlay_area(a, b, V.DIFFERENCE) == 12
    assert len(V.overlay(a, b, V.UNION)) == 1 and len(V.overlay(a, b, V.UNION)[0][0]) == 9


def test_a_lake_makes_a_hole_and_a_river_two_parts():
    land = V.land_regions([[box(-100, -100, 100, 100)]])
    assert len(land) == 1 and land[0]["area"] == 16_000_000 - 40_000 and len(land[0]["polygons"][0]) == 2
    parts = V.land_regions([[box(-2000, -10, 2000, 10)]])
    assert sorted(p["area"] for p in parts) == [4000 * 1990, 4000 * 1990]


def test_areas_agree_with_sampling():
    rng = random.Random(5)
    for _ in range(8):
        tri = lambda: [[[(rng.randint(0, 20), rng.randint(0, 20)) for _ in range(3)]]]
        a, b = tri(), tri()
        union, cut = V.overlay_area(a, b, V.UNION), V.overlay_area(a, b, V.INTERSECTION)
        assert math.isclose(union + cut, V.shape_area(a) + V.shape_area(b), abs_tol=1e-9)
        assert math.isclose(V.shape_area(V.overlay(a, b, V.UNION)), union, abs_tol=1e-9)


def test_enclosing_circle_against_all_supports():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 12):
        points = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(n)]
        x, y, r = V.enclosing_circle(points)
        assert all(math.dist(p, (x, y)) <= r + 1e-7 for p in points)
        if 2 <= n <= 4:
            assert math.isclose(r, V._smallest(points)[1][2], rel_tol=1e-9)
    assert V.enclosing_circle([]) == (0.0, 0.0, 0.0)


def test_motion_stops_at_water_and_slides():
    path = V.slide(0, 0, 30, 10, [[box(-20, -20, 20, 20)]])
    assert math.isclose(path[1][0], 20, abs_tol=1e-6) and math.isclose(path[-1][1], 10, abs_tol=1e-6)
    assert V.earliest_touch(0, 0, 10, 0, 1, (5, -3), (5, 3)) == pytest.approx(0.4)
    assert V.collision(0.5, 0, 1, [[box(1, -1, 3, 1)]])[:2] == pytest.approx((-1, 0))


def test_relations_are_assembled(spark):
    ring = [[(0, 0), (4, 0), (4, 4)], [(0, 0), (0, 4), (4, 4)]]
    rows = [(1, "outer", [{"x": float(x), "y": float(y)} for x, y in line]) for line in ring] + [(1, "inner", [{"x": float(x), "y": float(y)} for x, y in box(1, 1, 2, 2)]), (2, "outer", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}])]
    df = spark.createDataFrame(rows, "rel long, role string, line array<struct<x:double,y:double>>")
    found = {r["rel"]: r["polygons"] for r in V.assemble_relations(df).collect()}
    assert V.shape_area(V.from_rows(found[1])) == 15 and found[2] is None


tile = T.encode_tile


def open_box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def certified(spark, *tiles):
    """Buildings of tiles (x, y, features) around the equator."""
    rows = [(x, y, bytearray(tile("building", [(p, r) for p, r in features]))) for x, y, features in tiles]
    df = spark.createDataFrame(rows, "x int, y int, content binary")
    centers = spark.createDataFrame([(0.0, 0.0, 0.0)], "lon double, lat double, basis double")
    return T.whole_buildings(T.building_fragments(df), centers, label="name").collect()


def test_tiles_read_from_files_stitch_across_a_seam(spark, tmp_path):
    left = tile("building", [({"render_height": 9.0}, [open_box(4000, 100, 4160, 200)])])
    right = tile("building", [({"render_height": 9.0}, [open_box(-96, 100, 80, 200)]), ({}, [open_box(1000, 1000, 1100, 1100)])])
    for x, data in ((8192, left), (8193, right)):
        (tmp_path / "14" / str(x)).mkdir(parents=True)
        (tmp_path / "14" / str(x) / "8191.pbf").write_bytes(data)
    read = T.read_tiles(spark, str(tmp_path))
    assert T.tile_fragments(read, "building", 0.011, 0.01).count() == 3
    centers = spark.createDataFrame([(0.011, 0.01, 0.01)], "lon double, lat double, basis double")
    whole = sorted(T.whole_buildings(T.building_fragments(read), centers).select("fragments", "complete", "area").collect())
    assert [(r["fragments"], r["complete"]) for r in whole] == [(1, True), (2, True)]
    cell = (2 * math.pi * 6378137 / 16384 / 4096) ** 2
    assert whole[1]["area"] == pytest.approx(176 * 100 * cell, rel=1e-3)


def test_touching_houses_stay_apart_and_overlaps_merge(spark):
    a, b, c = open_box(100, 100, 150, 150), open_box(150, 100, 200, 150), open_box(110, 110, 140, 140)
    found = certified(spark, (8192, 8192, [({"name": "1"}, [a]), ({"name": "2"}, [b]), ({"name": "3"}, [c]), ({"name": "4"}, [a])]))
    assert sorted((r["label"], r["fragments"], r["complete"]) for r in found) == [("1", 3, True), ("2", 1, True)]
    assert all(r["radius"] > 0 for r in found)


def test_cut_walls_need_their_counterpart(spark):
    rings = [open_box(-50, 100, 50, 200), open_box(-20, 120, 20, 180)[::-1]]
    left = [[(x + 4096, y) for x, y in ring] for ring in rings]
    a, b = (8191, 8192, [({"render_height": 5.0}, left)]), (8192, 8192, [({"render_height": 5.0}, rings)])
    (whole,) = certified(spark, a, b)
    assert whole["complete"] and whole["fragments"] == 2 and len(whole["polygons"][0]) == 2 and whole["height"] == 5
    for tiles in ((a,), (a, (8192, 8192, [])), (a, (8193, 8192, b[2]))):
        assert not any(r["complete"] or r["polygons"] for r in certified(spark, *tiles))
    # contradictory heights stay uncertified, and so does a neighbour that covers a part of the wall only
    assert [r["complete"] for r in certified(spark, a, (8192, 8192, [({"render_height": 50.0}, rings)]))] == [False, False]
    assert not any(r["complete"] for r in certified(spark, a, (8192, 8192, [({"render_height": 5.0}, [open_box(-50, 100, 50, 150)])])))
    # two neighbours that cover it together
    halves = [({"render_height": 5.0}, [open_box(-50, 100, 50, 160)]), ({"render_height": 5.0}, [open_box(-50, 150, 50, 200)])]
    (whole,) = certified(spark, (8191, 8192, [({"render_height": 5.0}, [[(x + 4096, y) for x, y in open_box(-50, 100, 50, 200)]])]), (8192, 8192, halves))
    assert whole["complete"] and whole["fragments"] == 3


def test_a_corner_on_a_seam_needs_a_neighbour(spark):
    diamond = [(4096, 150), (4046, 200), (3996, 150), (4046, 100)]
    assert [r["complete"] for r in certified(spark, (8192, 8192, [({}, [diamond])]))] == [False]
    assert [r["complete"] for r in certified(spark, (8192, 8192, [({}, [[(x - 1, y) for x, y in diamond]])]))] == [True]


def test_wide_buildings_and_differing_heights(spark):
    wide = certified(spark, (8192, 8192, [({}, [open_box(100, 100, 2000, 200)])]))
    assert [(r["complete"], r["polygons"]) for r in wide] == [(True, None)]
    (two,) = certified(spark, (8192, 8192, [({"render_height": 3.0}, [open_box(100, 100, 200, 200)]), ({"render_height": 30.0}, [[(150, 150), (400, 160), (260, 190), (300, 300), (150, 250)]])]))
    assert two["complete"] and two["height"] is None and len(two["polygons"][0][0]) > 8


def test_kernels_take_shapes_of_many_parts(spark):
    shape = [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p] for p in ([box(0, 0, 9, 9), box(1, 1, 2, 2)], [[(20, 0), (30, 0), (25, 5), (20, 0)]])]
    df = spark.createDataFrame([(1, shape)], "id long, polygons array<array<array<struct<x:double,y:double>>>>")
    assert V.circles_of(df, "id").first()["radius"] == pytest.approx(V.enclosing_circle([(0, 0), (9, 9), (0, 9), (30, 0), (25, 5)])[2])
    assert V.footprints_of(df, "id").first()["area"] == 81 - 1 + 25
    assert V.water_boundary(df, "id").count() > 1


def test_water_policy_fails_closed(spark):
    good = pd.DataFrame({"z": [14], "x": [0], "y": [0], "content": [tile("water", [({"class": "lake"}, [[(0, 0), (9, 0), (9, 9)]]), ({"class": "dock"}, [[(0, 0), (9, 0), (9, 9)]])])]})
    bad = pd.DataFrame({"z": [14], "x": [0], "y": [0], "content": [tile("water", [({"class": "lava"}, [[(0, 0), (9, 0), (9, 9)]])])]})
    schema = "z int, x int, y int, content binary"
    assert T.water_features(spark.createDataFrame(good, schema), 0, 0).count() == 1
    with pytest.raises(Exception, match="unknown water class"):
        T.water_features(spark.createDataFrame(bad, schema), 0, 0).collect()


def outside(x, y, shape):
    """Distance from a polygon's boundary, negative inside, by its definition."""
    edges = [(a, b) for ring in shape[0] for a, b in zip(ring, ring[1:])]
    far, odd = math.inf, False
    for (ax, ay), (bx, by) in edges:
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        far = min(far, math.dist((x, y), (ax + t * (bx - ax), ay + t * (by - ay))))
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return -far if odd else far


def test_collisions_push_out_the_shortest_way():
    rng, shape = random.Random(4), [[box(0, 0, 10, 6), box(3, 2, 5, 4)]]
    for _ in range(300):
        x, y, r = rng.uniform(-3, 13), rng.uniform(-3, 9), rng.uniform(0.1, 3)
        found, d = V.collision(x, y, r, shape), outside(x, y, shape)
        assert (found is None) == (d >= r - 1e-8)
        if found:
            assert math.isclose(found[2], r - d, abs_tol=1e-9) and math.isclose(math.hypot(*found[:2]), 1)
            # along the normal, the distance grows by what is left to the way out
            assert outside(x + found[0] * 0.01, y + found[1] * 0.01, shape) > d


@pytest.mark.parametrize(("x", "y", "normal"), [(0, 3, (-1, 0)), (10, 3, (1, 0)), (5, 0, (0, -1)), (5, 6, (0, 1)), (3, 3, (1, 0)), (4, 4, (0, -1)), (0, 0, (-(0.5**0.5), -(0.5**0.5)))])
@pytest.mark.parametrize("wind", [1, -1])
def test_collisions_on_the_boundary_push_outwards(x, y, normal, wind):
    found = V.collision(x, y, 1, [[box(0, 0, 10, 6)[::wind], box(3, 2, 5, 4)[::wind]]])
    assert found[:2] == pytest.approx(normal) and found[2] == pytest.approx(1)


def test_only_approaching_circles_touch():
    wall = ((0.5, -3), (0.5, 3))
    assert V.earliest_touch(0, 0, 10, 0, 1, *wall) is None and V.earliest_touch(0, 0, -10, 0, 1, *wall) is None
    assert V.earliest_touch(-0.5, 0, 10, 0, 1, *wall) == 0 and V.earliest_touch(-0.5, 0, -10, 0, 1, *wall) is None
    assert V.earliest_touch(-5, 0, 0, 10, 1, *wall) is None and V.earliest_touch(-5, 0, 2, 0, 1, *wall) is None
    rng = random.Random(6)
    for _ in range(200):
        p = [rng.uniform(-5, 5) for _ in range(8)]
        a, b, r = (p[4], p[5]), (p[6], p[7]), rng.uniform(0.1, 2)
        gap = lambda t: outside(p[0] + p[2] * t, p[1] + p[3] * t, [[[a, b, a]]]) - r
        found = V.earliest_touch(*p[:4], r, a, b)
        steps = [gap(k / 2000) for k in range(2001)]
        if steps[0] <= 0 or min(steps) > 0:
            assert found is None or (steps[0] > 0 and min(steps) < 1e-3)
        else:
            first = next(k for k, g in enumerate(steps) if g <= 0) / 2000
            assert found == pytest.approx(first, abs=1e-3)
