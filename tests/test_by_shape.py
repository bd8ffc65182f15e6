"""Queries over shapes ask once for each different shape, in several tasks, and broadcast nothing that shapes spread to."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import cells, spatial_join, words
from tesserae.plans import overlays, raster


def test_each_shape_is_asked_for_once(spark):
    rows = spark.range(300).selectExpr("id", "NULLIF(id % 4, 3) AS x")
    asked = []

    def work(one):
        asked.append((one.count(), one.rdd.getNumPartitions()))
        return one.select("id", (F.coalesce("x", F.lit(9)) * 2).alias("y"))

    got = {r["id"]: r["y"] for r in spatial_join.by_shape(rows, "id", ["x"], work).select("id", "y").collect()}
    assert got == {k: (18 if k % 4 == 3 else k % 4 * 2) for k in range(300)}
    assert asked == [(4, 4)]


@pytest.mark.parametrize("name", ["consume_whole_atomic", "footprint_state"])
def test_words_by_shape_are_not_broadcast(spark, name):
    boxes = spark.range(20).selectExpr("id", "0.0D AS min_x", "0.0D AS min_y", "8.0D AS max_x", "4.0D AS max_y")
    foot = words.span_words(cells.rectangle_spans(boxes), ("id",))
    cover = spark.createDataFrame([(2, 2, k, -1) for k in range(1024)], "cx int, cy int, w int, bits long")
    if name == "footprint_state":
        told = words.footprint_state(foot, cover, cover.where("w < 0"), "id")
        assert {r["state"] for r in told.collect()} == {"untouched"}
    else:
        told = words.consume(foot, cover, cover.where("w < 0"), "id", spark.createDataFrame([(2, 2)], "cx int, cy int"))
        assert sorted((r["id"], r["area_m2"]) for r in told.collect()) == [(0, 32)] + [(k, 0) for k in range(1, 20)]
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan


@pytest.mark.parametrize("query", [raster.raster_polygon, raster.footprint_state, raster.consume_whole_atomic, overlays.overlay_shapes, overlays.active_land, overlays.lost_vertices])
def test_shapes_are_dealt_to_as_many_tasks_as_there_are(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_neighbours_among_many_equal_places(spark):
    points, places = spark.range(40).selectExpr("id", "double(id % 4) AS x", "0.0D AS y"), spark.range(3000).selectExpr("id AS target", "double(id % 3) AS px", "0.0D AS py")
    from tesserae.operators import containment

    got = containment.nearest(points, places, "id", "target", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")), 2)
    want = {0: [0, 3], 1: [1, 4], 2: [2, 5], 3: [2, 5]}
    found = {}
    for r in got.orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["target"])
    assert found == {k: want[k % 4] for k in range(40)}


def test_views_are_dealt_before_they_spread(spark):
    from tesserae.operators import grids

    views = spark.range(20).selectExpr("id", "0.5D AS mx", "0.5D AS my", "5.0D AS zoom", "300.0D AS width", "300.0D AS height")
    plan = grids.visual_tiles(views, "id")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_fragments_of_buildings_are_not_broadcast(spark):
    from tesserae.plans import tiles
    from tesserae.sources.tiles import building_fragments, whole_buildings

    source = tiles.seam_tiles(spark, "/root/testdata/sf0.001")
    centers = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "sector long, lon double, lat double, basis double")
    plan = whole_buildings(building_fragments(source, ("sector",)), centers, ("sector",), "fid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2  # that with the centres, named once more in what is initial
