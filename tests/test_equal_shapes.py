"""Work of spatial operators grows with the number of different shapes, and expressions with the number of their steps."""

import time

import pytest
from pyspark.sql import functions as F

from tesserae.functions import shapes
from tesserae.operators import containment, features, grids, spatial_join

COPIES = 4000
BOX = ["0.0D AS min_x", "0.0D AS min_y", "8.0D AS max_x", "4.0D AS max_y"]


def square(at=0.0):
    return F.array(F.array(shapes.rectangle_ring(*(F.lit(v + at) for v in (0.0, 0.0, 8.0, 4.0)))))


def copies(spark, **columns):
    return spark.range(COPIES).select("id", *(c.alias(n) for n, c in columns.items()))


def took(df):
    began = time.monotonic()
    return df.agg(F.count("*"), F.min(df.columns[1])).first(), time.monotonic() - began


def test_a_chain_of_cuts_names_its_ring_once(spark):
    ring = F.col("ring")
    one, four = (len(str(c)) for c in (shapes.clip_half_plane(ring, "x", 1.0, True), shapes.clip_to_box(ring, 1.0, 1.0, 2.0, 2.0)))
    assert four < 8 * one  # each cut named the one before three times


@pytest.mark.parametrize("other", [4, 40])
def test_spread_sides_are_not_broadcast(spark, other):
    boxes = spark.range(other).selectExpr("id", *BOX)
    plan = spatial_join.bbox_join(boxes, boxes.withColumnRenamed("id", "other"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    views = spark.range(other).selectExpr("id", "1.0D AS west", "2.0D AS south", "1.1D AS east", "2.1D AS north")
    assert "Join" not in grids.visible_cells(views, "id")._jdf.queryExecution().executedPlan().toString()


def test_equal_points_and_regions_meet_once(spark):
    points, regions = copies(spark, x=F.lit(2.0), y=F.lit(3.0)), copies(spark, polygons=square()).withColumnRenamed("id", "region")
    got, seconds = took(spatial_join.region_of(points, regions, "id"))
    assert tuple(got) == (COPIES, 0) and seconds < 20  # 16 million tests of a point in a polygon took longer
    got, seconds = took(containment.nearest_land(points.withColumn("x", F.lit(10.0)), regions).select("id", "land_x"))
    assert tuple(got) == (COPIES, 8.0) and seconds < 30
    parts = points.withColumn("shape", F.struct(F.lit(1.0).alias("at")))
    parents = spark.range(COPIES).selectExpr(*BOX).withColumn("shape", F.struct(F.lit(1.0).alias("at")))
    asked = features.parts_within(parts, parents, 128.0, lambda a, b: a["at"] == b["at"])
    assert asked.count() == COPIES


def test_pairs_of_equals_are_asked_for_once_and_all_come_out(spark):
    a, b = spark.range(300).selectExpr("id AS a", "id % 3 AS x"), spark.range(200).selectExpr("id AS b", "NULLIF(id % 4, 3) AS y")
    asked = []

    def pairs(left, right):
        asked.append((left.count(), right.count()))
        return left.join(right, F.col("x").eqNullSafe(F.col("y")))

    got = spatial_join.of_equals(a, b, ("a", "b"), (["x"], ["y"]), pairs)
    want = a.join(b, F.col("x") == F.col("y")).select("a", "b")
    assert asked == [(3, 4)] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
