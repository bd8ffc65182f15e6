"""Queries over regions of land: containment, the nearest land, reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import frames as f
from tesserae.functions import shapes
from tesserae.operators import containment, spatial_join

from . import bridge as B


def _regions(spark, sf_dir):
    return B.polygons(spark, sf_dir).select(F.col("id").alias("region"), "polygons")


def indexed_containment(spark, sf_dir):
    """Which buildings hold which points, many of them on corners and walls, by edges in bands."""
    holds = lambda points, regions: containment.contained(points, containment.edge_rows(regions))
    return spatial_join.of_equals(B.points(spark, sf_dir), _regions(spark, sf_dir), ("id", "region"), (["x", "y"], ["polygons"]), holds)


HOLDS = "x BETWEEN cx - w AND cx + w AND y BETWEEN cy - h AND cy + h AND NOT (x > cx + w / 2 AND y > cy) AND NOT (x > cx - w / 2 AND x < cx AND y > cy - h / 2 AND y < cy - h / 4)"
CONTAINMENT = f"SELECT p.id, r.id AS region FROM ({B.POINTS}) p JOIN ({B.RECTS}) r ON {HOLDS}"


def nearest_land(spark, sf_dir):
    """How far each point is from the nearest building, courtyards being outside."""
    found = containment.nearest_land(B.points(spark, sf_dir).select("id", "x", "y"), _regions(spark, sf_dir))
    back = F.hypot(F.col("land_x") - F.col("x"), F.col("land_y") - F.col("y"))
    return found.join(B.points(spark, sf_dir).select("id", "x", "y"), "id").select("id", f.half_up(F.col("distance"), 6).alias("distance"), f.half_up(back, 6).alias("moved"))


# outer walls and those of the courtyard, each as a box without width
WALLS = " UNION ALL ".join(
    f"SELECT id, {a} AS x0, {b} AS y0, {c} AS x1, {d} AS y1 FROM ({B.RECTS})"
    for a, b, c, d in (
        ("cx - w", "cy - h", "cx + w", "cy - h"), ("cx + w", "cy - h", "cx + w", "cy"), ("cx + w / 2", "cy", "cx + w", "cy"), ("cx + w / 2", "cy", "cx + w / 2", "cy + h"), ("cx - w", "cy + h", "cx + w / 2", "cy + h"),
        ("cx - w", "cy - h", "cx - w", "cy + h"), ("cx - w / 2", "cy - h / 2", "cx - w / 2", "cy - h / 4"), ("cx - w / 2", "cy - h / 4", "cx", "cy - h / 4"), ("cx", "cy - h / 2", "cx", "cy - h / 4"), ("cx - w / 2", "cy - h / 2", "cx", "cy - h / 2"),
    )
)
NEAREST_LAND = f"""WITH p AS ({B.POINTS}), i AS (SELECT DISTINCT id FROM ({CONTAINMENT})), d AS (SELECT p.id, min(pow(greatest(0, x0 - x, x - x1), 2) + pow(greatest(0, y0 - y, y - y1), 2)) AS d2 FROM p, ({WALLS}) e GROUP BY 1)
SELECT p.id, floor(d * 1e6 + 0.5) / 1e6 AS distance, floor(d * 1e6 + 0.5) / 1e6 AS moved FROM (SELECT p.id, CASE WHEN i.id IS NOT NULL THEN 0.0 ELSE sqrt(d2) END AS d FROM p JOIN d USING (id) LEFT JOIN i USING (id)) p"""

# active land west of a river; beyond the arena a neck, a corridor and an arm down the other side
LAND = "SELECT CAST(n_nationkey AS BIGINT) AS region, CAST(200 + n_nationkey * 20 AS DOUBLE) AS a, CAST(100 + n_nationkey * 11 AS DOUBLE) AS g, CAST(n_nationkey * 5 - 400 AS DOUBLE) AS n FROM nation"
HOLES = "SELECT c_custkey AS id, CAST(c_custkey % 25 AS BIGINT) AS region, CAST(c_custkey * 7919 % 4001 - 2000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 4001 - 2000 AS DOUBLE) AS y, CAST(c_custkey * 31 % 600 AS DOUBLE) AS radius FROM customer"


def reachable_land(spark, sf_dir):
    """Whether holes of many sizes can be at points on and off the land, some of it reached through a corridor outside the arena only."""
    land = spark.sql(LAND.replace("FROM nation", "FROM {nation}"), nation=B.table(spark, sf_dir, "nation"))
    a, g, n = (F.col(c) for c in "agn")
    ring = lambda *points: F.array(*(shapes.point(F.lit(x).cast("double") if isinstance(x, int) else x, F.lit(y).cast("double") if isinstance(y, int) else y) for x, y in points))
    active = ring((-1500, -1500), (a, -1500), (a, 1500), (-1500, 1500), (-1500, -1500))
    allowed = ring((-1500, -1500), (a, -1500), (a, 1500), (n + 100, 1500), (n + 100, g + 1500), (1600, g + 1500), (1600, -1000), (1900, -1000), (1900, 1900), (n, 1900), (n, 1500), (-1500, 1500), (-1500, -1500))
    land = land.select("region", F.array(F.array(active)).alias("active"), F.array(F.array(allowed)).alias("allowed"))
    holes = spark.sql(HOLES.replace("FROM customer", "FROM {customer}"), customer=B.table(spark, sf_dir, "customer"))
    return containment.reachable(holes, land)


REACHABLE = f"""WITH p AS (SELECT *, least(500.0, radius) AS o FROM ({HOLES}) JOIN ({LAND}) USING (region))
SELECT id, abs(x) <= 1500 + o AND abs(y) <= 1500 + o AND ((x BETWEEN -1500 AND a AND y BETWEEN -1500 AND 1500) OR (o > 0 AND x BETWEEN n AND n + 100 AND y BETWEEN 1500 AND 1500 + g)
  OR (o > g AND ((x BETWEEN n AND 1900 AND y BETWEEN 1500 + g AND 1900) OR (x BETWEEN 1600 AND 1900 AND y BETWEEN -1000 AND 1900)))) AS reachable FROM p"""

QUERIES = {"indexed_containment": (indexed_containment, CONTAINMENT), "nearest_land": (nearest_land, NEAREST_LAND), "reachable_land": (reachable_land, REACHABLE)}
