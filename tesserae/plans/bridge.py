"""Deterministic geometry for tables that have none: our own mapping, for tests and benchmarks only.

Coordinates are whole numbers computed from keys, so that Spark and other engines agree to the bit.
Each table comes as a DataFrame here and as a SQL text of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import shapes

RECTS = "SELECT p_partkey AS id, CAST(p_partkey * 7919 % 2900 - 1450 AS DOUBLE) AS cx, CAST(p_partkey * 104729 % 2900 - 1450 AS DOUBLE) AS cy, CAST(p_size AS DOUBLE) AS w, CAST(p_size * 3 % 40 + 2 AS DOUBLE) AS h FROM part"
BOXES = f"SELECT id, cx - w AS min_x, cy - h AS min_y, cx + w AS max_x, cy + h AS max_y FROM ({RECTS})"
DISCS = "SELECT event_id AS seq, user_id, CAST(event_id * 7919 % 2900 - 1450 AS DOUBLE) AS x, CAST(event_id * 104729 % 2900 - 1450 AS DOUBLE) AS y, CAST(4 + event_id % 9 AS DOUBLE) AS radius FROM events"
SWEEPS = f"SELECT seq, x, y, x + seq * 31 % 41 - 20 AS x2, y + seq * 17 % 41 - 20 AS y2, radius + 0.3 AS radius FROM ({DISCS})"
POINTS = "SELECT c_custkey AS id, c_custkey * 137 % 36000 / 100.0 - 180.0 AS lon, c_custkey * 89 % 16900 / 100.0 - 84.5 AS lat, CAST(c_custkey * 7919 % 2900 - 1450 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 2900 - 1450 AS DOUBLE) AS y FROM customer"
CIRCLES = "SELECT s_suppkey AS cid, CAST(s_suppkey * 7919 % 2900 - 1450 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 2900 - 1450 AS DOUBLE) AS y, CAST(50 + s_suppkey * 13 % 200 AS DOUBLE) AS radius FROM supplier"
COVERED = "gx % 3 <> 0 OR gy % 5 < 3"  # which cells of the arena hold something


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, source: str, text: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))


def rects(spark, sf_dir):
    return _derived(spark, sf_dir, "part", RECTS)


def boxes(spark, sf_dir):
    return _derived(spark, sf_dir, "part", BOXES)


def discs(spark, sf_dir):
    return _derived(spark, sf_dir, "events", DISCS)


def sweeps(spark, sf_dir):
    return _derived(spark, sf_dir, "events", SWEEPS)


def points(spark, sf_dir):
    """Degrees are quotients of doubles, as in the other engine; Spark would read the SQL's literals as decimals, which end in other bits."""
    degrees = lambda turn, most, low: (F.col("c_custkey") * turn % most).cast("double") / 100.0 - low
    rest = table(spark, sf_dir, "customer").withColumns({"lon": degrees(137, 36000, 180.0), "lat": degrees(89, 16900, 84.5)})
    return rest.selectExpr("c_custkey AS id", "lon", "lat", "CAST(c_custkey * 7919 % 2900 - 1450 AS DOUBLE) AS x", "CAST(c_custkey * 104729 % 2900 - 1450 AS DOUBLE) AS y")


def circles(spark, sf_dir):
    return _derived(spark, sf_dir, "supplier", CIRCLES)


def coverage(spark):
    """Covered cells of the whole arena."""
    gx = spark.range(1500).withColumnRenamed("id", "gx")
    return gx.withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1499).cast("long")))).where(COVERED)


def polygons(spark, sf_dir):
    """Rectangles with a corner cut out and a hole: id and polygons."""
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    p = shapes.point
    outer = F.array(p(cx - w, cy - h), p(cx + w, cy - h), p(cx + w, cy), p(cx + w / 2, cy), p(cx + w / 2, cy + h), p(cx - w, cy + h), p(cx - w, cy - h))
    hole = F.array(p(cx - w / 2, cy - h / 2), p(cx - w / 2, cy - h / 4), p(cx, cy - h / 4), p(cx, cy - h / 2), p(cx - w / 2, cy - h / 2))
    return rects(spark, sf_dir).select("id", F.array(F.array(outer, hole)).alias("polygons"), "cx", "cy", "w", "h")


def pattern_words(spark, condition: str) -> DataFrame:
    """The cells of the arena that a condition on gx and gy holds for, as words."""
    rows = spark.range(1500 * 24).selectExpr("CAST(id DIV 24 AS INT) AS gy", "CAST(id % 24 AS INT) AS k")
    bits = f"aggregate(filter(sequence(0, 63), b -> k * 64 + b < 1500 AND ({condition.replace('gx', '(k * 64 + b)')})), 0L, (s, b) -> s | shiftleft(1L, b))"
    return rows.selectExpr("k DIV 4 AS cx", "gy DIV 256 AS cy", "gy % 256 * 4 + k % 4 AS w", f"{bits} AS bits").selectExpr("CAST(cx AS INT) AS cx", "CAST(cy AS INT) AS cy", "w", "bits").where("bits <> 0")
