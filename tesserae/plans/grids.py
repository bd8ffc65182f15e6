"""Queries over frames, grids and geometry expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import frames as f
from tesserae.functions import shapes
from tesserae.operators import grids

from . import bridge as B

D = f.DEGREE
STEP = f.LATITUDE_STEP
R = 6378137.0
LIMIT = f.ROWS_PER_HEMISPHERE
HALF6 = "floor(({0}) * 1e6 + 0.5) / 1e6"


def r6(c):
    return f.half_up(c, 6)


def s6(text):
    return HALF6.format(text)


CIRC = repr(f.CIRCUMFERENCE)
COLUMNS = f"CAST(least({int(f.CIRCUMFERENCE / 3000)}, greatest(1, floor({CIRC} * cos((row * {STEP!r} + (row + 1) * {STEP!r}) / 2 * {D!r}) / 3000.0 + 0.5))) AS BIGINT)"
WRAP = "(({0}) + 180.0 - 360.0 * floor((({0}) + 180.0) / 360.0) - 180.0)"
PT = f"(SELECT id, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, x, y FROM ({B.POINTS}))"


def proj_local(spark, sf_dir):
    p = B.points(spark, sf_dir)
    return p.select("id", f.half_up(f.local_x(F.col("lon"), 30.0, 59.5), 3).alias("local_x"), f.half_up(f.local_y(F.col("lat"), 59.5), 3).alias("local_y"))


def proj_roundtrip(spark, sf_dir):
    p = B.points(spark, sf_dir)
    x, y = f.local_x(F.col("lon"), 30.0, 59.5), f.local_y(F.col("lat"), 59.5)
    return p.select("id", r6(f.local_lon(x, 30.0, 59.5)).alias("lon"), r6(f.local_lat(y, 59.5)).alias("lat"))


def mercator_xy(spark, sf_dir):
    p = B.points(spark, sf_dir)
    return p.select("id", r6(f.mercator_x(F.col("lon"))).alias("mx"), r6(f.mercator_y(F.col("lat"))).alias("my"), r6(f.mercator_lat(f.mercator_y(F.col("lat")))).alias("lat"))


def tile_of_point(spark, sf_dir):
    p = B.points(spark, sf_dir)
    return p.select("id", F.floor(f.tile_x(F.col("lon"))).alias("tx"), F.floor(f.tile_y(F.col("lat"))).alias("ty"))


def unwrap(spark, sf_dir):
    p = B.points(spark, sf_dir)
    return p.select("id", r6(f.unwrap_longitude(F.col("lon"), 170.0)).alias("near170"), r6(f.longitude_around(F.col("lon"), 170.0)).alias("around170"))


def world_row_geometry(spark, sf_dir):
    rows = spark.range(-LIMIT, LIMIT).withColumnRenamed("id", "row")
    return rows.select("row", f.row_columns(F.col("row")).alias("columns"), r6(F.col("row") * STEP).alias("south"), r6(f.row_basis(F.col("row"))).alias("basis"))


WORLD_ROWS = f"""WITH r AS (SELECT unnest(range({-LIMIT}, {LIMIT})) AS row), c AS (SELECT row, {COLUMNS} AS columns FROM r)
SELECT row, columns, {s6(f'row * {STEP!r}')} AS south, {s6(f'sign((row * {STEP!r} + (row + 1) * {STEP!r}) / 2) * acos(columns * 3000.0 / {CIRC}) / {D!r}')} AS basis FROM c"""


def world_cell_of_point(spark, sf_dir):
    return grids.world_cell_of(B.points(spark, sf_dir).select("id", "lon", "lat")).select("id", "row", "col")


SNAP = "CASE WHEN abs(({0}) - floor(({0}) + 0.5)) < 1e-10 THEN floor(({0}) + 0.5) ELSE ({0}) END"
WORLD_CELL = f"""WITH p AS (SELECT id, lon, CAST(floor({SNAP.format(f'lat / {STEP!r}')}) AS BIGINT) AS raw FROM {PT}), q AS (SELECT id, lon, CASE WHEN raw BETWEEN {-LIMIT} AND {LIMIT - 1} THEN raw END AS row FROM p),
     c AS (SELECT *, {COLUMNS} AS n FROM q)
SELECT id, row, CASE WHEN row IS NOT NULL THEN CAST(least(greatest(floor({SNAP.format(f'({WRAP.format("lon")} + 180.0) / 360.0 * n')}), 0), n - 1) AS BIGINT) END AS col FROM c"""


def nearest_cell(spark, sf_dir):
    return grids.nearest_cell(B.points(spark, sf_dir), "id")


NEAREST_CELL = f"""
WITH p AS (SELECT id, lon, lat, least(greatest(CAST(floor({SNAP.format(f'lat / {STEP!r}')}) AS BIGINT), {-LIMIT}), {LIMIT - 1}) AS base FROM {PT}),
     r AS (SELECT *, unnest(generate_series(greatest(base - 1, {-LIMIT}), least(base + 1, {LIMIT - 1}))) AS row FROM p), n AS (SELECT *, {COLUMNS} AS n FROM r),
     c AS (SELECT *, (CAST(floor(({WRAP.format('lon')} + 180.0) / 360.0 * n) AS BIGINT) + d + n) % n AS col FROM (SELECT *, unnest([-1, 0, 1]) AS d FROM n)),
     m AS (SELECT *, (col * 360.0 / n - 180.0 + ((col + 1) * 360.0 / n - 180.0)) / 2 AS clon, (row * {STEP!r} + (row + 1) * {STEP!r}) / 2 AS clat, 'map-3km-v3-r' || row || '-c' || col || '/s0-0' AS cell FROM c)
SELECT id, arg_min(cell, {{'d': pow(sin((lat - clat) * {D!r} / 2), 2) + cos(lat * {D!r}) * cos(clat * {D!r}) * pow(sin({WRAP.format('lon - clon')} * {D!r} / 2), 2), 'c': cell}}) AS cell_id FROM m GROUP BY id"""


def visible_cells(spark, sf_dir):
    """Cells in views of many sizes, across the date line and up to the polar caps; views with too many cells yield none."""
    k = F.col("id")
    v = B.points(spark, sf_dir).select("id", F.col("lon").alias("west"), F.col("lat").alias("south"), f.wrap_degrees(F.col("lon") + 0.3 + k % 4 * 0.5).alias("east"), (F.col("lat") + 0.1 + k % 3 * 0.1).alias("north"))
    return grids.visible_cells(v, "id").groupBy("id", "total").agg(F.count("row").alias("cells"), F.coalesce(F.sum("row"), F.lit(0)).alias("sum_row"), F.coalesce(F.sum("col"), F.lit(0)).alias("sum_col"))


VISIBLE = f"""WITH v AS (SELECT id, {WRAP.format('lon')} AS w, {WRAP.format('lon')} + 0.3 + id % 4 * 0.5 AS e, lat AS s, lat + 0.1 + id % 3 * 0.1 AS n FROM {PT}),
  r AS (SELECT id, w, e, unnest(generate_series(greatest({-LIMIT}, CAST(floor({SNAP.format(f's / {STEP!r}')}) AS BIGINT)), least({LIMIT - 1}, CAST(ceil({SNAP.format(f'n / {STEP!r}')}) AS BIGINT) - 1))) AS row FROM v),
  c AS (SELECT *, {COLUMNS} AS n FROM r),
  h AS (SELECT id, row, n, unnest(generate_series(CAST(floor({SNAP.format('(w + 180.0) / 360.0 * n')}) AS BIGINT), CAST(ceil({SNAP.format('(e + 180.0) / 360.0 * n')}) AS BIGINT) - 1)) AS c FROM c),
  d AS (SELECT DISTINCT id, row, c % n AS col FROM h), t AS (SELECT id, count(*) AS total, CAST(sum(row) AS BIGINT) AS sum_row, CAST(sum(col) AS BIGINT) AS sum_col FROM d GROUP BY 1)
SELECT id, total, CASE WHEN total <= 400 THEN total ELSE 0 END AS cells, CASE WHEN total <= 400 THEN sum_row ELSE 0 END AS sum_row, CASE WHEN total <= 400 THEN sum_col ELSE 0 END AS sum_col FROM t"""


def campaign_grid(spark, sf_dir):
    """Sectors of areas around points, nearest first."""
    a = B.points(spark, sf_dir).select("id", "lon", "lat", (F.col("lon") - 0.2).alias("west"), (F.col("lat") - 0.1).alias("south"), (F.col("lon") + 0.15).alias("east"), (F.col("lat") + 0.2).alias("north"))
    return grids.campaign_grid(a, "id").select("id", "row", "col", F.col("ordinal").cast("long").alias("ordinal"))


CAMPAIGN = f"""WITH a AS (SELECT id, lon, lat, lon - 0.2 AS west, lat - 0.1 AS south, lon + 0.15 AS east, lat + 0.2 AS north, floor((lat - 0.1 + lat + 0.2) / 2 * 1e7 + 0.5) / 1e7 AS basis FROM {PT}),
  s AS (SELECT *, {10000 / (R * D)!r} AS dlat, 10000.0 / ({R * D!r} * cos(basis * {D!r})) AS dlon FROM a),
  r AS (SELECT *, unnest(range(CAST(ceil((north - south) / dlat - 1e-10) AS BIGINT))) AS row FROM s), c AS (SELECT *, unnest(range(CAST(ceil((east - west) / dlon - 1e-10) AS BIGINT))) AS col FROM r),
  d AS (SELECT id, row, col, {WRAP.format('(' + WRAP.format('west + col * dlon + dlon / 2') + ') - lon')} * cos(basis * {D!r}) AS dx, south + row * dlat + dlat / 2 - lat AS dy FROM c)
SELECT id, row, col, row_number() OVER (PARTITION BY id ORDER BY floor((dx * dx + dy * dy) * 1e9 + 0.5) / 1e9, row, col) - 1 AS ordinal FROM d"""


def tile_plan(spark, sf_dir):
    c = B.points(spark, sf_dir).select("id", "lon", "lat")
    return grids.water_tiles(c).groupBy("id", "tile_count").agg(F.count("tile_x").alias("tiles"))


TY = f"(1 - asinh(tan(({{0}}) * {D!r})) / pi()) / 2 * 16384"
TILE_PLAN = f"""WITH p AS (SELECT id, lon, lat, {R * D!r} * cos(lat * {D!r}) AS s FROM {PT}),
  t AS (SELECT id, CAST((ceil((lon + 2000.0 / s + 180.0) / 360.0 * 16384) - 1 - floor((lon - 2000.0 / s + 180.0) / 360.0 * 16384) + 1) * (ceil({TY.format(f'lat - 2000.0 / {R * D!r}')}) - 1 - floor({TY.format(f'lat + 2000.0 / {R * D!r}')}) + 1) AS BIGINT) AS tile_count FROM p)
SELECT id, tile_count, CASE WHEN tile_count <= 64 THEN tile_count ELSE 0 END AS tiles FROM t"""


def ring_area(spark, sf_dir):
    p = B.polygons(spark, sf_dir)
    return p.select("id", shapes.signed_area(F.col("polygons")[0][0]).alias("outer_area"), shapes.signed_area(F.col("polygons")[0][1]).alias("hole_area"))


def polygon_area_holes(spark, sf_dir):
    return B.polygons(spark, sf_dir).select("id", shapes.multipolygon_area(F.col("polygons")).alias("area"), shapes.vertex_count(F.col("polygons")).cast("long").alias("vertices"))


def bbox(spark, sf_dir):
    return B.polygons(spark, sf_dir).select("id", shapes.bounds(shapes.outer_vertices(F.col("polygons"))).alias("b")).select("id", "b.*")


def point_in_polygon(spark, sf_dir):
    """For each polygon, which of a few points around it lie in it, boundaries solid."""
    p = B.polygons(spark, sf_dir)
    at = F.explode(F.expr("array(struct(-1 as k, cx - w as px, cy as py), struct(0 as k, cx as px, cy as py), struct(1 as k, cx - w / 4 as px, cy - h * 3 / 8 as py), struct(2 as k, cx + w * 3 / 4 as px, cy + h / 2 as py), struct(3 as k, cx - w / 2 as px, cy - h / 2 as py), struct(4 as k, cx - w - 1 as px, cy as py), struct(5 as k, cx + w / 4 as px, cy + h / 2 as py))"))
    rows = p.select("id", "polygons", at.alias("s")).select("id", "polygons", F.col("s.k").alias("k"), F.col("s.px").alias("px"), F.col("s.py").alias("py"))
    return rows.select("id", "k", shapes.in_multipolygon(F.col("px"), F.col("py"), F.col("polygons")).alias("inside"))


PIP = f"""WITH s AS (SELECT id, cx, cy, w, h, unnest([{{'k': -1, 'px': cx - w, 'py': cy}}, {{'k': 0, 'px': cx, 'py': cy}}, {{'k': 1, 'px': cx - w / 4, 'py': cy - h * 3 / 8}}, {{'k': 2, 'px': cx + w * 3 / 4, 'py': cy + h / 2}},
   {{'k': 3, 'px': cx - w / 2, 'py': cy - h / 2}}, {{'k': 4, 'px': cx - w - 1, 'py': cy}}, {{'k': 5, 'px': cx + w / 4, 'py': cy + h / 2}}], recursive := true) FROM ({B.RECTS}))
SELECT id, k, px BETWEEN cx - w AND cx + w AND py BETWEEN cy - h AND cy + h AND NOT (px > cx + w / 2 AND py > cy) AND NOT (px > cx - w / 2 AND px < cx AND py > cy - h / 2 AND py < cy - h / 4) AS inside FROM s"""


def fits_circle(spark, sf_dir):
    p = B.polygons(spark, sf_dir)
    r = F.col("id") % 60 + 5.0
    return p.select("id", shapes.fits_circle(F.col("polygons"), F.col("cx"), F.col("cy"), r).alias("fits"), shapes.fits_circle(F.col("polygons"), F.col("cx"), F.col("cy"), r, 1.0).alias("fits_exactly"))


FITS = f"SELECT id, w * w + h * h <= power((id % 60 + 5) * 1.06 + 1e-8, 2) AS fits, w * w + h * h <= power(id % 60 + 5 + 1e-8, 2) AS fits_exactly FROM ({B.RECTS})"


def canonical_ring(spark, sf_dir):
    """Rings in any order and start become one form: count distinct forms of four variants of each ring."""
    ring = F.slice(F.col("polygons")[0][0], 1, 6)
    turned = F.concat(F.slice(ring, 3, 4), F.slice(ring, 1, 2))
    forms = F.explode(F.array(ring, turned, F.reverse(ring), F.reverse(turned)))
    rows = B.polygons(spark, sf_dir).select("id", "cx", forms.alias("ring"))
    rows = rows.select("id", shapes.canonical_ring(F.col("ring")).alias("c"))
    return rows.groupBy("id").agg(F.count_distinct("c").alias("forms"), F.max(F.size("c")).cast("long").alias("points"), F.min(F.col("c")[0]["x"]).alias("start_x"), F.min(F.col("c")[0]["y"]).alias("start_y"))


def clip_area(spark, sf_dir):
    """Area of each rectangle within its nearest tile of 64 m, by clipping."""
    b = B.boxes(spark, sf_dir).withColumns({"tx": F.floor(F.col("min_x") / 64) * 64.0, "ty": F.floor(F.col("min_y") / 64) * 64.0})
    ring = F.slice(shapes.rectangle_ring(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")), 1, 4)
    b = b.withColumn("ring", ring)
    for axis, edge, above in (("x", "tx", True), ("y", "ty", True), ("x", "tx2", False), ("y", "ty2", False)):
        b = b.withColumn("ring", shapes.clip_half_plane(F.col("ring"), axis, F.col(edge[:2]) + (64.0 if edge.endswith("2") else 0.0), above))
    return b.select("id", F.abs(shapes.signed_area(F.col("ring"))).alias("area"))


CLIP = f"SELECT id, (least(max_x, floor(min_x / 64) * 64 + 64) - min_x) * (least(max_y, floor(min_y / 64) * 64 + 64) - min_y) AS area FROM ({B.BOXES})"


def nearest_boundary(spark, sf_dir):
    """Distance from each rectangle's centre to its boundary."""
    b = B.rects(spark, sf_dir)
    ring = shapes.rectangle_ring(F.col("cx") - F.col("w"), F.col("cy") - F.col("h"), F.col("cx") + F.col("w"), F.col("cy") + F.col("h"))
    return b.select("id", shapes.nearest_boundary(F.col("cx"), F.col("cy"), F.array(ring))["distance"].alias("distance"))


def page_slice(spark, sf_dir):
    p = B.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return p.select("c_nationkey", grids.page_bounds(F.col("n"), F.col("c_nationkey") % 9 - 1).alias("b")).select("c_nationkey", "b.*")


PAGE = """WITH p AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT *, CAST(ceil(n / 9.0) AS BIGINT) AS pages FROM p),
  r AS (SELECT *, greatest(0, least(greatest(pages - 1, 0), c_nationkey % 9 - 1)) AS page FROM q) SELECT c_nationkey, page, pages, page * 9 AS first, least(n, page * 9 + 9) AS last FROM r"""

QUERIES = {
    "proj_local": (proj_local, f"SELECT id, floor({WRAP.format("lon - 30.0")} * {D!r} * {R} * greatest(1e-8, cos(59.5 * {D!r})) * 1e3 + 0.5) / 1e3 AS local_x, floor((lat - 59.5) * {D!r} * {R} * 1e3 + 0.5) / 1e3 AS local_y FROM {PT}"),
    "proj_roundtrip": (proj_roundtrip, f"SELECT id, {s6('lon')} AS lon, {s6('lat')} AS lat FROM {PT}"),
    "mercator_xy": (mercator_xy, f"SELECT id, {s6('(lon + 180.0) / 360.0')} AS mx, {s6(f'(1 - ln(tan(lat * {D!r}) + 1 / cos(lat * {D!r})) / pi()) / 2')} AS my, {s6('lat')} AS lat FROM {PT}"),
    "tile_of_point": (tile_of_point, f"SELECT id, CAST(floor((lon + 180.0) / 360.0 * 16384) AS BIGINT) AS tx, CAST(floor({TY.format('lat')}) AS BIGINT) AS ty FROM {PT}"),
    "unwrap_longitude": (unwrap, f"SELECT id, {s6(f'170.0 + {WRAP.format("lon - 170.0")}')} AS near170, {s6('CASE WHEN lon - 170.0 > 180 THEN lon - 360.0 WHEN lon - 170.0 < -180 THEN lon + 360.0 ELSE lon END')} AS around170 FROM {PT}"),
    "world_row_geometry": (world_row_geometry, WORLD_ROWS),
    "world_cell_of_point": (world_cell_of_point, WORLD_CELL),
    "nearest_cell": (nearest_cell, NEAREST_CELL),
    "visible_cells": (visible_cells, VISIBLE),
    "campaign_grid": (campaign_grid, CAMPAIGN),
    "tile_plan": (tile_plan, TILE_PLAN),
    "ring_area": (ring_area, f"SELECT id, 4 * w * h - w * h / 2 AS outer_area, -w * h / 8 AS hole_area FROM ({B.RECTS})"),
    "polygon_area_holes": (polygon_area_holes, f"SELECT id, 4 * w * h - w * h / 2 - w * h / 8 AS area, CAST(12 AS BIGINT) AS vertices FROM ({B.RECTS})"),
    "bbox": (bbox, f"SELECT id, cx - w AS min_x, cy - h AS min_y, cx + w AS max_x, cy + h AS max_y FROM ({B.RECTS})"),
    "point_in_polygon": (point_in_polygon, PIP),
    "fits_circle": (fits_circle, FITS),
    "canonical_ring": (canonical_ring, f"SELECT id, CAST(1 AS BIGINT) AS forms, CAST(7 AS BIGINT) AS points, cx - w AS start_x, cy - h AS start_y FROM ({B.RECTS})"),
    "clip_area": (clip_area, CLIP),
    "nearest_boundary": (nearest_boundary, f"SELECT id, least(w, h) AS distance FROM ({B.RECTS})"),
    "page_slice": (page_slice, PAGE),
}
