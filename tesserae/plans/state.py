"""Queries over views, bounds, saved state, selection and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import camera, checks, runs, shapes, tags
from tesserae.functions import frames as f
from tesserae.operators import containment, features, grids, spatial_join

from . import bridge as B
from .grids import COLUMNS, LIMIT, PT, SNAP, STEP, WRAP, s6

D, R = repr(f.DEGREE), "6378137.0"
MY = f"(0.5 - ln(tan(pi() / 4 + ({{0}}) * {D} / 2)) / (2 * pi()))"
LAT_AT = f"(atan(sinh(pi() * (1 - 2 * ({{0}})))) / {D})"


def r6(c):
    return f.half_up(c, 6)


def views(spark, sf_dir):
    """Camera and streaming extents for holes and screens of many sizes, on and off the basis of their frame."""
    lat = F.col("lat") * 0.8
    basis = F.when(F.col("id") % 2 == 0, lat).otherwise(lat * 0.9)
    radius, width, height = 18.0 + F.col("id") % 480, 300.0 + F.col("id") % 1700, 400.0 + F.col("id") * 7 % 1100
    v = camera.camera(radius, width, height, lat, basis)
    e = camera.streaming_extent(radius, width, height, lat, basis)
    told = {"zoom": v["zoom"], "metres_per_pixel": v["metres_per_pixel"], "radius_pixels": v["radius_pixels"], "half_width": v["half_width"], "half_height": v["half_height"], "extent_x": e["x"], "extent_y": e["y"]}
    return B.points(spark, sf_dir).select("id", *(f.half_up(c, 3).alias(n) for n, c in told.items()))


S3 = "floor(({0}) * 1e3 + 0.5) / 1e3"
VIEWS = f"""WITH p AS (SELECT id, lat * 0.8 AS lat, CASE WHEN id % 2 = 0 THEN lat * 0.8 ELSE lat * 0.8 * 0.9 END AS basis, 18.0 + id % 480 AS radius, 300.0 + id % 1700 AS width, 400.0 + id * 7 % 1100 AS height FROM {PT}),
  m AS (SELECT *, radius / (2 * pi() * {R} * cos(basis * {D})) AS across, radius / ({R} * {D}) AS step FROM p),
  w AS (SELECT *, CASE WHEN lat = basis THEN across ELSE greatest(across, {MY.format('lat')} - {MY.format('lat + step')}, {MY.format('lat - step')} - {MY.format('lat')}) END AS share FROM m),
  z AS (SELECT *, least(19.0, greatest(0.0, log2(least(width, height) * 0.21 / 2 / (512 * share)))) AS zoom FROM w),
  v AS (SELECT *, 2 * pi() * {R} * cos(basis * {D}) / (512 * pow(2, zoom)) AS mpp, {MY.format('lat')} AS y, height / (2 * 512 * pow(2, zoom)) AS half FROM z),
  e AS (SELECT *, width * mpp / 2 AS hw, greatest(({LAT_AT.format('y - half')} - lat) * {R} * {D}, (lat - {LAT_AT.format('y + half')}) * {R} * {D}) AS hh FROM v)
SELECT id, {S3.format('zoom')} AS zoom, {S3.format('mpp')} AS metres_per_pixel, {S3.format('radius / mpp')} AS radius_pixels, {S3.format('hw')} AS half_width, {S3.format('hh')} AS half_height,
  {S3.format('greatest(700.0, hw + 250)')} AS extent_x, {S3.format('greatest(700.0, hh + 250)')} AS extent_y FROM e"""


def bounds_checks(spark, sf_dir):
    """Sector bounds, extents around a centre, stored or default cell bounds and rounded coordinates, across the date line too."""
    lon, lat = F.col("lon"), F.col("lat")
    near = lat * 0.9
    b = checks.sector_bounds(lon, near - 0.1, f.wrap_degrees(lon + 0.4), near + 0.2)
    m = checks.manual_bounds(lon, near, 3.0 + F.col("id") % 40, 2.0 + F.col("id") % 30)
    stored = lambda c: F.when(F.col("id") % 3 == 0, c)
    c = checks.cell_bounds(lon, near, checks.projection_latitude(near), stored(lon - 0.01), stored(near - 0.01), stored(f.wrap_degrees(lon + 0.01)), stored(near + 0.01))
    told = {"east": b["east"], "west_km": m["west"], "east_km": m["east"], "north_km": m["north"], "cell_west": c["west"], "cell_east": c["east"], "cell_north": c["north"], "rounded": checks.coordinate(lon / 3, 540.0)}
    return B.points(spark, sf_dir).select("id", *(r6(x).alias(n) for n, x in told.items()))


LAT_STEP = repr(f.LATITUDE_STEP)
BOUNDS = f"""WITH p AS (SELECT id, lon, lat * 0.9 AS lat, lon + 0.4 - 360.0 * floor((lon + 0.4 + 180.0) / 360.0) AS e, {R} * {D} AS k, cos(lat * 0.9 * {D}) AS c FROM {PT}),
  d AS (SELECT *, 3000.0 / 2 / (k * c) AS dx, lon + 0.01 - 360.0 * floor((lon + 0.01 + 180.0) / 360.0) AS e1 FROM p),
  w AS (SELECT *, CASE WHEN id % 3 = 0 THEN lon - 0.01 ELSE lon - dx END AS w, CASE WHEN id % 3 = 0 THEN e1 ELSE lon + dx END AS ce FROM d),
  x AS (SELECT *, {WRAP.format('w')} AS ws, CASE WHEN ce < w THEN (ce - w) - 360.0 * floor((ce - w) / 360.0) ELSE ce - w END AS width FROM w)
SELECT id, {s6('CASE WHEN e < lon THEN e + 360.0 ELSE e END')} AS east, {s6(WRAP.format('lon - (3.0 + id % 40) * 500.0 / (k * c)'))} AS west_km, {s6(WRAP.format('lon + (3.0 + id % 40) * 500.0 / (k * c)'))} AS east_km,
  {s6('lat + (2.0 + id % 30) * 500.0 / k')} AS north_km, {s6('ws')} AS cell_west, {s6('ws + width')} AS cell_east, {s6(f'CASE WHEN id % 3 = 0 THEN lat + 0.01 ELSE lat + {LAT_STEP} / 2 END')} AS cell_north, {s6('floor(lon / 3 * 1e7 + 0.5) / 1e7')} AS rounded FROM x"""


def cell_outlines(spark, sf_dir):
    """GeoJSON of cells with whole edges; those across the date line come in two."""
    p = B.table(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(c_custkey % 360 - 180 AS DOUBLE) AS west", "CAST(c_custkey % 150 - 80 AS DOUBLE) AS south")
    return p.select("c_custkey", checks.cell_geojson(F.col("west"), F.col("south"), F.col("west") + 5.0, F.col("south") + 3.0).alias("outline"))


def _ring(a, b):
    pair = lambda x, y: f"'[' || {x} || ',' || {y} || ']'"
    return f"'[[' || {pair(a, 's')} || ',' || {pair(b, 's')} || ',' || {pair(b, 'n')} || ',' || {pair(a, 'n')} || ',' || {pair(a, 's')} || ']]'"


OUTLINES = f"""WITH p AS (SELECT c_custkey, CAST(c_custkey % 360 - 180 AS DOUBLE) AS w, CAST(c_custkey % 150 - 80 AS DOUBLE) AS s, w + 5 AS e, s + 3 AS n FROM customer)
SELECT c_custkey, CASE WHEN e <= 180 THEN '{{"type":"Polygon","coordinates":' || {_ring('w', 'e')} || '}}'
  ELSE '{{"type":"MultiPolygon","coordinates":[' || {_ring('w', "'180.0'")} || ',' || {_ring("'-180.0'", '(e - 360)')} || ']}}' END AS outline FROM p"""


def positions(spark, sf_dir):
    """Positions checked and clamped, prefetch boxes, wholesome areas, versions and frames, native and display tiles, and who may use whose cache."""
    p = B.points(spark, sf_dir)
    x, y, radius = F.col("x"), F.col("y"), F.col("id") % 600 - 50.0
    box = runs.prefetch_box(x, y, F.lit(40.0), 60.0, F.col("id") % 7 - 3.0, F.col("id") % 5 - 2.0)
    tile = f.visual_source_tile(F.lit(17), F.col("id") * 37 % 131072, F.col("id") * 91 % 131072)
    told = {
        "at": checks.arena_position(x, y, F.lit(20.0))["x"], "clamped": f.clamp_position(x * 1.5, radius), "overrun": f.overrun(radius), "low": box["min_x"], "high": box["max_y"],
        "sound": runs.sound_area(F.col("id") * 4), "native": checks.native_tile(F.col("id") * 37 - 9000, F.col("id") % 16384)["x"], "tile_x": tile["x"], "left": tile["left"], "scale": tile["scale"],
        "same": runs.same_frame(F.col("lon"), F.col("lat"), F.col("lat"), F.col("lon") + F.col("id") % 3 * 1e-8, F.col("lat"), F.col("lat")) & runs.compatible(F.when(F.col("id") % 2 == 0, F.lit("v1")), F.lit("v1")),
    }
    a = {"id": F.col("id"), "pipeline": F.lit(1), "basis": F.col("lat"), "lon": F.col("lon"), "lat": F.col("lat")}
    told["cache"] = checks.same_cache(a, a | {"lon": F.col("lon") + F.col("id") % 4 * 1e-6})
    return p.select("id", *(c.alias(n) for n, c in told.items()))


POSITIONS = f"""WITH p AS (SELECT *, id % 600 - 50.0 AS r, id % 7 - 3.0 AS dx, id % 5 - 2.0 AS dy, hypot_ AS h FROM (SELECT *, sqrt((id % 7 - 3.0) * (id % 7 - 3.0) + (id % 5 - 2.0) * (id % 5 - 2.0)) AS hypot_ FROM {PT}))
SELECT id, x AS at, CAST(least(greatest(x * 1.5, -1500 - least(500.0, greatest(0.0, r))), 1500 + least(500.0, greatest(0.0, r))) AS DOUBLE) AS clamped, CAST(least(500.0, greatest(0.0, r)) AS DOUBLE) AS overrun,
  greatest(-1500.0, x - 40 - 60 + least(0.0, CASE WHEN h > 0 THEN dx / h * 100 ELSE 0.0 END)) AS low, least(1500.0, y + 40 + 60 + greatest(0.0, CASE WHEN h > 0 THEN dy / h * 100 ELSE 0.0 END)) AS high,
  id * 4 AS sound, ((id * 37 - 9000) % 16384 + 16384) % 16384 AS native, id * 37 % 131072 // 8 AS tile_x, id * 37 % 131072 % 8 AS left, CAST(8 AS BIGINT) AS scale, true AS same, id % 4 = 0 AS cache FROM p"""


def hosts(spark, sf_dir):
    """Addresses of pages after the check of their host."""
    p = B.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://tiles.example.org/"), F.col("page_id").cast("string")).alias("url"))
    return p.select("page_id", checks.allowed_host(F.col("url"), "tiles.example.org", "backup.example.org").alias("url"))


def box_pairs(spark, sf_dir):
    """Circles' boxes and suppliers' tiles: which touch and which overlap; with raised visual boxes."""
    a = B.boxes(spark, sf_dir).select("id", F.struct("min_x", "min_y", "max_x", "max_y").alias("a"), F.floor((F.col("min_x") + 1500) / 100).cast("long").alias("k"))
    b = spark.range(30).select(F.col("id").alias("k"), F.struct(*(F.lit(v).cast("double").alias(n) if v is not None else (F.col("id") * 100.0 - 1500 + w).alias(n) for n, v, w in (("min_x", None, 0), ("min_y", 0, 0), ("max_x", None, 40), ("max_y", 100, 0)))).alias("b"))
    j = a.join(b, "k")
    v = checks.visual_bounds(F.col("a.min_x"), F.col("a.min_y"), F.col("a.max_x"), F.col("a.max_y"), F.col("id") % 30 - 5.0, 0.5)
    return j.select("id", shapes.boxes_touch(F.col("a"), F.col("b")).alias("touch"), shapes.boxes_overlap(F.col("a"), F.col("b")).alias("overlap"), v["max_y"].alias("raised"))


PAIRS = f"""WITH j AS (SELECT *, floor((min_x + 1500) / 100) * 100.0 - 1500 AS bx FROM ({B.BOXES}) WHERE floor((min_x + 1500) / 100) BETWEEN 0 AND 29)
SELECT id, min_x <= bx + 40 AND max_x >= bx AND min_y <= 100 AND max_y >= 0 AS touch, min_x < bx + 40 - 1e-10 AND max_x > bx + 1e-10 AND min_y < 100 - 1e-10 AND max_y > 1e-10 AS overlap, CAST(max_y + greatest(0.0, id % 30 - 5.0) * 0.5 AS DOUBLE) AS raised FROM j"""


def viewports(spark, sf_dir):
    """Cells against viewports: containment with half-open edges, and intersection in three world copies."""
    lon, lat, k = F.col("lon"), F.col("lat"), F.col("id")
    west = f.wrap_degrees(lon + k % 5 - 2.0)
    inside = f.cell_contains(lon, lat, west, lat - 0.5, west + 3.0, lat + k % 3 * 0.5)
    meets = f.meets_viewport(lon, lat, lon + 0.5, lat + 0.5, f.viewport_intervals(west + 0.2, f.wrap_degrees(west + 2.25)), lat - 1.0, lat + 0.25)
    return B.points(spark, sf_dir).select("id", inside.alias("inside"), meets.alias("meets"))


VIEWPORTS = f"""WITH p AS (SELECT id, lon, lat, {WRAP.format('lon + id % 5 - 2.0')} AS w FROM {PT}), o AS (SELECT *, (lon - w) - 360.0 * floor((lon - w) / 360.0) AS off FROM p)
SELECT id, off < 3.0 AND id % 3 > 0 AS inside, list_bool_or([(lon + s < w + 2.25) AND (lon + 0.5 + s > w + 0.2) FOR s IN [-360.0, 0.0, 360.0]]) AS meets FROM o"""


def canonical_shapes(spark, sf_dir):
    """Polygons, lines and clipped areas: canonical outer rings, smaller directions, walls that face south."""
    p = B.polygons(spark, sf_dir)
    poly = F.col("polygons")[0]
    canon = shapes.canonical_polygon(poly)
    line = shapes.canonical_line(F.reverse(poly[0]))
    clipped = shapes.clip_to_box(F.slice(poly[0], 1, F.size(poly[0]) - 1), F.col("cx") - F.col("w") / 4, F.col("cy") - F.col("h"), F.col("cx") + F.col("w"), F.col("cy") - F.col("h") / 2)
    return p.select(
        "id", canon[0][0]["x"].alias("first_x"), canon[0][1]["y"].alias("second_y"), line[0]["x"].alias("line_x"), line[1]["x"].alias("line_next_x"),
        F.abs(shapes.signed_area(clipped)).alias("clipped"), shapes.south_walls(F.col("polygons")).alias("walls"), F.size(shapes.outer_vertices(F.col("polygons"))).alias("outer"),
    )


SHAPES = f"""SELECT id, cx - w AS first_x, cy - h AS second_y, cx - w AS line_x, cx - w AS line_next_x, (w + w / 4) * (h / 2) AS clipped, CAST(1 AS INT) AS walls, CAST(7 AS INT) AS "outer" FROM ({B.RECTS})"""


def green_areas(spark, sf_dir):
    """Park kinds by the batch reading."""
    kinds = ["wood", "heath", "water", "grassland"]
    t = F.map_from_arrays(F.array(F.lit("natural")), F.array(F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 4 + 1).cast("int"))))
    return B.table(spark, sf_dir, "part").select("p_partkey", tags.is_green(t).alias("green"))


def viewport_labels(spark, sf_dir):
    """The ten largest places in a view across the date line."""
    c = B.points(spark, sf_dir).withColumn("population", F.col("id") * 7919 % 1000)
    return grids.top_viewport(c, F.lit(150.0), F.lit(-60.0), F.lit(-140.0), F.lit(60.0), "population").select("id", "population")


LABELS = f"SELECT id, id * 7919 % 1000 AS population FROM {PT} WHERE lat BETWEEN -60 AND 60 AND (lon >= 150 OR lon <= -140) ORDER BY population DESC, id LIMIT 10"


def member_lines(spark, sf_dir):
    """Orders as relations of parts: members with a line of their own, and those that refer to a way, some of them missing."""
    li = B.table(spark, sf_dir, "lineitem")
    line = "array(named_struct('lon', l_linenumber * 1.0D, 'lat', 0.5D))"
    m = li.selectExpr("l_orderkey AS rel", f"named_struct('type', IF(l_linenumber = 5, 'node', 'way'), 'ref', l_partkey, 'role', l_returnflag, 'line', IF(l_linenumber % 2 = 0, {line}, NULL)) AS m", "l_linenumber")
    rel = m.groupBy("rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "m"))), lambda x: x["m"]).alias("members"))
    ways = B.table(spark, sf_dir, "part").where("p_size > 5").selectExpr("p_partkey AS id", "array(named_struct('lon', p_size * 1.0D, 'lat', 0.25D)) AS line")
    return features.attached_members(rel, ways).select("rel", "nth", "ref", F.col("line")[0]["lon"].alias("lon"))


MEMBERS = """SELECT l_orderkey AS rel, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS INT) AS nth, l_partkey AS ref,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS DOUBLE) WHEN l_linenumber <> 5 AND p_size > 5 THEN CAST(p_size AS DOUBLE) END AS lon FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"""


def exclusion_counts(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    return features.exclusions(p, ("small", F.col("p_size") < 5), ("boundary", F.col("p_partkey") % 7 == 0), ("duplicate", F.col("p_brand") == "Brand#11"))


EXCLUSIONS = "SELECT CASE WHEN p_size < 5 THEN 'small' WHEN p_partkey % 7 = 0 THEN 'boundary' WHEN p_brand = 'Brand#11' THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1"


def parts_in_parents(spark, sf_dir):
    """Circles as parts, boxes as parents: which circles' boxes lie within a parent."""
    parents = B.boxes(spark, sf_dir).withColumn("shape", F.struct("min_x", "min_y", "max_x", "max_y"))
    parts = B.discs(spark, sf_dir).selectExpr("seq AS id", "x", "y", "struct(x - radius AS min_x, y - radius AS min_y, x + radius AS max_x, y + radius AS max_y) AS shape")
    inside = lambda a, b: (a["min_x"] >= b["min_x"]) & (a["min_y"] >= b["min_y"]) & (a["max_x"] <= b["max_x"]) & (a["max_y"] <= b["max_y"])
    return features.parts_within(parts, parents, 128.0, inside)


WITHIN = f"SELECT DISTINCT seq AS id FROM ({B.DISCS}) JOIN ({B.BOXES}) ON x - radius >= min_x AND x + radius <= max_x AND y - radius >= min_y AND y + radius <= max_y"


def visible_progress(spark, sf_dir):
    cells = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"))
    saved = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.count("*").alias("consumed_area"), F.sum(F.lit(10).cast("long")).alias("total_area"))
    return features.progress_of(cells, saved, "cell")


PROGRESS = "SELECT c_custkey AS cell, coalesce(n, 0) AS consumed_area, coalesce(CAST(n * 10 AS BIGINT), 100000) AS total_area FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"


def recent_campaigns(spark, sf_dir):
    """The forty campaigns saved last, of lists that aren't too long."""
    o = features.within_limit(B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", 10_000)
    return features.most_recent(o, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


def nearest_cells(spark, sf_dir):
    """For each circle the eight nearest of all points."""
    rows = B.circles(spark, sf_dir).select("cid", "x", "y")
    places = B.points(spark, sf_dir).selectExpr("id", "x AS px", "y AS py")
    return containment.nearest(rows, places, "cid", "id", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")), 8).select("cid", "id", "rank")


NEAREST = f"""SELECT cid, id, CAST(rank AS INT) AS rank FROM (SELECT cid, id, row_number() OVER (PARTITION BY cid ORDER BY (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), id) AS rank
  FROM ({B.CIRCLES}) c, {PT} p) WHERE rank <= 8"""


def spawn_places(spark, sf_dir):
    """For each group of buildings, the first place on the rings around the origin that none of them covers."""
    b = B.boxes(spark, sf_dir).selectExpr("id % 5 AS town", "(min_x + max_x) / 60 - 40 AS min_x", "(min_y + max_y) / 60 - 40 AS min_y", "(min_x + max_x) / 60 + 40 AS max_x", "(min_y + max_y) / 60 + 40 AS max_y")
    return features.free_spawn(b, "town", 9.0, 12).select("town", f.half_up(F.col("x"), 3).alias("x"), f.half_up(F.col("y"), 3).alias("y"))


SPAWN = f"""WITH b AS (SELECT id % 5 AS town, (min_x + max_x) / 60 AS mx, (min_y + max_y) / 60 AS my FROM ({B.BOXES})), r AS (SELECT unnest(range(13)) AS r),
  n AS (SELECT r, unnest(range(greatest(1, r * 8))) AS n FROM r), p AS (SELECT r, n, r * 9.0 * cos(n * 2 * pi() / greatest(1, r * 8)) AS x, r * 9.0 * sin(n * 2 * pi() / greatest(1, r * 8)) AS y FROM n),
  t AS (SELECT DISTINCT town FROM b), free AS (SELECT town, r, n, x, y FROM t, p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.town = t.town AND x BETWEEN mx - 40 AND mx + 40 AND y BETWEEN my - 40 AND my + 40)),
  f AS (SELECT town, arg_min({{'x': x, 'y': y}}, {{'r': r, 'n': n}}) AS p FROM free GROUP BY 1)
SELECT t.town, {S3.format('p.x')} AS x, {S3.format('p.y')} AS y FROM t LEFT JOIN f ON f.town = t.town"""


def stored_totals(spark, sf_dir):
    """Orders' totals as stored against those of their lines, some of them changed or left out."""
    li = B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.max("l_linenumber").cast("long").alias("last"))
    stored = li.where("l_orderkey % 11 <> 0").selectExpr("l_orderkey", "IF(l_orderkey % 5 = 0, lines + 1, lines) AS lines", "IF(l_orderkey % 7 = 0, NULL, last) AS last")
    extra = B.table(spark, sf_dir, "customer").selectExpr("-1 - c_custkey AS l_orderkey", "1L AS lines", "1L AS last")
    return features.validation_report(stored.unionAll(extra), li, "l_orderkey", ["lines", "last"])


STORED = """WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem) SELECT k AS l_orderkey, CASE WHEN k % 11 = 0 THEN 'not stored' WHEN k % 5 = 0 AND k % 7 = 0 THEN 'lines,last' WHEN k % 5 = 0 THEN 'lines' ELSE 'last' END AS problem
FROM l WHERE k % 11 = 0 OR k % 5 = 0 OR k % 7 = 0 UNION ALL SELECT -1 - c_custkey, 'nothing there' FROM customer"""


def geometry_helpers(spark, sf_dir):
    """Swept boxes, grown squares, vertices, shapes in degrees near a reference, seams on a tile edge and Mercator offsets."""
    p = B.polygons(spark, sf_dir)
    cx, cy, w, h, k = (F.col(c) for c in ("cx", "cy", "w", "h", "id"))
    sweep = shapes.swept_box(cx, cy, k % 9 - 4.0, k % 7 - 3.0, F.lit(2.5))
    degrees = shapes.mapped(F.col("polygons"), lambda q: shapes.point(f.unwrap_longitude(f.local_lon(q["x"], 179.99, 10.0), -179.9), f.local_lat(q["y"], 10.0)))
    seams = shapes.seam_intervals(F.col("polygons"), "x", cx - w)
    offsets = shapes.mapped(degrees, lambda q: shapes.point(f.mercator_x(q["x"]) - f.mercator_x(F.lit(-180.01)), f.mercator_y(q["y"]) - f.mercator_y(F.lit(10.0))))
    return p.select(
        "id", sweep["min_x"].alias("low"), sweep["max_y"].alias("high"), shapes.square(w)["max_x"].alias("square"), F.size(shapes.every_vertex(F.col("polygons"))).alias("vertices"), r6(degrees[0][0][0]["x"]).alias("lon"),
        r6(degrees[0][0][0]["y"]).alias("lat"), F.size(seams).alias("seams"), seams[0]["lo"].alias("seam_low"), seams[0]["hi"].alias("seam_high"), f.half_up(offsets[0][0][0]["x"], 9).alias("east"), f.half_up(offsets[0][0][0]["y"], 9).alias("south"),
    )


LON_AT = f"(179.99 + (cx - w) / ({R} * cos(10.0 * {D}) * {D}))"
HELPERS = f"""WITH p AS (SELECT *, {WRAP.format(LON_AT)} AS l, 10.0 + (cy - h) / ({R} * {D}) AS lat FROM ({B.RECTS})), q AS (SELECT *, l - 360.0 * floor((l + 179.9 + 180.0) / 360.0) AS lon FROM p)
SELECT id, least(cx, cx + id % 9 - 4.0) - 2.5 AS low, greatest(cy, cy + id % 7 - 3.0) + 2.5 AS high, 1500 + w AS square, CAST(12 AS INT) AS vertices, {s6('lon')} AS lon, {s6('lat')} AS lat, CAST(1 AS INT) AS seams, cy - h AS seam_low, cy + h AS seam_high,
  floor(((lon + 180.0) / 360.0 - (-180.01 + 180.0) / 360.0) * 1e9 + 0.5) / 1e9 AS east, floor(({MY.format('lat')} - {MY.format('10.0')}) * 1e9 + 0.5) / 1e9 AS south FROM q"""


def chosen_regions(spark, sf_dir):
    """Which building, as a region, each event's point lies in."""
    points = B.discs(spark, sf_dir).select("seq", "x", "y")
    found = spatial_join.region_of(points, B.polygons(spark, sf_dir).select(F.col("id").alias("region"), "polygons"), "seq")
    return found.select("seq", F.coalesce("region", F.lit(-1)).alias("region"))


CHOSEN = f"""WITH m AS (SELECT seq, min(id) AS region FROM ({B.DISCS}) JOIN ({B.RECTS}) ON x BETWEEN cx - w AND cx + w AND y BETWEEN cy - h AND cy + h AND NOT (x > cx + w / 2 AND y > cy) AND NOT (x > cx - w / 2 AND x < cx AND y > cy - h / 2 AND y < cy - h / 4) GROUP BY 1)
SELECT event_id AS seq, coalesce(region, -1) AS region FROM events LEFT JOIN m ON m.seq = event_id"""


def covers(spark, sf_dir):
    """Circles whose box is covered by the chunks that are there."""
    known = spark.range(36).selectExpr("CAST(id DIV 6 AS INT) AS cx", "CAST(id % 6 AS INT) AS cy").where("(cx * 2 + cy) % 5 <> 0")
    return spatial_join.covered_circles(B.circles(spark, sf_dir), known, "cid")


COVERS = f"""WITH k AS (SELECT unnest(range(6)) AS k), n AS (SELECT cid, a.k AS cx, b.k AS cy FROM ({B.CIRCLES}), k a, k b WHERE x + radius >= -1500 AND y + radius >= -1500 AND x - radius < 1500 AND y - radius < 1500
  AND a.k BETWEEN least(5, greatest(0, floor((x - radius + 1500) / 512))) AND least(5, greatest(0, floor((x + radius + 1500) / 512))) AND b.k BETWEEN least(5, greatest(0, floor((y - radius + 1500) / 512))) AND least(5, greatest(0, floor((y + radius + 1500) / 512))))
SELECT s_suppkey AS cid, coalesce(ok, true) AS covers FROM supplier LEFT JOIN (SELECT cid, bool_and((cx * 2 + cy) % 5 <> 0) AS ok FROM n GROUP BY 1) ON cid = s_suppkey"""


def cell_campaigns(spark, sf_dir):
    """The campaign of the world cell of each point; none over the polar caps."""
    p = B.points(spark, sf_dir).withColumn("row", f.world_row(F.col("lat"))).where("row is not null").withColumn("col", f.world_column(F.col("lon"), F.col("row")))
    return grids.single_cell_campaigns(p.select("row", "col").distinct()).select("row", "col", "cell_id", r6(F.col("west")).alias("west"), r6(F.col("north")).alias("north"), r6(F.col("lon")).alias("lon"), "rows", "cols")


CAMPAIGNS = f"""WITH p AS (SELECT {WRAP.format('lon')} AS lon, CAST(floor({SNAP.format(f'lat / {STEP!r}')}) AS BIGINT) AS row FROM {PT}), n AS (SELECT *, {COLUMNS} AS n FROM p WHERE row BETWEEN {-LIMIT} AND {LIMIT - 1}),
  c AS (SELECT DISTINCT row, n, least(greatest(CAST(floor({SNAP.format('(lon + 180.0) / 360.0 * n')}) AS BIGINT), 0), n - 1) AS col FROM n)
SELECT row, col, 'map-3km-v3-r' || row || '-c' || col || '/s0-0' AS cell_id, {s6('col * 360.0 / n - 180.0')} AS west, {s6(f'(row + 1) * {STEP!r}')} AS north, {s6('(col * 360.0 / n - 180.0 + ((col + 1) * 360.0 / n - 180.0)) / 2')} AS lon, CAST(1 AS INT) AS rows, CAST(1 AS INT) AS cols FROM c"""


def display_tiles(spark, sf_dir):
    v = B.points(spark, sf_dir).selectExpr("id", "(lon + 180) / 360 AS mx", "(lat + 90) / 180 AS my", "1 + id % 12 + 0.25D AS zoom", "300.0D + id % 3000 AS width", "200.0D + id % 1700 AS height")
    return grids.visual_tiles(v, "id").groupBy("id", "z").agg(F.count("*").alias("tiles"), F.sum(F.col("x") * (F.col("ordinal") + 1) + F.col("y")).cast("long").alias("mark"))


DISPLAY = f"""WITH v AS (SELECT id, (lon + 180) / 360 AS mx, (lat + 90) / 180 AS my, 1 + id % 12 + 0.25 AS zoom, 300.0 + id % 3000 AS width, 200.0 + id % 1700 AS height FROM {PT}), l AS (SELECT *, unnest(range(CAST(floor(zoom) AS BIGINT) + 1)) AS z FROM v),
  e AS (SELECT *, CAST(pow(2, z) AS BIGINT) AS n, width / (1024 * pow(2.0, zoom)) AS hw, height / (1024 * pow(2.0, zoom)) AS hh FROM l),
  b AS (SELECT *, CAST(floor((mx - hw) * n) AS BIGINT) AS x0, CAST(floor((mx + hw) * n) AS BIGINT) AS x1, greatest(0, CAST(floor((my - hh) * n) AS BIGINT)) AS y0, least(n - 1, CAST(floor((my + hh) * n) AS BIGINT)) AS y1 FROM e),
  m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC) AS k FROM b WHERE (x1 - x0 + 1) * (y1 - y0 + 1) <= 16), c AS (SELECT *, unnest(generate_series(x0, x1)) AS c FROM m WHERE k = 1), t AS (SELECT *, unnest(generate_series(y0, y1)) AS y FROM c),
  o AS (SELECT id, z, (c % n + n) % n AS x, y, row_number() OVER (PARTITION BY id ORDER BY floor((pow((c + 0.5) / n - mx, 2) + pow((y + 0.5) / n - my, 2)) * n * n * 1e9 + 0.5) / 1e9, y, c) AS k FROM t)
SELECT id, CAST(z AS INT) AS z, count(*) AS tiles, CAST(sum(x * k + y) AS BIGINT) AS mark FROM o GROUP BY 1, 2"""


QUERIES = {
    "views": (views, VIEWS),
    "bounds_checks": (bounds_checks, BOUNDS),
    "cell_outlines": (cell_outlines, OUTLINES),
    "positions": (positions, POSITIONS),
    "hosts": (hosts, "SELECT page_id, 'https://tiles.example.org/' || page_id AS url FROM pages"),
    "box_pairs": (box_pairs, PAIRS),
    "viewports": (viewports, VIEWPORTS),
    "canonical_shapes": (canonical_shapes, SHAPES),
    "green_areas": (green_areas, "SELECT p_partkey, p_partkey % 4 IN (0, 3) AS green FROM part"),
    "viewport_labels": (viewport_labels, LABELS),
    "member_lines": (member_lines, MEMBERS),
    "exclusion_counts": (exclusion_counts, EXCLUSIONS),
    "parts_in_parents": (parts_in_parents, WITHIN),
    "visible_progress": (visible_progress, PROGRESS),
    "recent_campaigns": (recent_campaigns, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40"),
    "nearest_cells": (nearest_cells, NEAREST),
    "spawn_places": (spawn_places, SPAWN),
    "stored_totals": (stored_totals, STORED),
    "geometry_helpers": (geometry_helpers, HELPERS),
    "chosen_regions": (chosen_regions, CHOSEN),
    "covers": (covers, COVERS),
    "cell_campaigns": (cell_campaigns, CAMPAIGNS),
    "display_tiles": (display_tiles, DISPLAY),
}
