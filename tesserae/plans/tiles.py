"""Queries over vector tiles: coverage from sets of tiles, certified whole buildings. Tiles are encoded from parts, a mapping of our own for tests only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import frames as f
from tesserae.operators import coverage, words
from tesserae.operators.grids import METRES_PER_DEGREE
from tesserae.operators.overlay import per_group
from tesserae.sources.staging import stage, stage_result
from tesserae.sources.tiles import building_fragments, encode_tile, whole_buildings

from . import bridge as B
from .raster import CX, CY

N = 16384
D, K = repr(f.DEGREE), repr(METRES_PER_DEGREE)
TILE_X, TILE_Y = f"(({{0}}) + 180.0) / 360.0 * {N}", f"(1 - asinh(tan(({{0}}) * {D})) / pi()) / 2 * {N}"
SECTORS = f"""SELECT *, CAST(floor({TILE_X.format('lon')}) AS BIGINT) AS tx, CAST(floor({TILE_Y.format('lat')}) AS BIGINT) AS ty
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS sector, CAST(n_nationkey * 14.4 - 179.995 AS DOUBLE) AS lon, CAST(n_nationkey * 4.7 - 56.4 AS DOUBLE) AS lat, CAST(n_nationkey * 4.7 - 56.4 AS DOUBLE) AS basis FROM nation) s"""
# a box, less a second one: nothing, a hole, a corner, or a bay
OUTLINES = """SELECT *, CASE kind WHEN 1 THEN x0 + FLOOR(w / 4.0) WHEN 2 THEN x0 + FLOOR(w / 2.0) WHEN 3 THEN x0 + FLOOR(w / 3.0) ELSE x0 END AS ax, CASE kind WHEN 1 THEN x0 + FLOOR(w / 2.0) WHEN 2 THEN x0 + w WHEN 3 THEN x0 + 2 * FLOOR(w / 3.0) ELSE x0 END AS bx,
  CASE kind WHEN 1 THEN y0 + FLOOR(h / 4.0) WHEN 2 THEN y0 + FLOOR(h / 2.0) WHEN 3 THEN y0 + FLOOR(h / 3.0) ELSE y0 END AS ay, CASE kind WHEN 1 THEN y0 + FLOOR(h / 2.0) WHEN 2 THEN y0 + h WHEN 3 THEN y0 + h ELSE y0 END AS "by" FROM ({0}) p"""
PARTS = """SELECT p_partkey AS fid, CAST(p_partkey % 25 AS BIGINT) AS sector, FLOOR(p_partkey / 25.0) % 3 - 1 AS dx, FLOOR(p_partkey / 75.0) % 3 - 1 AS dy, p_partkey % 4 AS kind, p_partkey * 7919 % 4300 - 150 AS x0,
  p_partkey * 104729 % 4300 - 150 AS y0, 60 + p_size * 8 AS w, 50 + p_partkey * 31 % 300 AS h FROM part"""
FEATURES = OUTLINES.format(PARTS)
SECOND = "(dx + dy + sector + 8) % 3 = 0"
LATE = "sector % 5 = 2 AND dx = 0 AND dy = -1"  # a tile that the first revision lacks
MISSING = "sector % 7 = 3 AND dx = 1 AND dy = 1"


def _spark(text: str) -> str:
    """SQL for both engines, in Spark's spelling."""
    return text.replace('"by"', "by").replace("FROM part", "FROM {part}").replace("FROM nation", "FROM {nation}")


def sectors(spark, sf_dir):
    return spark.sql(_spark(SECTORS), nation=B.table(spark, sf_dir, "nation"))


def _rings(r: dict) -> list[list[tuple[int, int]]]:
    x0, y0, x1, y1 = (int(r[c]) for c in ("x0", "y0", "x1", "y1"))
    ax, ay, bx, by = (int(r[c]) for c in ("ax", "ay", "bx", "by"))
    box = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    if r["kind"] == 1:
        return [box, [(ax, ay), (ax, by), (bx, by), (bx, ay)]]
    if r["kind"] == 2:
        return [[(x0, y0), (x1, y0), (x1, ay), (ax, ay), (ax, y1), (x0, y1)]]
    if r["kind"] == 3:
        return [[(x0, y0), (x1, y0), (x1, y1), (bx, y1), (bx, ay), (ax, ay), (ax, y1), (x0, y1)]]
    return [box]


def tiles(spark, sf_dir) -> DataFrame:
    """(x, y, revision, content): five by five tiles around every sector's own, some of them in two revisions, some missing."""
    near = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    every = sectors(spark, sf_dir).withColumn("dx", near).withColumn("dy", near).where(f"NOT ({MISSING})")
    there = every.where(f"NOT ({LATE})").withColumn("revision", F.lit(1)).unionByName(every.where(f"{SECOND} OR {LATE}").withColumn("revision", F.lit(2)))
    features = spark.sql(_spark(FEATURES), part=B.table(spark, sf_dir, "part")).selectExpr("*", "x0 + w AS x1", "y0 + h AS y1").drop("w", "h")
    features = features.withColumns({c: F.col(c).cast("long") for c in ("dx", "dy", "ax", "bx", "ay", "by")})
    # the first revision has every other part
    held = there.join(features, ["sector", "dx", "dy"], "left").withColumn("fid", F.when((F.col("revision") == 2) | (F.col("fid") % 2 == 0), F.col("fid")))

    names = ["x0", "y0", "x1", "y1", "ax", "ay", "bx", "by", "kind"]
    held = held.select("sector", "dx", "dy", "revision", F.pmod(F.col("tx") + F.col("dx"), F.lit(N)).alias("x"), (F.col("ty") + F.col("dy")).alias("y"), "fid", *names)

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        first, told = batch.iloc[0], batch[batch["fid"].notna()].sort_values("fid")
        columns = (told[c].astype("int64").tolist() for c in ("fid", *names))
        own = [({"render_height": float(fid % 20 + 3)}, _rings(dict(zip(names, r, strict=True)))) for fid, *r in zip(*columns, strict=True)]
        return pd.DataFrame([{"x": int(first["x"]), "y": int(first["y"]), "revision": int(first["revision"]), "content": encode_tile("building", own)}])

    key = ["sector", "dx", "dy", "revision"]
    dealt = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    return dealt.groupBy(*key).applyInPandas(build, "x long, y long, revision int, content binary")


def tile_coverage(spark, sf_dir):
    """Coverage of every sector after a second revision of some tiles, from the coverage of the first: each known chunk with its signature, whether it was made anew, and its cells."""

    def build() -> DataFrame:
        own, source = sectors(spark, sf_dir).select("sector", "lon", "lat", "basis"), stage(tiles(spark, sf_dir), "tiles")
        first = tuple(stage(df, "tiles-held") for df in coverage.refresh(own, source.where("revision = 1")))
        held, told = coverage.refresh(own, source, first)
        marks = held.groupBy(*coverage.CHUNK).agg(F.sum(F.bit_count("bits")).cast("long").alias("cells"), F.sum(words.index_sum(1, 1500)).cast("long").alias("mark"))
        return told.join(marks, coverage.CHUNK, "left").fillna(0, ["cells", "mark"]).select(F.col("sector"), "cx", "cy", "signature", "changed", "cells", "mark")

    return stage_result(build, spark, "tile-coverage")


# in metres around the sector: tiles' rows go south
MX = f"(((tx + dx + ({{0}}) / 4096.0) / {N} * 360 - 180) - lon) * {D} * 6378137.0 * cos(basis * {D})"
MY = f"(degrees(atan(sinh(pi() * (1 - 2 * (ty + dy + ({{0}}) / 4096.0) / {N})))) - lat) * {D} * 6378137.0"
CLIP = "least(4096.0, greatest(0.0, {0}))"
TILE_BOXES = f"""SELECT sector, dx, dy, fid, {MX.format(CLIP.format('x0'))} AS min_x, {MX.format(CLIP.format('x0 + w'))} AS max_x, {MY.format(CLIP.format('y0 + h'))} AS min_y, {MY.format(CLIP.format('y0'))} AS max_y,
  {MX.format('ax')} AS cut_x0, {MX.format('bx')} AS cut_x1, {MY.format('"by"')} AS cut_y0, {MY.format('ay')} AS cut_y1, x0 < 4096 AND y0 < 4096 AND x0 + w > 0 AND y0 + h > 0 AS inside FROM ({FEATURES}) JOIN ({SECTORS}) USING (sector)"""
NEWEST = f"SELECT sector, dx, dy, tx + dx AS x, ty + dy AS y, CASE WHEN {SECOND} OR {LATE} THEN 2 ELSE 1 END AS revision FROM ({SECTORS}), (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b WHERE NOT ({MISSING})"
CHUNKS = "SELECT *, cx * 512.0 - 1500 AS min_x, cy * 512.0 - 1500 AS min_y, least(1500.0, cx * 512.0 - 988) AS max_x, least(1500.0, cy * 512.0 - 988) AS max_y FROM (SELECT unnest(range(6)) AS cx) a, (SELECT unnest(range(6)) AS cy) b"
WINDOWS = f"""SELECT sector, cx, cy, floor({TILE_X.format(f'lon + min_x / ({K} * cos(basis * {D}))')}) AS x0, ceil({TILE_X.format(f'lon + max_x / ({K} * cos(basis * {D}))')}) - 1 AS x1,
  floor({TILE_Y.format(f'lat + max_y / {K}')}) AS y0, ceil({TILE_Y.format(f'lat + min_y / {K}')}) - 1 AS y1 FROM ({SECTORS}), ({CHUNKS})"""
TILE_COVERAGE = f"""
WITH n AS ({NEWEST}), w AS ({WINDOWS}),
  m AS (SELECT w.sector, cx, cy, (x1 - x0 + 1) * (y1 - y0 + 1) AS needed, count(*) AS there, bool_or(revision = 2) AS changed, sha256(string_agg(((x % {N} + {N}) % {N}) || '/' || y || '/' || revision, ',' ORDER BY ((x % {N} + {N}) % {N}) || '/' || y || '/' || revision)) AS signature
    FROM w JOIN n ON n.sector = w.sector AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL),
  b AS (SELECT t.* FROM ({TILE_BOXES}) t JOIN n USING (sector, dx, dy) WHERE inside AND (revision = 2 OR fid % 2 = 0)),
  g AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((min_y + 1500) / 2 - 0.5) AS BIGINT)), least(1499, CAST(ceil((max_y + 1500) / 2 - 0.5) AS BIGINT) - 1))) AS gy
    FROM (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((min_x + 1500) / 2 - 0.5) AS BIGINT)), least(1499, CAST(ceil((max_x + 1500) / 2 - 0.5) AS BIGINT) - 1))) AS gx FROM b)),
  c AS (SELECT DISTINCT sector, gx, gy FROM g WHERE NOT ({CX} >= cut_x0 AND {CX} < cut_x1 AND {CY} >= cut_y0 AND {CY} < cut_y1)),
  k AS (SELECT sector, gx // 256 AS cx, gy // 256 AS cy, count(*) AS cells, CAST(sum(gx + 1500 * gy) AS BIGINT) AS mark FROM c GROUP BY ALL)
SELECT m.sector, CAST(m.cx AS INT) AS cx, CAST(m.cy AS INT) AS cy, signature, changed, coalesce(cells, 0) AS cells, coalesce(mark, 0) AS mark FROM m LEFT JOIN k ON k.sector = m.sector AND k.cx = m.cx AND k.cy = m.cy WHERE there = needed"""


def desired_coverage(spark, sf_dir):
    """The chunks that each sector's newest request wants, in the order in which they are filled, and whether all their tiles are there."""
    p = B.discs(spark, sf_dir)
    k = F.col("seq")
    requests = p.select((k * 7 % 25).alias("sector"), "seq", "x", "y", (F.col("radius") * 20).alias("radius"), (k % 5 - 2.0).alias("dx"), (k % 7 - 3.0).alias("dy"))
    near = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    own = sectors(spark, sf_dir)
    there = own.withColumn("dx", near).withColumn("dy", near).where(f"NOT ({MISSING})").selectExpr(f"pmod(tx + dx, {N}) AS x", "ty + dy AS y", "1 AS revision")
    known = coverage.signatures(own.select("sector", "lon", "lat", "basis"), there)
    return coverage.desired_chunks(requests).join(known, coverage.CHUNK, "left").select("sector", "cx", "cy", "ordinal", F.col("signature").isNotNull().alias("known"))


DESIRED = f"""
WITH r AS (SELECT seq * 7 % 25 AS sector, arg_max({{'x': x, 'y': y, 'radius': radius * 20, 'dx': seq % 5 - 2.0, 'dy': seq % 7 - 3.0}}, seq) AS r FROM ({B.DISCS}) GROUP BY 1),
  d AS (SELECT sector, r.x AS x, r.y AS y, r.radius + 150 AS m, CASE WHEN r.dx = 0 AND r.dy = 0 THEN 0 ELSE r.dx / sqrt(r.dx * r.dx + r.dy * r.dy) * 100 END AS lx, CASE WHEN r.dx = 0 AND r.dy = 0 THEN 0 ELSE r.dy / sqrt(r.dx * r.dx + r.dy * r.dy) * 100 END AS ly FROM r),
  e AS (SELECT sector, x, y, greatest(-1500, x - m + least(0, lx)) AS min_x, greatest(-1500, y - m + least(0, ly)) AS min_y, least(1500, x + m + greatest(0, lx)) AS max_x, least(1500, y + m + greatest(0, ly)) AS max_y FROM d),
  c AS (SELECT e.sector, k.cx, k.cy, pow((k.min_x + k.max_x) / 2 - x, 2) + pow((k.min_y + k.max_y) / 2 - y, 2) AS away FROM e JOIN ({CHUNKS}) k ON k.cx BETWEEN least(5, floor((e.min_x + 1500) / 512)) AND least(5, floor((e.max_x + 1500) / 512))
    AND k.cy BETWEEN least(5, floor((e.min_y + 1500) / 512)) AND least(5, floor((e.max_y + 1500) / 512)) WHERE e.max_x >= -1500 AND e.max_y >= -1500 AND e.min_x < 1500 AND e.min_y < 1500),
  n AS ({NEWEST}), w AS ({WINDOWS}), m AS (SELECT w.sector, cx, cy FROM w JOIN n ON n.sector = w.sector AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY w.sector, cx, cy, x0, x1, y0, y1 HAVING count(*) = (x1 - x0 + 1) * (y1 - y0 + 1))
SELECT c.sector, CAST(c.cx AS INT) AS cx, CAST(c.cy AS INT) AS cy, CAST(row_number() OVER (PARTITION BY c.sector ORDER BY away, c.cy, c.cx) - 1 AS INT) AS ordinal, m.sector IS NOT NULL AS known
FROM c LEFT JOIN m ON m.sector = c.sector AND m.cx = c.cx AND m.cy = c.cy"""

# buildings in slots of 700 units, so that only a building's own two boxes overlap; 841 slots to a sector of five by five tiles
SLOTS = f"""SELECT *, CAST(floor({TILE_X.format('lon')}) AS BIGINT) - 2 AS tx, CAST(floor({TILE_Y.format('lat')}) AS BIGINT) - 2 AS ty FROM (SELECT p_partkey AS fid, CAST(FLOOR(p_partkey / 841.0) AS BIGINT) AS sector,
  CAST(FLOOR(p_partkey / 841.0) * 14.4 % 360 - 179.995 AS DOUBLE) AS lon, CAST(FLOOR(p_partkey / 841.0) % 25 * 4.7 - 56.4 AS DOUBLE) AS lat, CAST(p_partkey % 841 % 29 * 700 + p_partkey * 13 % 40 AS BIGINT) AS x0,
  CAST(FLOOR(p_partkey % 841 / 29.0) AS BIGINT) * 700 + p_partkey * 29 % 40 AS y0, CAST(200 + p_size * 7 AS BIGINT) AS w, CAST(150 + p_partkey * 31 % 400 AS BIGINT) AS h FROM part) p"""
BOXES2 = f"""SELECT fid, sector, lon, lat, tx, ty, 0 AS second, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM ({SLOTS}) s UNION ALL
  SELECT fid, sector, lon, lat, tx, ty, 1 AS second, x0 + CAST(FLOOR(w / 2.0) AS BIGINT) AS x0, y0 + CAST(FLOOR(h / 2.0) AS BIGINT) AS y0, x0 + w + 40 AS x1, y0 + h + 40 AS y1 FROM ({SLOTS}) s WHERE fid % 4 = 1"""
CONTRARY, LOST = "fid % 5 = 0", "fid % 7 = 0 AND fid % 4 <> 1"


def seam_tiles(spark, sf_dir) -> DataFrame:
    """(sector, x, y, content, lon, lat, basis): buildings cut to tiles with a buffer of 64 units; some have another height in all tiles but their first, some are missing there."""
    boxes = spark.sql(_spark(BOXES2), part=B.table(spark, sf_dir, "part"))
    index = lambda c: F.floor(F.col(c) / 4096)
    near = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - 64) / 4096), F.floor((F.col(high) + 64) / 4096)))
    cut = boxes.withColumn("i", near("x0", "x1")).withColumn("j", near("y0", "y1")).where("i BETWEEN 0 AND 4 AND j BETWEEN 0 AND 4")
    first = (F.col("i") == index("x0")) & (F.col("j") == index("y0"))
    cut = cut.withColumn("height", F.col("fid") % 20 + 3 + F.col("second") * 0.5 + F.when(F.expr(CONTRARY) & ~first, 1).otherwise(0)).where(first | ~F.expr(LOST))

    def build(own: list[dict]) -> list[dict]:
        features = []
        for r in sorted(own, key=lambda r: (r["fid"], r["second"])):
            xs, ys = ([min(4160, max(-64, r[f"{c}{k}"] - 4096 * r[n])) for k in (0, 1)] for c, n in (("x", "i"), ("y", "j")))
            if xs[0] < xs[1] and ys[0] < ys[1]:
                features.append(({"render_height": float(r["height"]), "fid": str(r["fid"])}, [[(xs[0], ys[0]), (xs[1], ys[0]), (xs[1], ys[1]), (xs[0], ys[1])]]))
        return [{"content": encode_tile("building", features)}]

    grouped = per_group(cut.selectExpr("sector", "CAST(tx + i AS INT) AS x", "CAST(ty + j AS INT) AS y", "lon", "lat", "fid", "second", "x0", "y0", "x1", "y1", "i", "j", "height"), ["sector", "x", "y", "lon", "lat"], "content binary", build)
    return grouped.withColumn("basis", F.col("lat"))


def certified_buildings(spark, sf_dir):
    """Buildings put together from tiles: those of which every cut wall has its counterpart, with their parts, area, height and radius."""

    def build() -> DataFrame:
        source = stage(seam_tiles(spark, sf_dir), "seam-tiles")
        centers = source.select("sector", "lon", "lat", "basis").distinct()
        found = whole_buildings(building_fragments(source, ("sector",)), centers, ("sector",), "fid").where("complete")
        radius = F.when(F.col("label").cast("long") % 4 != 1, f.half_up(F.col("radius"), 3))
        return found.select(F.col("label").cast("long").alias("fid"), "fragments", "height", f.half_up(F.col("area"), 2).alias("area"), radius.alias("radius"))

    return stage_result(build, spark, "certified")


def _metres(x, y):
    lon = f"((tx + ({x}) / 4096.0) / {N} * 360 - 180 - lon)"
    lat = f"(degrees(atan(sinh(pi() * (1 - 2 * (ty + ({y}) / 4096.0) / {N})))) - lat)"
    return f"{lon} * {D} * 6378137.0 * cos(lat * {D})", f"{lat} * {D} * 6378137.0"


def _size(x0, y0, x1, y1):
    (a, b), (c, d) = _metres(x0, y0), _metres(x1, y1)
    return f"(({c}) - ({a})) * (({b}) - ({d}))", f"sqrt(pow(({c}) - ({a}), 2) + pow(({b}) - ({d}), 2)) / 2"


CERTIFIED = f"""
WITH b AS ({BOXES2}), k AS (SELECT *, x1 // 4096 - x0 // 4096 AS across, y1 // 4096 - y0 // 4096 AS down, x0 % 4096 = 0 OR x1 % 4096 = 0 OR y0 % 4096 = 0 OR y1 % 4096 = 0 AS touching FROM b),
  d AS (SELECT fid, bool_and(NOT touching AND (across + down = 0 OR NOT ({CONTRARY}) AND NOT ({LOST}))) AS complete, CAST(sum((across + 1) * (down + 1)) AS BIGINT) AS fragments, count(*) AS boxes FROM k GROUP BY 1),
  s AS (SELECT *, {_size('x0', 'y0', 'x0 + w', 'y0 + h')[0]} AS one, {_size('x0 + w // 2', 'y0 + h // 2', 'x0 + w + 40', 'y0 + h + 40')[0]} AS two, {_size('x0 + w // 2', 'y0 + h // 2', 'x0 + w', 'y0 + h')[0]} AS common, {_size('x0', 'y0', 'x0 + w', 'y0 + h')[1]} AS radius FROM ({SLOTS}))
SELECT fid, fragments, CASE WHEN boxes = 1 THEN CAST(fid % 20 + 3 AS DOUBLE) END AS height, floor(CASE WHEN boxes = 1 THEN one ELSE one + two - common END * 100 + 0.5) / 100 AS area, CASE WHEN boxes = 1 THEN floor(radius * 1000 + 0.5) / 1000 END AS radius
FROM d JOIN s USING (fid) WHERE complete"""

QUERIES = {"certified_buildings": (certified_buildings, CERTIFIED), "tile_coverage": (tile_coverage, TILE_COVERAGE), "desired_coverage": (desired_coverage, DESIRED)}
