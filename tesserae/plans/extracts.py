"""Queries over requests and descriptions of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import frames as f
from tesserae.sources import extracts

from . import bridge as B
from .grids import PT

HOST = "tiles.example.org"


def sector_queries(spark, sf_dir):
    """The request for the sector around every point, some of them across the date line."""
    p = B.points(spark, sf_dir)
    return p.select("id", extracts.sector_query(F.col("lon"), F.col("lat") * 0.9, F.col("lat") * 0.9).alias("query"))


def _lines(box):
    number = lambda c: f"printf('%.7f', {c})"
    at = " || ',' || ".join(map(number, box))
    return " || chr(10) || ".join(f"'{w}(' || {at} || ');'" for w in (extracts.BUILDINGS, *extracts.BACKGROUND))


D, K = repr(f.DEGREE), f"(6378137.0 * {f.DEGREE!r})"
QUERY = f"""WITH p AS (SELECT id, lon, lat * 0.9 AS lat, 5100.0 / ({K} * cos(lat * 0.9 * {D})) AS dx, 5100.0 / {K} AS dy FROM {PT}), b AS (SELECT *, lat - dy AS s, lat + dy AS n, lon - dx + 180.0 - 360.0 * floor((lon - dx + 180.0) / 360.0) - 180.0 AS w, lon + dx + 180.0 - 360.0 * floor((lon + dx + 180.0) / 360.0) - 180.0 AS e FROM p)
SELECT id, replace('{extracts.HEAD}', chr(13), '') || CASE WHEN w <= e THEN {_lines(('s', 'w', 'n', 'e'))} ELSE {_lines(('s', 'w', 'n', '180.0'))} || chr(10) || {_lines(('s', '-180.0', 'n', 'e'))} END || '{extracts.TAIL}' AS query FROM b"""


def tile_metadata(spark, sf_dir):
    """Descriptions of tile sources, one for each page, most of them with something wrong."""
    k = F.col("page_id") % 8
    tile = F.concat(F.when(k == 3, F.lit("http://")).otherwise(F.lit("https://")), F.when(k == 4, F.lit("elsewhere.org")).otherwise(F.lit(HOST)), F.lit("/planet/"), F.col("page_id").cast("string"), F.when(k == 5, F.lit("/{z}/{x}.pbf")).otherwise(F.lit("/{z}/{x}/{y}.pbf")))
    layers = F.when(k == 6, F.array(F.struct(F.lit("water").alias("id")))).when(k != 7, F.array(F.struct(F.lit("water").alias("id")), F.struct(F.lit("building").alias("id"))))
    told = F.to_json(F.struct(F.array(tile).alias("tiles"), F.when(k == 1, 15).otherwise(14).alias("maxzoom"), layers.alias("vector_layers")))
    text = F.when(k == 2, F.substring(told, 1, 20)).otherwise(told)
    return B.table(spark, sf_dir, "pages").select("page_id", F.coalesce(extracts.metadata_problem(text, HOST), F.lit("")).alias("problem"))


METADATA = "SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'zoom' WHEN 2 THEN 'no tiles' WHEN 3 THEN 'host' WHEN 4 THEN 'host' WHEN 5 THEN 'template' WHEN 6 THEN 'no buildings' ELSE '' END AS problem FROM pages"

QUERIES = {"sector_queries": (sector_queries, QUERY), "tile_metadata": (tile_metadata, METADATA)}
