"""Map extracts: the text that asks for a sector, what a tile source says of itself, and where a raw extract comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import frames as f
from tesserae.functions.constants import EARTH_RADIUS, NATIVE_ZOOM

# What a sector's query asks for; the first line alone without background.
BUILDINGS = 'wr["building"]["building"!="no"]'
BACKGROUND = (
    'way["highway"]',
    'wr["natural"~"^(water|wood|wetland|scrub|grassland)$"]',
    'wr["landuse"~"^(forest|grass|meadow|recreation_ground|village_green|allotments|orchard|farmland|reservoir|basin)$"]',
    'wr["leisure"~"^(park|garden|golf_course|nature_reserve|recreation_ground)$"]',
    'way["waterway"]',
)
HEAD, TAIL = "[out:json][timeout:60][maxsize:134217728];\n(\n", "\n);\nout body geom;"
SIDE_KM = 10.2


def sector_boxes(lon: Column, lat: Column, basis: Column) -> Column:
    """One or two boxes (south, west, north, east) around a sector's centre; two where it crosses the date line."""
    metres = EARTH_RADIUS * f.DEGREE
    dx, dy = SIDE_KM * 500 / (metres * F.cos(basis * f.DEGREE)), SIDE_KM * 500 / metres
    south, north, west, east = lat - dy, lat + dy, f.wrap_degrees(lon - dx), f.wrap_degrees(lon + dx)
    box = lambda w, e: F.struct(south.alias("south"), w.alias("west"), north.alias("north"), e.alias("east"))
    return F.when(west <= east, F.array(box(west, east))).otherwise(F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east)))


def sector_query(lon: Column, lat: Column, basis: Column, background: bool = True) -> Column:
    """The text that asks a map server for all of a sector, degrees to seven places."""
    text = lambda b: F.format_string("%.7f,%.7f,%.7f,%.7f", b["south"], b["west"], b["north"], b["east"])
    wanted = (BUILDINGS, *(BACKGROUND if background else ()))
    lines = F.transform(sector_boxes(lon, lat, basis), lambda b: F.concat_ws("\n", *(F.concat(F.lit(f"{w}("), text(b), F.lit(");")) for w in wanted)))
    return F.concat(F.lit(HEAD), F.array_join(lines, "\n"), F.lit(TAIL))


METADATA = "tiles array<string>, minzoom double, maxzoom double, vector_layers array<struct<id:string>>"


def metadata_problem(text: Column, host: str, path: str = "/planet/") -> Column:
    """What keeps a tile source's description from being used, null if nothing does: its zooms, its addresses, or the lack of a building layer.

    It has to offer native tiles at their zoom, from one to four addresses with the places of z, x and y, of this host and below this path, over https; layers, where it tells them, have to include buildings.
    """
    m = F.from_json(text, METADATA)
    whole = lambda z: (z == F.floor(z)) & (z >= 0) & (z <= NATIVE_ZOOM)
    template = lambda t: F.coalesce(F.contains(t, F.lit("{z}")) & F.contains(t, F.lit("{x}")) & F.contains(t, F.lit("{y}")), F.lit(False))
    address = lambda t: F.startswith(t, F.lit(f"https://{host}{path}")) & ~F.contains(t, F.lit("#"))
    told = F.when(m.isNull() | m["tiles"].isNull() | ~F.size(m["tiles"]).between(1, 4), "no tiles")
    told = told.when(~F.coalesce(m["maxzoom"] == NATIVE_ZOOM, F.lit(False)) | ~F.coalesce(whole(m["minzoom"]), F.lit(True)), "zoom")
    told = told.when(~F.forall(m["tiles"], template), "template").when(~F.forall(m["tiles"], address), "host")
    return told.when(m["vector_layers"].isNotNull() & ~F.exists(m["vector_layers"], lambda x: x["id"].eqNullSafe(F.lit("building"))), "no buildings")


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, raw_sha256, osm_timestamp, generator, elements) of raw extracts in JSON, for provenance; one with a remark or without elements fails the job, as it isn't whole."""
    files = spark.read.format("binaryFile").load(path)
    source = F.from_json(F.decode("content", "UTF-8"), "generator string, remark string, osm3s struct<timestamp_osm_base:string>, elements array<struct<type:string,id:bigint>>")
    rows = files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("raw_sha256"), source.alias("s"))
    whole = F.when(F.trim(F.coalesce("s.remark", F.lit(""))) != "", F.raise_error(F.concat(F.lit("incomplete extract: "), F.col("s.remark")))).when(
        F.coalesce(F.size("s.elements"), F.lit(0)) <= 0, F.raise_error(F.concat(F.lit("empty extract: "), F.col("path")))
    )
    return rows.select("path", "bytes", "raw_sha256", F.col("s.osm3s.timestamp_osm_base").alias("osm_timestamp"), F.col("s.generator").alias("generator"), F.coalesce(whole.cast("int"), F.size("s.elements")).alias("elements"))
