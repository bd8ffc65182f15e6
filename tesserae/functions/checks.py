"""Validation expressions and small helpers; what fails a check fails the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ARENA_HALF, ARENA_METRES, EARTH_RADIUS, LATITUDE_LIMIT, RADIUS_CAP, TILES_PER_AXIS
from .frames import DEGREE, LATITUDE_STEP, half_up, wrap_degrees


def required(value: Column, ok: Column, message: str) -> Column:
    """``value`` where the condition holds; else, and where it is null, the job fails."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def coordinate(value: Column, limit: float) -> Column:
    """A coordinate rounded to 1e-7 degrees, within the limit."""
    return required(half_up(value, 7), F.abs(value) <= limit, "coordinate out of range").cast("double")


def projection_latitude(value: Column) -> Column:
    return required(value, F.abs(value) <= LATITUDE_LIMIT, "projection latitude out of range").cast("double")


def sector_bounds(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Bounds with the east edge unwrapped to lie east of the west one."""
    unwrapped = F.when(east < west, east + 360.0).otherwise(east)
    ok = (F.abs(west) <= 180) & (F.abs(east) <= 540) & (south < north) & (south >= -LATITUDE_LIMIT) & (north <= LATITUDE_LIMIT) & (unwrapped > west) & (unwrapped - west <= 180)
    return required(F.struct(west.alias("west"), south.alias("south"), unwrapped.alias("east"), north.alias("north")), ok, "bounds out of range")


def manual_bounds(lon: Column, lat: Column, width_km: Column, height_km: Column) -> Column:
    """Bounds of an extent in kilometres around a centre."""
    dy = height_km * 500.0 / (EARTH_RADIUS * DEGREE)
    dx = width_km * 500.0 / (EARTH_RADIUS * DEGREE * F.cos(lat * DEGREE))
    return F.struct(wrap_degrees(lon - dx).alias("west"), (lat - dy).alias("south"), wrap_degrees(lon + dx).alias("east"), (lat + dy).alias("north"))


def extent_km(west: Column, south: Column, east: Column, north: Column, basis: Column) -> Column:
    """Width and height of bounds in the metric basis of a latitude."""
    width = F.when(east < west, east + 360.0).otherwise(east) - west
    return F.struct((width * DEGREE * EARTH_RADIUS * F.cos(basis * DEGREE) / 1000).alias("width_km"), ((north - south) * DEGREE * EARTH_RADIUS / 1000).alias("height_km"))


def cell_bounds(lon: Column, lat: Column, basis: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Stored bounds, else those of one arena around the centre; the east edge is unwrapped."""
    dx = ARENA_METRES / 2 / (EARTH_RADIUS * DEGREE * F.cos(F.coalesce(basis, lat) * DEGREE))
    dy = LATITUDE_STEP / 2
    w, e = F.coalesce(west, lon - dx), F.coalesce(east, lon + dx)
    width = F.when(e < w, F.pmod(e - w, F.lit(360.0))).otherwise(e - w)
    start = wrap_degrees(w)
    return F.struct(start.alias("west"), F.coalesce(south, lat - dy).alias("south"), (start + width).alias("east"), F.coalesce(north, lat + dy).alias("north"))


def cell_geojson(west: Column, south: Column, east: Column, north: Column) -> Column:
    """GeoJSON geometry of a cell, cut in two at the date line."""
    pair = lambda x, y: F.array(x, y)
    ring = lambda a, b: F.array(F.array(pair(a, south), pair(b, south), pair(b, north), pair(a, north), pair(a, south)))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), ring(west, east).alias("coordinates")))
    two = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(ring(west, F.lit(180.0)), ring(F.lit(-180.0), east - 360.0)).alias("coordinates")))
    return F.when(east <= 180, one).otherwise(two)


def canonical_tile(z: Column, x: Column, y: Column) -> Column:
    """Tile with its column wrapped around the world and its row within it."""
    n = F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2), z).cast("long")
    return required(F.struct(z.alias("z"), F.pmod(x.cast("long"), n).alias("x"), y.cast("long").alias("y")), (z >= 0) & (y >= 0) & (y < n), "tile out of range")


def native_tile(x: Column, y: Column) -> Column:
    return required(F.struct(F.pmod(x.cast("long"), F.lit(TILES_PER_AXIS).cast("long")).alias("x"), y.cast("long").alias("y")), (y >= 0) & (y < TILES_PER_AXIS), "tile out of range")


def allowed_host(url: Column, *hosts: str) -> Column:
    """A secure address at one of the hosts."""
    return required(url, (F.parse_url(url, F.lit("PROTOCOL")) == "https") & F.parse_url(url, F.lit("HOST")).isin(*hosts), "address isn't allowed").cast("string")


def arena_position(x: Column, y: Column, radius: Column) -> Column:
    half = ARENA_HALF + radius
    return required(F.struct(x.alias("x"), y.alias("y")), (radius >= 0) & (radius <= RADIUS_CAP) & (F.abs(x) <= half) & (F.abs(y) <= half), "position out of range")


def same_cache(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Cached sectors that may be used for one another: ids and pipeline equal, bases within 1e-9 and centres within 1e-7 degrees."""
    return (a["id"] == b["id"]) & (a["pipeline"] == b["pipeline"]) & (F.abs(a["basis"] - b["basis"]) <= 1e-9) & (F.abs(a["lon"] - b["lon"]) <= 1e-7) & (F.abs(a["lat"] - b["lat"]) <= 1e-7)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over characters of the basic plane, as a number; lower(conv(…, 10, 36)) gives the short id."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619) % 4294967296)


def visual_bounds(min_x: Column, min_y: Column, max_x: Column, max_y: Column, height: Column, lift: float = 1.0) -> Column:
    """A footprint's box, higher by what the building's height takes up on the map."""
    raised = F.greatest(F.lit(0.0), F.coalesce(height, F.lit(0.0))) * lift
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), (max_y + raised).alias("max_y"))


# First value and factor of each lane of the content fingerprint.
LANES = ((0x811C9DC5, 0x01000193), (0x9E3779B9, 0x85EBCA6B), (0x85EBCA6B, 0xC2B2AE35), (0xC2B2AE35, 0x27D4EB2F))


def _units(text: Column) -> Column:
    """The UTF-16 units of a text, and a zero at its end."""
    groups = F.split(F.hex(F.encode(text, "UTF-16BE")), r"(?<=\G.{4})(?=.)")
    return F.concat(F.when(F.length(text) > 0, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long"))).otherwise(F.array().cast("array<long>")), F.array(F.lit(0).cast("long")))


def _times(x: Column, factor: int) -> Column:
    """A product modulo 2**32, by halves, as the whole one would not fit a long."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (low * F.lit(factor) + F.shiftleft(high * F.lit(factor & 0xFFFF), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def fingerprint(values: Column) -> Column:
    """A digest of 32 hexadecimal digits over an array of texts in their order: four lanes of 32 bits, multiplied unit by unit. Tells contents apart; no security."""
    start = F.struct(*(F.lit(first).cast("long").alias(f"l{k}") for k, (first, _) in enumerate(LANES)))
    step = lambda s, unit: F.struct(*(_times(s[f"l{k}"].bitwiseXOR(unit), factor).alias(f"l{k}") for k, (_, factor) in enumerate(LANES)))
    done = lambda s: F.concat(*(F.lpad(F.lower(F.hex(s[f"l{k}"])), 8, "0") for k in range(len(LANES))))
    return F.aggregate(F.flatten(F.transform(values, _units)), start, step, done)
