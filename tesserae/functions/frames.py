"""Coordinate frames as column expressions: local metres, Mercator, tiles, world rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ARENA_HALF, ARENA_METRES, CELL_METRES, EARTH_RADIUS, GRID_CELLS, LATITUDE_LIMIT, MERCATOR_LIMIT, RADIUS_CAP, TILES_PER_AXIS

DEGREE = math.pi / 180
LATITUDE_STEP = ARENA_METRES / (EARTH_RADIUS * DEGREE)
ROWS_PER_HEMISPHERE = math.floor(LATITUDE_LIMIT / LATITUDE_STEP)
CIRCUMFERENCE = 2 * math.pi * EARTH_RADIUS


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards positive infinity, for negative values too."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) if not digits else F.floor(x * scale + 0.5).cast("double") / scale


def wrap_degrees(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def unwrap_longitude(lon: Column, reference: Column | float) -> Column:
    """The copy of a longitude that is nearest to a reference."""
    reference = lit(reference)
    return reference + wrap_degrees(lon - reference)


def longitude_around(lon: Column, center: Column | float) -> Column:
    """A longitude shifted by one turn at most, towards a centre."""
    center = lit(center)
    return F.when(lon - center > 180, lon - 360.0).when(lon - center < -180, lon + 360.0).otherwise(lon)


def _shrink(basis: Column) -> Column:
    return F.greatest(F.lit(1e-8), F.cos(basis * DEGREE))


def local_x(lon: Column, center_lon, basis) -> Column:
    return wrap_degrees(lon - lit(center_lon)) * DEGREE * EARTH_RADIUS * _shrink(lit(basis))


def local_y(lat: Column, center_lat) -> Column:
    return (lat - lit(center_lat)) * DEGREE * EARTH_RADIUS


def local_lon(x: Column, center_lon, basis) -> Column:
    return wrap_degrees(lit(center_lon) + x / (EARTH_RADIUS * _shrink(lit(basis)) * DEGREE))


def local_lat(y: Column, center_lat) -> Column:
    return lit(center_lat) + y / (EARTH_RADIUS * DEGREE)


def mercator_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column, limit: float = MERCATOR_LIMIT) -> Column:
    phi = F.least(F.greatest(lat, F.lit(-limit)), F.lit(limit)) * DEGREE
    return (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2


def mercator_lon(x: Column) -> Column:
    return x * 360.0 - 180.0


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y))))


def tile_x(lon: Column, tiles: int = TILES_PER_AXIS) -> Column:
    """Fractional tile column; unwrapped longitudes give columns outside the world."""
    return (lon + 180.0) / 360.0 * tiles


def tile_y(lat: Column, tiles: int = TILES_PER_AXIS) -> Column:
    return (1 - F.asinh(F.tan(lat * DEGREE)) / math.pi) / 2 * tiles


def canonical_tile_x(x: Column, tiles: int = TILES_PER_AXIS) -> Column:
    return F.pmod(x, F.lit(tiles).cast("long"))


def haversine_order(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Grows with spherical distance: the haversine of the angle between two points."""
    dlat, dlon = (lat1 - lat2) * DEGREE, wrap_degrees(lon1 - lon2) * DEGREE
    return F.pow(F.sin(dlat / 2), 2) + F.cos(lat1 * DEGREE) * F.cos(lat2 * DEGREE) * F.pow(F.sin(dlon / 2), 2)


def snap(x: Column, eps: float = 1e-10) -> Column:
    """Whole numbers reached but for rounding errors."""
    return F.when(F.abs(x - half_up(x)) < eps, half_up(x).cast("double")).otherwise(x)


def row_columns(row: Column) -> Column:
    """Number of equal columns of a world row."""
    middle = (row * LATITUDE_STEP + (row + 1) * LATITUDE_STEP) / 2
    count = F.greatest(F.lit(1), half_up(CIRCUMFERENCE * F.cos(middle * DEGREE) / ARENA_METRES))
    return F.least(F.lit(math.floor(CIRCUMFERENCE / ARENA_METRES)), count).cast("long")


def row_basis(row: Column) -> Column:
    """Latitude at which the columns of a row are exactly one arena wide."""
    middle = (row * LATITUDE_STEP + (row + 1) * LATITUDE_STEP) / 2
    return F.signum(middle) * F.acos(row_columns(row) * ARENA_METRES / CIRCUMFERENCE) / DEGREE


def world_row(lat: Column) -> Column:
    """Row that contains a latitude; null over the polar caps."""
    row = F.floor(snap(lat / LATITUDE_STEP))
    return F.when(row.between(-ROWS_PER_HEMISPHERE, ROWS_PER_HEMISPHERE - 1), row)


def world_column(lon: Column, row: Column) -> Column:
    columns = row_columns(row)
    return F.least(F.greatest(F.floor(snap((wrap_degrees(lon) + 180.0) / 360.0 * columns)), F.lit(0)), columns - 1)


def world_cell(row: Column, col: Column) -> Column:
    """Identifier, edges, centre and basis of a world cell."""
    columns = row_columns(row)
    west, east = col * 360.0 / columns - 180.0, (col + 1) * 360.0 / columns - 180.0
    south, north = row * LATITUDE_STEP, (row + 1) * LATITUDE_STEP
    name = F.concat(F.lit("map-3km-v3-r"), row.cast("string"), F.lit("-c"), col.cast("string"))
    return F.struct(
        name.alias("campaign_id"), F.concat(name, F.lit("/s0-0")).alias("cell_id"), west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"),
        ((west + east) / 2).alias("lon"), ((south + north) / 2).alias("lat"), row_basis(row).alias("basis"),
    )


def cell_contains(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """West and south edges belong to a cell, east and north ones don't; within rounding errors of an edge."""
    offset = wrap_degrees(lon) - west
    offset = F.when(offset < 0, offset + 360.0).otherwise(offset)
    offset = F.when(snap((360.0 - offset) / (east - west)) == 0, F.lit(0.0)).otherwise(offset)
    x, y = snap(offset / (east - west)), snap((lat - south) / (north - south))
    return (x >= 0) & (x < 1) & (y >= 0) & (y < 1)


def viewport_intervals(west: Column, east: Column) -> Column:
    """One or two longitude intervals of a viewport that may cross the date line."""
    width = F.when(F.abs(east - west) >= 360, F.lit(360.0)).when(east < west, F.pmod(east - west, F.lit(360.0))).otherwise(east - west)
    start = wrap_degrees(west)
    pair = lambda a, b: F.struct(a.alias("west"), b.alias("east"))
    whole = F.array(pair(F.lit(-180.0), F.lit(180.0)))
    split = F.array(pair(start, F.lit(180.0)), pair(F.lit(-180.0), start + width - 360.0))
    return F.when(width == 360, whole).when(start + width <= 180, F.array(pair(start, start + width))).otherwise(split)


def meets_viewport(west: Column, south: Column, east: Column, north: Column, intervals: Column, view_south: Column, view_north: Column) -> Column:
    """Whether a cell's inside meets a viewport, in any of three world copies."""
    copies = F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))
    across = F.exists(intervals, lambda i: F.exists(copies, lambda s: (west + s < i["east"]) & (east + s > i["west"])))
    return (south < view_north) & (north > view_south) & across


def cell_index(value: Column) -> Column:
    """Grid index of a coordinate of the arena; null outside."""
    inside = (value >= -ARENA_HALF) & (value < ARENA_HALF)
    return F.when(inside, F.least(F.lit(GRID_CELLS - 1).cast("long"), F.floor((value + ARENA_HALF) / CELL_METRES)))


def cell_center(index: Column) -> Column:
    return (index + 0.5) * CELL_METRES - ARENA_HALF


def chunk_of(index: Column) -> Column:
    return F.shiftright(index, 8)


def overrun(radius: Column) -> Column:
    """How far beyond the arena a hole of this radius may go."""
    return F.least(F.lit(RADIUS_CAP), F.greatest(F.lit(0.0), radius))


def clamp_position(value: Column, radius: Column) -> Column:
    half = ARENA_HALF + overrun(radius)
    return F.least(F.greatest(value, -half), half)


def within_metres(lon: Column, lat: Column, anchor_lon: Column, anchor_lat: Column, metres: float = 50_000.0) -> Column:
    """Near an anchor by degrees of 111 320 m, longitudes shrunk at the anchor."""
    dx = (F.pmod(lon - anchor_lon + 540.0, F.lit(360.0)) - 180.0) * 111_320.0 * F.cos(anchor_lat * DEGREE)
    dy = (lat - anchor_lat) * 111_320.0
    return F.hypot(dx, dy) < metres


def visual_source_tile(z: Column, x: Column, y: Column, native: int = 14) -> Column:
    """The native tile that a display tile is cut from, and the crop's scale and place in it."""
    depth = F.greatest(z - native, F.lit(0))
    scale = F.expr("1").cast("long") * F.pow(F.lit(2), depth).cast("long")
    return F.struct(
        F.least(z, F.lit(native)).alias("z"), F.floor(x / scale).alias("x"), F.floor(y / scale).alias("y"), scale.alias("scale"),
        F.pmod(x, scale).alias("left"), F.pmod(y, scale).alias("top"),
    )
