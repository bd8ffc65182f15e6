"""What a view of a hole shows: zoom, metres per pixel and extents, as column expressions.

The world is 512 pixels wide at zoom 0. The hole takes a fixed share of the view's shorter side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS
from .frames import DEGREE, mercator_lat, mercator_y

# The hole's share of the shorter side, the greatest zoom, the least half extent and the margin of streaming in metres.
HOLE_SHARE, MAX_ZOOM, LEAST_EXTENT, STREAM_MARGIN = 0.21, 19.0, 700.0, 250.0
WORLD_PIXELS = 512
EQUATOR_METRES = 2 * math.pi * EARTH_RADIUS


def world_radius(radius: Column, lat: Column, basis: Column) -> Column:
    """A hole's radius as a share of the world's width, the longest of its directions where the frame's basis isn't its own latitude."""
    across = radius / (EQUATOR_METRES * F.cos(basis * DEGREE))
    step = radius / (EARTH_RADIUS * DEGREE)
    north, south = mercator_y(lat) - mercator_y(lat + step), mercator_y(lat - step) - mercator_y(lat)
    return F.when(lat == basis, across).otherwise(F.greatest(across, north, south))


def camera(radius: Column, width: Column, height: Column, lat: Column, basis: Column) -> Column:
    """Zoom, metres per pixel along both axes, the hole's radius in pixels, and the view's half extents in metres."""
    pixels = F.greatest(F.lit(1), F.least(width, height)) * HOLE_SHARE / 2
    zoom = F.least(F.lit(MAX_ZOOM), F.greatest(F.lit(0.0), F.log2(pixels / (WORLD_PIXELS * world_radius(F.greatest(radius, F.lit(0.01)), lat, basis)))))
    size = WORLD_PIXELS * F.pow(F.lit(2.0), zoom)
    per_x, per_y = (EQUATOR_METRES * F.cos(at * DEGREE) / size for at in (basis, lat))
    half, y = height / (2 * size), mercator_y(lat)
    north, south = (mercator_lat(y - half) - lat) * EARTH_RADIUS * DEGREE, (lat - mercator_lat(y + half)) * EARTH_RADIUS * DEGREE
    return F.struct(
        zoom.alias("zoom"), per_x.alias("metres_per_pixel"), per_y.alias("metres_per_pixel_y"), (radius / per_x).alias("radius_pixels"),
        (width * per_x / 2).alias("half_width"), F.greatest(north, south).alias("half_height"),
    )


def streaming_extent(radius: Column, width: Column, height: Column, lat: Column, basis: Column) -> Column:
    """Half extents of the map to stream around a hole."""
    view = camera(radius, width, height, lat, basis)
    return F.struct(*(F.greatest(F.lit(LEAST_EXTENT), view[c] + STREAM_MARGIN).alias(n) for n, c in (("x", "half_width"), ("y", "half_height"))))
