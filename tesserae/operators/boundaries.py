"""Stored boundaries of land and water: what their shapes must be like, and whether they are what their water makes them.

Structure is checked by expressions, so rows with a fault never reach a kernel; what is sound is derived anew, envelope by envelope, and compared to the digit.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import shapes
from tesserae.functions.constants import ARENA_HALF, RADIUS_CAP, WATER_HALO

from .overlay import INTERSECTION, POLYGONS, UNION, from_rows, land_regions, overlay, per_group, per_row, square, to_rows

DOMAIN_HALF = ARENA_HALF + WATER_HALO
MAX_VERTICES, MAX_POLYGONS, MAX_REGIONS = 300_000, 2048, 2048
REGIONS = f"array<struct<region_id:string,polygons:{POLYGONS},area:double,min_x:double,min_y:double,max_x:double,max_y:double,point_x:double,point_y:double>>"


def box_of(half: float) -> Column:
    return F.struct(*(F.lit(v).alias(n) for n, v in (("min_x", -half), ("min_y", -half), ("max_x", half), ("max_y", half))))


def shape_fault(polygons: Column, box: Column | None = None, closed: bool = True, eps: float = 1e-6) -> Column:
    """The first fault of a multipolygon, null for a sound one: missing, too many polygons, an empty polygon, a short ring, too many vertices, not finite, beyond the box, open."""
    rings = F.flatten(polygons)
    points = F.flatten(rings)
    finite = lambda p: F.coalesce((F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False))
    fault = F.when(polygons.isNull(), "missing").when(F.size(polygons) > MAX_POLYGONS, "too many polygons").when(F.exists(polygons, lambda p: p.isNull() | (F.size(p) == 0)), "empty polygon")
    fault = fault.when(F.exists(rings, lambda r: F.coalesce(F.size(r), F.lit(0)) < (4 if closed else 3)), "short ring").when(F.size(points) > MAX_VERTICES, "too many vertices").when(~F.forall(points, finite), "not finite")
    if box is not None:
        within = lambda p: (p["x"] >= box["min_x"] - eps) & (p["y"] >= box["min_y"] - eps) & (p["x"] <= box["max_x"] + eps) & (p["y"] <= box["max_y"] + eps)
        fault = fault.when(~F.forall(points, within), "out of bounds")
    return fault.when(F.exists(rings, lambda r: r[0] != F.element_at(r, -1)), "open ring") if closed else fault


def known_domain(box: Column) -> Column:
    """A domain cut to the widest that a hole can reach; null if it doesn't cover the arena."""
    most = ARENA_HALF + RADIUS_CAP
    cut = F.struct(
        F.greatest(box["min_x"], F.lit(-most)).alias("min_x"), F.greatest(box["min_y"], F.lit(-most)).alias("min_y"), F.least(box["max_x"], F.lit(most)).alias("max_x"), F.least(box["max_y"], F.lit(most)).alias("max_y")
    )
    return F.when((box["min_x"] <= -ARENA_HALF) & (box["min_y"] <= -ARENA_HALF) & (box["max_x"] >= ARENA_HALF) & (box["max_y"] >= ARENA_HALF), cut)


def prepared_fault(active: Column, allowed: Column, domain: Column) -> Column:
    """The first fault of prepared land: of its shapes, or not exactly one component with an area, or allowed land without one."""
    known, square_box = known_domain(domain), box_of(ARENA_HALF)
    area = lambda p: shapes.polygon_area(p) > 0
    return (
        F.when(known.isNull(), "domain").when(shape_fault(active, square_box, eps=1e-9).isNotNull(), F.concat(F.lit("active: "), shape_fault(active, square_box, eps=1e-9)))
        .when(shape_fault(allowed, known, eps=1e-9).isNotNull(), F.concat(F.lit("allowed: "), shape_fault(allowed, known, eps=1e-9)))
        .when((F.size(active) != 1) | ~F.exists(active, area), "not one component").when((F.size(allowed) == 0) | ~F.forall(allowed, area), "no domain")
    )


def _rounded(shape: list) -> list:
    return [[[(round(x * 1e6) / 1e6, round(y * 1e6) / 1e6) for x, y in ring] for ring in polygon] for polygon in shape]


def _derived(envelope: object, water: list) -> dict:
    """Regions and digest of water that is canonical already."""
    told = json.dumps([str(envelope), water], separators=(",", ":"))
    return {"water": to_rows(water), "digest": hashlib.sha256(told.encode()).hexdigest(), "regions": land_regions(water, ARENA_HALF)}


def _canonical(water: list) -> list:
    return _rounded(overlay(overlay(water, [], UNION), square(-DOMAIN_HALF, DOMAIN_HALF), INTERSECTION)) if water else []


def derived_boundaries(water: DataFrame, envelope: str, polygons: str = "polygons") -> DataFrame:
    """(envelope, water, digest, regions) from all water polygons of each envelope, one map extract bounded by its limits."""

    def build(own: list[dict]) -> list[dict]:
        shape = _canonical(_canonical([p for r in own for p in from_rows(r[polygons])]))
        return [_derived(own[0][envelope], shape)]

    return per_group(water.select(envelope, polygons), [envelope], f"water {POLYGONS}, digest string, regions {REGIONS}", build)


def check_boundaries(saved: DataFrame, envelope: str) -> DataFrame:
    """(envelope, problem) of stored boundaries (envelope, water, digest, regions): a fault of a shape, or what of water, digest and regions isn't what the water gives; empty if all is well."""
    fault = F.coalesce(
        F.concat(F.lit("water: "), shape_fault(F.col("water"), box_of(DOMAIN_HALF))), F.when(F.col("regions").isNull() | (F.size("regions") > MAX_REGIONS), F.lit("regions")),
        F.when(F.exists("regions", lambda r: shape_fault(r["polygons"], box_of(ARENA_HALF)).isNotNull()), F.lit("regions: fault of a shape")),
    )
    told = saved.select(envelope, "water", "digest", "regions", fault.alias("fault"))

    def compare(r: dict) -> dict:
        water = from_rows(r["water"])
        again = _derived(r[envelope], _canonical(water))
        wrong = [name for name in ("water", "digest", "regions") if again[name] != r[name]]
        return {"problem": ",".join(wrong)}

    sound = per_row(told.where("fault IS NULL").drop("fault"), "problem string", compare, [envelope])
    return sound.unionByName(told.where("fault IS NOT NULL").select(envelope, F.col("fault").alias("problem")))
