"""Points against the edges of regions: containment, and the nearest land, by an index of edge rows.

A region is a multipolygon of any size; its edges are rows of their own, so no task and no expression ever holds a whole outline. Containment is even-odd over a
horizontal ray: points meet the edges of their band only, every crossing is a bit, and bits are combined by exclusive or, map-side too. What lies on an edge is inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.constants import ARENA_HALF
from tesserae.functions.frames import overrun
from tesserae.sources.staging import stage, stage_result

#: How far from an edge a point counts as on it, in metres.
EPS = 1e-9


def edge_rows(regions: DataFrame, key: str = "region", polygons: str = "polygons") -> DataFrame:
    """(key, edge, ax, ay, bx, by, tx, ty, min_x, min_y, max_x, max_y): the edges of each region with their unit tangents and boxes; those without length are left out."""
    ring = regions.select(key, F.posexplode(polygons).alias("__p", "__polygon")).select(key, "__p", F.posexplode("__polygon").alias("__r", "__ring"))
    # each vertex with the next one by slices, so that a long ring is one pass
    following = F.concat(F.slice("__ring", 2, F.greatest(F.size("__ring") - 1, F.lit(0))), F.slice("__ring", 1, 1))
    pairs = ring.select(key, "__p", "__r", F.posexplode(F.arrays_zip(F.col("__ring").alias("a"), following.alias("b"))).alias("__k", "e"))
    rows = pairs.select(key, F.struct("__p", "__r", "__k").alias("edge"), *(F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"))
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    rows = rows.withColumn("__size", size).where("__size > 0")
    low, high = (lambda c: F.least(f"a{c}", f"b{c}")), (lambda c: F.greatest(f"a{c}", f"b{c}"))
    return rows.select(
        key, "edge", "ax", "ay", "bx", "by", ((F.col("bx") - F.col("ax")) / F.col("__size")).alias("tx"), ((F.col("by") - F.col("ay")) / F.col("__size")).alias("ty"),
        low("x").alias("min_x"), low("y").alias("min_y"), high("x").alias("max_x"), high("y").alias("max_y"),
    )


def on_edge(x: Column, y: Column) -> Column:
    """Whether a point lies within EPS of an edge row, by physical distance whatever the edge's length."""
    near = x.between(F.col("min_x") - EPS, F.col("max_x") + EPS) & y.between(F.col("min_y") - EPS, F.col("max_y") + EPS)
    return near & (F.abs((x - F.col("ax")) * F.col("ty") - (y - F.col("ay")) * F.col("tx")) <= EPS)


def crosses(x: Column, y: Column) -> Column:
    """Whether the ray from a point to the right crosses an edge row."""
    at = (F.col("bx") - F.col("ax")) * F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay")) + F.col("ax")
    return ((F.col("ay") > y) != (F.col("by") > y)) & F.coalesce(x < at, F.lit(False))


def contained(points: DataFrame, edges: DataFrame, point: str = "id", key: str = "region", band: float = 16.0, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, point, key) of all pairs of a point (point, x, y) and a region that holds it, by even-odd containment with solid boundaries.

    ``edges`` come from ``edge_rows``. With ``within``, points meet only regions of equal values in these columns. A point meets the edges of its band that don't end left of it; a crowded
    band is a skewed key, which adaptive execution can split, as what follows is a sum of bits.
    """
    at = lambda c: F.floor(c / band)
    spread = edges.withColumn("__band", F.explode(F.sequence(at(F.col("min_y") - EPS), at(F.col("max_y") + EPS))))
    near = points.select(*within, point, "x", "y", at(F.col("y")).alias("__band")).join(spread, [*within, "__band"])
    x, y = F.col("x"), F.col("y")
    met = near.where(x <= F.col("max_x") + EPS).select(*within, point, key, crosses(x, y).cast("int").alias("__odd"), on_edge(x, y).alias("__on"))
    told = met.groupBy(*within, point, key).agg(F.bit_xor("__odd").alias("__odd"), F.bool_or("__on").alias("__on"))
    return told.where("__on OR __odd = 1").select(*within, point, key)


def nearest(points: DataFrame, targets: DataFrame, point: str, target: str, distance: Column, k: int = 1, base: float | None = None, edges: bool = False) -> DataFrame:
    """(point, target, distance, rank): the k nearest targets of every point, exactly, without a radius; ties by target.

    Points are rows (point, x, y); targets rows (target, px, py), or with ``edges`` edge rows named by ``target``. ``distance`` is an expression of both, a distance in the plane.
    Level by level, points that aren't settled meet the targets of the 3 x 3 cells around them, and the cells' sides double. A point is settled when its k-th distance
    doesn't pass the side, as whatever lies further away than the ring is further than that, or when the cells cover all targets. Settled points take no part in later levels, so a level joins
    few points where cells are large. One number of the open points comes to the driver at each level. Points without coordinates have no neighbours; ids of points are unique.
    """
    if not edges:
        # points of one place have the same neighbours, and of the targets of one place only the first k can be among them
        first = F.row_number().over(Window.partitionBy("px", "py").orderBy(target))
        targets = targets.select(target, "px", "py").withColumn("__n", first).where(F.col("__n") <= k).drop("__n")
        one = points.select(point, "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.min(point).alias(point))
        found = _nearest(one, targets, point, target, distance, k, base, False)
        members = points.select(point, "x", "y").join(one.withColumnRenamed(point, "__one").hint("merge"), ["x", "y"]).select(point, "__one")
        return members.join(found.withColumnRenamed(point, "__one").hint("merge"), "__one").select(point, target, "distance", "rank")
    return _nearest(points, targets, point, target, distance, k, base, edges)


def _nearest(points: DataFrame, targets: DataFrame, point: str, target: str, distance: Column, k: int, base: float | None, edges: bool) -> DataFrame:
    spark = points.sparkSession
    low_x, low_y, high_x, high_y = ("min_x", "min_y", "max_x", "max_y") if edges else ("px", "py", "px", "py")

    def build() -> DataFrame:
        held = stage(targets, "nearest-targets")
        extent = held.agg(F.min(low_x).alias("x0"), F.min(low_y).alias("y0"), F.max(high_x).alias("x1"), F.max(high_y).alias("y1"), F.count("*").alias("n")).first()
        found, open_ = [], stage(points.select(point, "x", "y").where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))), "nearest-points")
        if not extent["n"]:
            return open_.join(held.select(target), F.lit(False)).select(point, target, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        reach = max(extent["x1"] - extent["x0"], extent["y1"] - extent["y0"], 1e-6)
        # about k targets in a cell, were they spread evenly
        side = base or max(reach * (k / extent["n"]) ** 0.5, reach / 2**20)
        if edges:  # no edge in more than a few thousand cells
            side = max(side, held.agg(F.max(F.greatest(F.col(high_x) - F.col(low_x), F.col(high_y) - F.col(low_y)))).first()[0] / 64)
        gap = F.greatest(extent["x0"] - F.col("x"), F.col("x") - extent["x1"], extent["y0"] - F.col("y"), F.col("y") - extent["y1"], F.lit(0.0))
        # cells smaller than the way of all open points to the nearest target that there can be hold nothing
        while (least := open_.agg(F.min(gap)).first()[0]) is not None:
            side = max(side, least)
            covers = (F.col("x") - side <= extent["x0"]) & (F.col("x") + side >= extent["x1"]) & (F.col("y") - side <= extent["y0"]) & (F.col("y") + side >= extent["y1"])
            at = lambda c: F.floor(c / side)  # noqa: B023, E731
            around = lambda c: F.explode(F.sequence(at(F.col(c)) - 1, at(F.col(c)) + 1))  # noqa: B023, E731
            asked = open_.withColumn("__cx", around("x")).withColumn("__cy", around("y"))
            if edges:
                there = held.withColumn("__cx", F.explode(F.sequence(at(F.col(low_x)), at(F.col(high_x))))).withColumn("__cy", F.explode(F.sequence(at(F.col(low_y)), at(F.col(high_y)))))
            else:
                there = held.withColumns({"__cx": at(F.col("px")), "__cy": at(F.col("py"))})
            met = asked.join(there, ["__cx", "__cy"]).withColumn("distance", distance).select(point, "x", "y", target, "distance")
            if edges:  # an edge may lie in several of the cells
                met = met.groupBy(point, "x", "y", target).agg(F.min("distance").alias("distance"))
            rank = F.row_number().over(Window.partitionBy(point).orderBy("distance", target))
            best = met.withColumn("rank", rank).where(F.col("rank") <= k)
            settled = best.groupBy(point, "x", "y").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
            settled = settled.where(((F.col("n") == k) & (F.col("far") <= side)) | covers).select(point)
            done = stage(best.join(settled, point, "left_semi").select(point, target, "distance", "rank"), "nearest-found")
            found.append(done)
            open_ = stage(open_.join(done.select(point).distinct(), point, "left_anti"), "nearest-open")
            side *= 2
        return reduce(DataFrame.unionByName, found) if found else held.limit(0).select(F.lit(None).cast(points.schema[point].dataType).alias(point), target, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))

    return stage_result(build, spark, "nearest")


def edge_distance(x: str = "x", y: str = "y") -> Column:
    """Distance of a point from an edge row."""
    t = share_along(x, y)
    return F.hypot(F.col(x) - F.col("ax") - t * (F.col("bx") - F.col("ax")), F.col(y) - F.col("ay") - t * (F.col("by") - F.col("ay")))


def share_along(x: str = "x", y: str = "y") -> Column:
    """Where along an edge row its point nearest to (x, y) lies, from 0 to 1."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - F.col("ax")) * dx + (F.col(y) - F.col("ay")) * dy) / (dx * dx + dy * dy)))


def nearest_land(points: DataFrame, regions: DataFrame, point: str = "id", key: str = "region") -> DataFrame:
    """(point, land_x, land_y, distance): each point itself where a region holds it, else the nearest point on an edge of a region."""
    # regions of one shape are one, named by the smallest key, which is also the one that wins a tie; points of one place are one, too
    edges = edge_rows(regions.groupBy("polygons").agg(F.min(key).alias(key)), key)
    every = points.select(point, "x", "y")
    points = every.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.min(point).alias(point))
    inside = contained(points, edges, point, key).select(point).distinct()
    outside = points.join(inside, point, "left_anti")
    named = edges.withColumn("__edge", F.struct(key, "edge"))
    found = nearest(outside, named.drop(key, "edge"), point, "__edge", edge_distance(), edges=True)
    back = found.join(points, point).join(named.drop("edge", key), "__edge")
    t = share_along()
    moved = back.select("x", "y", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("land_x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("land_y"), "distance")
    own = points.join(inside, point, "left_semi").select("x", "y", F.col("x").alias("land_x"), F.col("y").alias("land_y"), F.lit(0.0).alias("distance"))
    return every.join(own.unionByName(moved), ["x", "y"]).select(point, "land_x", "land_y", "distance")


def reachable(points: DataFrame, land: DataFrame, point: str = "id", key: str = "region") -> DataFrame:
    """(point, reachable): whether a hole of this radius can be at a point (point, key, x, y, radius) of its land (key, active, allowed polygons) without crossing water.

    Allowed land is cut to the arena grown by what the radius may overrun it; of what is left, the components that meet active land count. They are made once for each region and
    overrun, whatever the number of points; a region's land is bounded by the limits of its extract.
    """
    from .overlay import INTERSECTION, POLYGONS, from_rows, overlay, overlay_area, per_row, square, to_rows

    asked = points.select(point, key, "x", "y", F.floor(overrun(F.col("radius")) * 1000).alias("__overrun"))
    wanted = asked.select(key, "__overrun").distinct().join(land.select(key, "active", "allowed"), key)

    def cut(r: dict) -> dict:
        active, half = from_rows(r["active"]), ARENA_HALF + r["__overrun"] / 1000
        parts = overlay(from_rows(r["allowed"]), square(-half, half), INTERSECTION)
        return {"polygons": to_rows([p for p in parts if overlay_area([p], active, INTERSECTION) > 0])}

    cuts = per_row(wanted, f"polygons {POLYGONS}", cut, [key, "__overrun"]).withColumn("__land", F.struct(key, "__overrun"))
    edges = edge_rows(cuts, "__land").withColumns({key: F.col(f"__land.{key}"), "__overrun": F.col("__land.__overrun")})
    there = contained(asked, edges, point, "__land", within=(key, "__overrun")).select(point).distinct().withColumn("__in", F.lit(True))
    return points.select(point).join(there, point, "left").select(point, F.col("__in").isNotNull().alias("reachable"))
