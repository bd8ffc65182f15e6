"""Sets of 2 m cells: rasterising shapes, set algebra, and awarding each cell to the first shape that touches it.

Shapes become row spans (gy, lo, hi) first and cells (gx, gy) last. Discs and capsules take cells whose centre they
reach, edges included; polygons take cells whose centre lies inside, with half-open spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.constants import ARENA_HALF, CELL_AREA, CELL_METRES, CHUNK_CELLS, CHUNK_METRES, CHUNKS_PER_AXIS, GRID_CELLS
from tesserae.functions.frames import cell_center, chunk_of

LAST = GRID_CELLS - 1


def _first(edge: Column) -> Column:
    """Smallest index whose centre is at or beyond a coordinate."""
    return F.greatest(F.lit(0).cast("long"), F.ceil((edge + ARENA_HALF) / CELL_METRES - 0.5))


def _last(edge: Column) -> Column:
    """Largest index whose centre is at or before a coordinate."""
    return F.least(F.lit(LAST).cast("long"), F.floor((edge + ARENA_HALF) / CELL_METRES - 0.5))


def _before(edge: Column) -> Column:
    """Largest index whose centre is before a coordinate."""
    return F.least(F.lit(LAST).cast("long"), F.ceil((edge + ARENA_HALF) / CELL_METRES - 0.5) - 1)


def _rows(df: DataFrame, low: Column, high: Column) -> DataFrame:
    return df.withColumns({"__lo": low, "__hi": high}).where("__lo <= __hi").withColumn("gy", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def span_cells(spans: DataFrame) -> DataFrame:
    """Cells (gx, gy) of spans (gy, lo, hi); empty spans have none."""
    return spans.where("lo <= hi").withColumn("gx", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def capsule_spans(shapes: DataFrame) -> DataFrame:
    """Spans of circles swept from (x, y) to (x2, y2) with a radius; a circle at rest has equal ends.

    All other columns come through. A row meets each disc on the way in a span, and the ends of these spans move along the way as concave and convex
    functions, whose extremes have a closed form: right and left are furthest where the row lies at a fixed height in the disc, or at an end of the way.
    """
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    dx, dy = F.col("x2") - x, F.col("y2") - y
    shapes = shapes.withColumns({"__dx": dx, "__dy": dy, "__tilt": F.coalesce(r * dx * F.signum(dy) / F.nullif(F.hypot(dx, dy), F.lit(0.0)), F.lit(0.0))})
    rows = _rows(shapes, _first(F.least(y, F.col("y2")) - r), _last(F.greatest(y, F.col("y2")) + r))
    dx, dy, tilt = F.col("__dx"), F.col("__dy"), F.col("__tilt")
    rows = rows.withColumn("__c", cell_center(F.col("gy")) - y)
    c, level = F.col("__c"), dy == 0
    # shares of the way on which the disc reaches the row
    reach = F.try_divide(r, F.abs(dy))
    rows = rows.withColumns({"__from": F.when(level, 0.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(c, dy) - reach)), "__to": F.when(level, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(c, dy) + reach))})
    share = lambda best: F.least(F.greatest(best, F.col("__from")), F.col("__to"))
    rightmost = F.when(level, (dx > 0).cast("double")).otherwise(share(F.try_divide(c + tilt, dy)))
    leftmost = F.when(level, (dx < 0).cast("double")).otherwise(share(F.try_divide(c - tilt, dy)))
    rows = rows.withColumns({"__right": rightmost, "__left": leftmost})
    half = lambda s: F.sqrt(F.greatest(F.lit(0.0), r * r - (c - dy * s) * (c - dy * s)))
    right, left = x + dx * F.col("__right") + half(F.col("__right")), x + dx * F.col("__left") - half(F.col("__left"))
    # one span to a row: a filter on it isn't pushed below, where the formula would be computed again
    rows = rows.withColumn("__span", F.explode(F.array(F.struct(_first(left).alias("lo"), _last(right).alias("hi")))))
    rows = rows.drop("x", "y", "x2", "y2", "radius", *(f"__{n}" for n in ("dx", "dy", "tilt", "c", "from", "to", "right", "left")))
    return rows.withColumns({"lo": F.col("__span.lo"), "hi": F.col("__span.hi")}).drop("__span").where("lo <= hi")


def disc_spans(shapes: DataFrame) -> DataFrame:
    """Spans of circles (x, y, radius)."""
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    rows = _rows(shapes, _first(y - r), _last(y + r))
    d = cell_center(F.col("gy")) - y
    half = F.sqrt(F.greatest(F.lit(0.0), r * r - d * d))
    return rows.withColumns({"lo": _first(x - half), "hi": _last(x + half)}).drop("x", "y", "radius").where("lo <= hi")


def rectangle_spans(boxes: DataFrame) -> DataFrame:
    """Spans of boxes (min_x, min_y, max_x, max_y), half-open as polygons are."""
    rows = _rows(boxes, _first(F.col("min_y")), _before(F.col("max_y")))
    return rows.withColumns({"lo": _first(F.col("min_x")), "hi": _before(F.col("max_x"))}).drop("min_x", "min_y", "max_x", "max_y").where("lo <= hi")


def polygon_spans(shapes: DataFrame, by: tuple[str, ...], polygons: str = "polygons") -> DataFrame:
    """Spans (by, __p, __r, gy, lo, hi) of each ring of multipolygons: polygon and ring by number, outer rings being 0.

    Every edge is cut by the rows it crosses; on a row, sorted crossings of a ring pair up into spans. ``by`` tells the shapes apart.
    """
    poly = shapes.select(*by, F.posexplode(polygons).alias("__p", "__polygon"))
    ring = poly.select(*by, "__p", F.posexplode("__polygon").alias("__r", "__ring")).where(F.size("__ring") >= 3)
    nth = ring.select(*by, "__p", "__r", "__ring", F.posexplode("__ring").alias("__k", "b"))
    edge = nth.select(*by, "__p", "__r", "b", F.when(F.col("__k") > 0, F.get("__ring", F.col("__k") - 1)).otherwise(F.element_at("__ring", -1)).alias("a"))
    low, high = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    rows = _rows(edge.where("a.y <> b.y"), _first(low), _before(high))
    cy = cell_center(F.col("gy"))
    rows = rows.where((F.col("a.y") > cy) != (F.col("b.y") > cy))
    at = F.col("a.x") + (cy - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))
    line = rows.groupBy(*by, "__p", "__r", "gy").agg(F.array_sort(F.collect_list(at)).alias("__xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("__xs", 2 * i).alias("a"), F.get("__xs", 2 * i + 1).alias("b")))
    spans = line.where(F.size("__xs") >= 2).select(*by, "__p", "__r", "gy", F.explode(pairs).alias("__s"))
    return spans.select(*by, "__p", "__r", "gy", _first(F.col("__s.a")).alias("lo"), _before(F.col("__s.b")).alias("hi"))


def polygon_cells(shapes: DataFrame, key: str, polygons: str = "polygons") -> DataFrame:
    """Distinct cells (key, gx, gy) of multipolygons; each polygon's holes come off before the union."""
    cells = span_cells(polygon_spans(shapes, (key,), polygons))
    # a cell belongs to a polygon if its outer ring covers it and no hole does
    kept = cells.groupBy(key, "__p", "gx", "gy").agg(F.bool_and(F.col("__r") == 0).alias("solid"))
    return kept.where("solid").select(key, "gx", "gy").distinct()


def chunks_of_box(boxes: DataFrame) -> DataFrame:
    """Chunks (cx, cy) that boxes meet, within the arena."""
    index = lambda c: F.least(F.lit(CHUNKS_PER_AXIS - 1), F.greatest(F.lit(0), F.floor((F.col(c) + ARENA_HALF) / CHUNK_METRES))).cast("int")
    inside = "max_x >= -1500 and max_y >= -1500 and min_x < 1500 and min_y < 1500"
    rows = boxes.where(inside).withColumn("cx", F.explode(F.sequence(index("min_x"), index("max_x"))))
    return rows.withColumn("cy", F.explode(F.sequence(index("min_y"), index("max_y"))))


def chunk_key(cx: Column, cy: Column) -> Column:
    return F.concat_ws(",", cx.cast("string"), cy.cast("string"))


def first_touch(cells: DataFrame, coverage: DataFrame, seq: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gx, gy, seq): each covered cell and the first shape that reaches it.

    ``coverage`` is joined before the minimum, and both keep duplicates out of the shuffle by partial
    aggregation, so a much-visited cell costs one row per task.
    """
    keys = [*by, "gx", "gy"]
    first = cells.groupBy(*keys).agg(F.min(seq).alias(seq))
    return first.join(coverage.select("gx", "gy").distinct(), ["gx", "gy"], "left_semi").select(*keys, seq)


def first_touch_late(cells: DataFrame, coverage: DataFrame, seq: str = "seq") -> DataFrame:
    """As first_touch, where coverage rows have ``since``: only shapes from then on count for the cell."""
    known = coverage.groupBy("gx", "gy").agg(F.min("since").alias("since"))
    return cells.join(known, ["gx", "gy"]).where(F.col(seq) >= F.col("since")).groupBy("gx", "gy").agg(F.min(seq).alias(seq))


def awards(touched: DataFrame, seq: str = "seq") -> DataFrame:
    """Area and bounds of the cells that each shape was awarded."""
    low, high = (lambda c: F.min(c) * CELL_METRES - ARENA_HALF), (lambda c: (F.max(c) + 1) * CELL_METRES - ARENA_HALF)
    return touched.groupBy(seq).agg(
        (F.count("*") * CELL_AREA).alias("area_m2"), low("gx").alias("min_x"), low("gy").alias("min_y"), high("gx").alias("max_x"), high("gy").alias("max_y")
    )


def covered_at(points: DataFrame, coverage: DataFrame, known_chunks: DataFrame) -> DataFrame:
    """Points (gx, gy, …) with ``covered``: true, false, or null where the chunk isn't known."""
    known = known_chunks.select("cx", "cy").distinct().withColumn("__k", F.lit(True))
    cells = coverage.select("gx", "gy").distinct().withColumn("__c", F.lit(True))
    placed = points.withColumns({"cx": chunk_of(F.col("gx")), "cy": chunk_of(F.col("gy"))})
    joined = placed.join(known, ["cx", "cy"], "left").join(cells, ["gx", "gy"], "left")
    return joined.withColumn("covered", F.when(F.col("__k"), F.col("__c").isNotNull())).drop("__k", "__c", "cx", "cy")


def interval_cover(intervals: DataFrame, key: str, low: str, high: str, eps: float = 1e-10) -> DataFrame:
    """(key, island, low, high): the union of each key's intervals, gaps of up to ``eps`` closed."""
    order = Window.partitionBy(key).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col(low) > reach + eps), 1).otherwise(0)
    islands = intervals.withColumn("__new", starts).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min(low).alias(low), F.max(high).alias(high))


def interval_overlaps(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Common parts, longer than ``eps``, of two arrays of struct<lo,hi>."""
    part = lambda x, y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi"))
    return F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: part(x, y)))), lambda i: i["hi"] - i["lo"] > eps)
