"""Clipping of polygons to boxes, side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import shapes


def clip_polygons(rows: DataFrame, polygons: str, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> DataFrame:
    """Rows with their multipolygon cut to a box: exact for concave outlines, which fall into several, and for holes across the box's sides. What lies outside leaves an empty array.

    Each side is a step of its own, as one expression for all four is nested too deeply for the analyser.
    """
    for axis, edge, above in (("x", min_x, True), ("y", min_y, True), ("x", max_x, False), ("y", max_y, False)):
        cut = lambda p: shapes.cut_polygon(p, axis, edge, above)  # noqa: B023, E731
        rows = rows.withColumn(polygons, F.flatten(F.transform(polygons, cut)))
    return rows
