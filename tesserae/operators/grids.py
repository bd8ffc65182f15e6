"""Generated grids: world cells, viewports, campaigns, tile windows. Nothing is materialised beyond what a row asks for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import frames as f
from tesserae.functions.constants import ARENA_HALF, EARTH_RADIUS, SECTOR_METRES, TILES_PER_AXIS, WATER_HALO

METRES_PER_DEGREE = EARTH_RADIUS * math.pi / 180


def world_cell_of(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with row and col of their world cell; null over the polar caps."""
    row = f.world_row(F.col(lat))
    return points.withColumn("row", row).withColumn("col", F.when(F.col("row").isNotNull(), f.world_column(F.col(lon), F.col("row"))))


def nearest_cell(points: DataFrame, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(key, cell_id): of the 3 x 3 cells around a point, the one with the nearest centre; ties by cell id."""
    limit = f.ROWS_PER_HEMISPHERE
    row = F.least(F.greatest(F.floor(f.snap(F.col(lat) / f.LATITUDE_STEP)), F.lit(-limit)), F.lit(limit - 1))
    rows = points.withColumn("__base", row).withColumn("__row", F.explode(F.sequence(F.greatest(F.col("__base") - 1, F.lit(-limit)), F.least(F.col("__base") + 1, F.lit(limit - 1)))))
    rows = rows.withColumn("__n", f.row_columns(F.col("__row")))
    rows = rows.withColumn("__mid", F.floor((f.wrap_degrees(F.col(lon)) + 180.0) / 360.0 * F.col("__n"))).withColumn("__d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    rows = rows.withColumn("__cell", f.world_cell(F.col("__row"), F.pmod(F.col("__mid") + F.col("__d"), F.col("__n"))))
    order = f.haversine_order(F.col(lon), F.col(lat), F.col("__cell.lon"), F.col("__cell.lat"))
    return rows.groupBy(key).agg(F.min_by("__cell.cell_id", F.struct(order, F.col("__cell.cell_id"))).alias("cell_id"))


def visible_cells(views: DataFrame, key: str, max_cells: int = 400) -> DataFrame:
    """(key, total, row, col) of all cells that meet a viewport (west, south, east, north).

    A viewport with more than ``max_cells`` yields one row without a cell, never a sample.
    The count comes from arithmetic per row, before any cell is generated.
    """
    limit = f.ROWS_PER_HEMISPHERE
    first = F.greatest(F.lit(-limit), F.floor(f.snap(F.col("south") / f.LATITUDE_STEP)))
    last = F.least(F.lit(limit - 1), F.ceil(f.snap(F.col("north") / f.LATITUDE_STEP)) - 1)
    rows = views.withColumns({"__a": first, "__b": last, "__i": f.viewport_intervals(F.col("west"), F.col("east"))}).where("__a <= __b").withColumn("row", F.explode(F.sequence("__a", "__b")))
    rows = rows.withColumn("__n", f.row_columns(F.col("row")))
    held = lambda c: F.least(F.greatest(c, F.lit(0)), F.col("__n") - 1)
    span = lambda i: F.struct(
        held(F.floor(f.snap((i["west"] + 180.0) / 360.0 * F.col("__n")))).alias("lo"), held(F.ceil(f.snap((i["east"] + 180.0) / 360.0 * F.col("__n"))) - 1).alias("hi")
    )
    rows = rows.withColumn("__s", F.array_sort(F.transform("__i", span)))
    # two intervals that meet or touch are one
    a, b = F.get("__s", F.lit(0)), F.get("__s", F.lit(1))
    joined = F.when(b.isNull() | (b["lo"] > a["hi"] + 1), F.col("__s")).otherwise(F.array(F.struct(a["lo"].alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))))
    rows = rows.withColumn("__s", joined).withColumn("__c", F.aggregate("__s", F.lit(0).cast("long"), lambda t, s: t + s["hi"] - s["lo"] + 1))
    # a view's rows meet in a window, as a join with the totals would send a row for each view to every task
    rows = rows.withColumn("total", F.sum("__c").over(Window.partitionBy(key))).withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy("row")))
    fits = F.col("total") <= max_cells
    rows = rows.where(fits | (F.col("__nth") == 1)).select(key, "total", F.when(fits, F.col("row")).alias("row"), F.when(fits, F.col("__s")).alias("__s"))
    cols = F.when(F.col("__s").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.flatten(F.transform("__s", lambda s: F.sequence(s["lo"], s["hi"]))))
    return rows.select(key, "total", "row", F.explode(cols).alias("col"))


def campaign_grid(areas: DataFrame, key: str, max_sectors: int = 1600) -> DataFrame:
    """Sectors of 10 km that cover each area (west, south, east, north), nearest to its point (lon, lat) first.

    All sectors of an area share the basis of its middle latitude. Too many sectors fail the job.
    """
    basis = f.half_up((F.col("south") + F.col("north")) / 2, 7)
    dlat = SECTOR_METRES / METRES_PER_DEGREE
    grid = areas.withColumn("basis", basis).withColumn("__dlon", SECTOR_METRES / (METRES_PER_DEGREE * F.cos(F.col("basis") * f.DEGREE)))
    width = F.when(F.col("east") < F.col("west"), F.col("east") + 360.0).otherwise(F.col("east")) - F.col("west")
    grid = grid.withColumns({"__rows": F.ceil((F.col("north") - F.col("south")) / dlat - 1e-10), "__cols": F.ceil(width / F.col("__dlon") - 1e-10)})
    count = F.col("__rows") * F.col("__cols")
    grid = grid.withColumn("__rows", F.when(count <= max_sectors, F.col("__rows")).otherwise(F.raise_error(F.lit("an area has too many sectors")).cast("long")))
    zero = F.lit(0).cast("long")
    cells = grid.withColumn("row", F.explode(F.sequence(zero, F.col("__rows") - 1))).withColumn("col", F.explode(F.sequence(zero, F.col("__cols") - 1)))
    south, west = F.col("south") + F.col("row") * dlat, F.col("west") + F.col("col") * F.col("__dlon")
    cells = cells.withColumns({"center_lat": south + dlat / 2, "center_lon": f.wrap_degrees(west + F.col("__dlon") / 2)})
    dx = f.wrap_degrees(F.col("center_lon") - F.col("lon")) * F.cos(F.col("basis") * f.DEGREE)
    order = Window.partitionBy(key).orderBy(f.half_up(dx * dx + F.pow(F.col("center_lat") - F.col("lat"), 2), 9), "row", "col")
    return cells.withColumn("ordinal", F.row_number().over(order) - 1).select(key, "row", "col", "ordinal", "basis", "center_lon", "center_lat")


def tile_window(boxes: DataFrame, half: float | None = None, max_tiles: int = 64, basis: str = "lat") -> DataFrame:
    """Native tiles (x, y) that a local box meets, around a centre (lon, lat) with a basis, by default the centre's.

    With ``half`` the box is the square of that half width. More than ``max_tiles`` give one row without a tile.
    """
    box = {c: F.lit(v) for c, v in zip(("min_x", "min_y", "max_x", "max_y"), (-half, -half, half, half), strict=True)} if half else {c: F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")}
    scale = METRES_PER_DEGREE * F.cos(F.col(basis) * f.DEGREE)
    rows = boxes.withColumns({
        "__x0": F.floor(f.tile_x(F.col("lon") + box["min_x"] / scale)), "__x1": F.ceil(f.tile_x(F.col("lon") + box["max_x"] / scale)) - 1,
        "__y0": F.floor(f.tile_y(F.col("lat") + box["max_y"] / METRES_PER_DEGREE)), "__y1": F.ceil(f.tile_y(F.col("lat") + box["min_y"] / METRES_PER_DEGREE)) - 1,
    })
    rows = rows.withColumn("tile_count", (F.col("__x1") - F.col("__x0") + 1) * (F.col("__y1") - F.col("__y0") + 1))
    tiles = rows.where(F.col("tile_count") <= max_tiles).withColumn("tile_y", F.explode(F.sequence("__y0", "__y1")))
    tiles = tiles.withColumn("tile_x", F.explode(F.sequence("__x0", "__x1"))).withColumn("tile_x", F.pmod("tile_x", F.lit(TILES_PER_AXIS).cast("long")))
    none = rows.where(F.col("tile_count") > max_tiles).withColumns({"tile_y": F.lit(None).cast("long"), "tile_x": F.lit(None).cast("long")})
    return tiles.unionByName(none).drop("__x0", "__x1", "__y0", "__y1")


def water_tiles(centers: DataFrame) -> DataFrame:
    """Tiles of the arena and the water around it."""
    return tile_window(centers, ARENA_HALF + WATER_HALO)


def top_viewport(cities: DataFrame, west: Column, south: Column, east: Column, north: Column, population: str, keep: int = 10) -> DataFrame:
    """The largest places within a viewport that may cross the date line."""
    span = F.when(east < west, east - west + 360.0).otherwise(east - west)
    inside = F.col("lat").between(south, north) & (F.pmod(F.col("lon") - west, F.lit(360.0)) <= F.least(F.lit(360.0), span))
    return cities.where(inside).orderBy(F.desc(population), "id").limit(keep)


def page_bounds(count: Column, page: Column, size: int = 9) -> Column:
    """Page number within range, number of pages, and first and last row (exclusive)."""
    total = F.greatest(F.lit(0), F.floor(F.coalesce(count, F.lit(0))))
    pages = F.ceil(total / size)
    chosen = F.greatest(F.lit(0), F.least(F.greatest(pages - 1, F.lit(0)), F.floor(F.coalesce(page, F.lit(0)))))
    return F.struct(chosen.alias("page"), pages.alias("pages"), (chosen * size).alias("first"), F.least(total, chosen * size + size).alias("last"))


def single_cell_campaigns(cells: DataFrame) -> DataFrame:
    """Campaigns of one world cell (row, col): its identifiers, bounds, centre and basis, as one sector in one row and column."""
    c = f.world_cell(F.col("row"), F.col("col"))
    told = cells.withColumn("__c", c)
    return told.select("row", "col", *(F.col(f"__c.{n}").alias(n) for n in ("campaign_id", "cell_id", "west", "south", "east", "north", "lon", "lat", "basis")), F.lit(1).alias("rows"), F.lit(1).alias("cols"))


def visual_tiles(views: DataFrame, key: str, max_tiles: int = 16, tile_pixels: int = 512) -> DataFrame:
    """(key, z, x, y, ordinal): the display tiles of a view (mx, my as shares of the world, zoom, width, height), nearest first.

    The level is the whole zoom, or the next lower one whose window has few enough tiles. Columns wrap around the world; rows beyond it are left out.
    """
    # dealt to as many tasks as Spark is told to have, as each view becomes many rows
    views = views.repartition(int(views.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    levels = views.withColumn("z", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor("zoom")).cast("int"))))
    n = F.pow(F.lit(2.0), F.col("z"))
    half = lambda side: F.col(side) / (2 * tile_pixels * F.pow(F.lit(2.0), F.col("zoom")))
    edge = lambda c, side, sign: F.floor((F.col(c) + sign * half(side)) * n)
    levels = levels.withColumns({"__x0": edge("mx", "width", -1), "__x1": edge("mx", "width", 1), "__y0": F.greatest(F.lit(0), edge("my", "height", -1)), "__y1": F.least(n.cast("long") - 1, edge("my", "height", 1))})
    fits = (F.col("__x1") - F.col("__x0") + 1) * (F.col("__y1") - F.col("__y0") + 1) <= max_tiles
    best = levels.where(fits).groupBy(key).agg(F.max_by(F.struct("z", "mx", "my", "__x0", "__x1", "__y0", "__y1"), "z").alias("b")).select(key, "b.*").where("__y0 <= __y1")
    rows = best.withColumn("column", F.explode(F.sequence("__x0", "__x1"))).withColumn("y", F.explode(F.sequence("__y0", "__y1")))
    away = F.pow((F.col("column") + 0.5) / n - F.col("mx"), 2) + F.pow((F.col("y") + 0.5) / n - F.col("my"), 2)
    order = Window.partitionBy(key).orderBy(f.half_up(away * n * n, 9), "y", "column")
    return rows.withColumn("ordinal", F.row_number().over(order) - 1).select(key, "z", F.pmod("column", n.cast("long")).alias("x"), "y", "ordinal")
