"""Coverage of arenas from sets of vector tiles: what is known is kept, and only what other tiles change is made anew.

A chunk of an arena is known once all native tiles that it meets are there, an empty one included; a missing tile leaves it unknown. Its signature is a
digest of these tiles and their revisions, newest ones first come. A refresh compares signatures, which takes keys only, then decodes the tiles of stale
chunks, each once for every sector that wants it, and adds up words; contents of other tiles aren't read, and decoded shapes aren't moved.

Sectors are rows (sector, lon, lat, basis), tiles rows (x, y, revision, content) of the native zoom, coverage rows (sector, cx, cy, w, bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import runs
from tesserae.functions.constants import CHUNKS_PER_AXIS, NATIVE_ZOOM
from tesserae.sources.tiles import tile_fragments

from . import cells, grids, words

CHUNK = ["sector", "cx", "cy"]


def contributors(sectors: DataFrame, max_tiles: int = 64) -> DataFrame:
    """(sector, cx, cy, x, y): the native tiles that each chunk of each sector meets; columns wrap around the world.

    A chunk that would meet more than ``max_tiles`` has one row without a tile, and so is never known.
    """
    axis = F.sequence(F.lit(0), F.lit(CHUNKS_PER_AXIS - 1))
    chunks = sectors.select("sector", "lon", "lat", "basis", F.explode(axis).alias("cx")).withColumn("cy", F.explode(axis))
    boxed = chunks.withColumn("__b", words.chunk_bounds(F.col("cx"), F.col("cy"))).select(*CHUNK, "lon", "lat", "basis", "__b.*")
    return grids.tile_window(boxed, max_tiles=max_tiles, basis="basis").select(*CHUNK, F.col("tile_x").alias("x"), F.col("tile_y").alias("y"))


def desired_chunks(requests: DataFrame, margin: float = 150.0) -> DataFrame:
    """(sector, cx, cy, ordinal): the chunks that the newest request (sector, seq, x, y, radius, dx, dy) of each sector wants, nearest to it first."""
    columns = ("x", "y", "radius", "dx", "dy")
    newest = requests.groupBy("sector").agg(F.max_by(F.struct(*columns), "seq").alias("r")).select("sector", "r.*")
    box = runs.prefetch_box(F.col("x"), F.col("y"), F.col("radius"), margin, F.col("dx"), F.col("dy"))
    met = cells.chunks_of_box(newest.withColumn("__b", box).select("sector", "x", "y", "__b.*"))
    edges = words.chunk_bounds(F.col("cx"), F.col("cy"))
    away = F.pow((edges["min_x"] + edges["max_x"]) / 2 - F.col("x"), 2) + F.pow((edges["min_y"] + edges["max_y"]) / 2 - F.col("y"), 2)
    order = Window.partitionBy("sector").orderBy(away, "cy", "cx")
    return met.select(*CHUNK, (F.row_number().over(order) - 1).alias("ordinal"))


def signatures(sectors: DataFrame, tiles: DataFrame) -> DataFrame:
    """(sector, cx, cy, signature): a digest of each known chunk's tiles and their newest revisions, from keys alone."""
    newest = tiles.groupBy("x", "y").agg(F.max("revision").alias("revision"))
    needed = contributors(sectors).join(newest, ["x", "y"], "left")
    name = F.concat_ws("/", "x", "y", "revision")
    told = needed.groupBy(*CHUNK).agg(F.bool_and(F.col("revision").isNotNull()).alias("known"), F.array_join(F.array_sort(F.collect_list(name)), ",").alias("tiles"))
    return told.where("known").select(*CHUNK, F.sha2("tiles", 256).alias("signature"))


def refresh(sectors: DataFrame, tiles: DataFrame, held: tuple[DataFrame, DataFrame] | None = None, desired: DataFrame | None = None, layer: str = "building") -> tuple[DataFrame, DataFrame]:
    """Coverage and signatures (sector, cx, cy, signature, changed) of all known chunks, from what is held and the tiles there are now.

    Held chunks whose signature still holds are kept as they are; those whose tiles went or changed are dropped or made anew. With ``desired``, only these
    chunks are made, and held ones beyond them stay for as long as their signature holds.
    """
    now = signatures(sectors, tiles)
    if held is None:
        old_words, stale = None, now.withColumn("changed", F.lit(True))
        kept = None
    else:
        old_words, old = held
        both = now.join(old.select(*CHUNK, F.col("signature").alias("__old")), CHUNK, "left")
        told = both.withColumn("changed", ~F.col("signature").eqNullSafe(F.col("__old"))).drop("__old")
        kept, stale = told.where("not changed"), told.where("changed")
    if desired is not None:
        stale = stale.join(desired.select(*CHUNK).distinct(), CHUNK, "left_semi")
    made = _made(sectors, tiles, stale, layer)
    if kept is None:
        return made, stale
    return old_words.join(kept.select(*CHUNK), CHUNK, "left_semi").unionByName(made), kept.unionByName(stale)


def _made(sectors: DataFrame, tiles: DataFrame, stale: DataFrame, layer: str) -> DataFrame:
    """Words of the stale chunks."""
    wanted = contributors(sectors).join(stale.select(*CHUNK), CHUNK, "left_semi").select("sector", "x", "y").distinct()
    wanted = wanted.join(tiles.groupBy("x", "y").agg(F.max("revision").alias("revision")), ["x", "y"]).join(sectors, "sector")
    read = wanted.join(tiles.select("x", "y", "revision", "content"), ["x", "y", "revision"]).withColumn("z", F.lit(NATIVE_ZOOM))
    # packed tiles are few bytes and much work, so they are dealt to as many tasks as Spark has (by a key of their own, as a deal that the join has made already would be left out and its parts merged); what covers the same cells counts once
    read = read.repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("sector", "x", "y"))
    shapes = tile_fragments(read, layer, "lon", "lat", "basis", ("sector",), distinct=True)
    placed = words.polygon_words(shapes, ("sector", "x", "y", "nth"))
    return words.merged(placed.join(stale.select(*CHUNK), CHUNK, "left_semi"), ("sector",)).transform(words.within_grid)
