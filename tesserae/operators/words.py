"""Sets of 2 m cells as 64-bit words: the coverage of an arena from its first tile to its saved state.

A word (cx, cy, w, bits) holds 64 cells of one row of a chunk; w counts words row by row, 1024 to a chunk. Sets of several arenas have
further key columns (``by``). Spans become words before any shuffle, words of one place combine map-side by ``bit_or``, and set
algebra is a join on words and an operation on bits, so a cell is never a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.checks import required
from tesserae.functions.constants import ARENA_HALF, CELL_AREA, CELL_METRES, CHUNK_CELLS, CHUNK_METRES, GRID_CELLS

from .cells import polygon_spans

KEY = ("cx", "cy", "w")
CHUNK_WORDS = 1024
CHUNK_BYTES = 8192
SIGN = -(1 << 63)  # the word of the last place alone
#: Masks of the places 0 to 63 whose number has bit n set, as signed numbers.
PLACE_BITS = [int.from_bytes(sum(1 << k for k in range(64) if k >> n & 1).to_bytes(8, "little"), "little", signed=True) for n in range(6)]


def _none() -> Column:
    return F.lit(0).cast("long")


def range_mask(low: Column, high: Column) -> Column:
    """Bits low to high (0 to 63, both included) of a word."""
    ones = F.lit(-1).cast("long")
    return F.call_function("shiftleft", ones, low.cast("int")).bitwiseAND(F.call_function("shiftrightunsigned", ones, (63 - high).cast("int")))


def _placed(spans: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row (by, cx, cy, w, bits) for each word that a span meets."""
    at = spans.where("lo <= hi").withColumn("k", F.explode(F.sequence(F.shiftright("lo", 6), F.shiftright("hi", 6))))
    bits = range_mask(F.greatest(F.col("lo") - F.col("k") * 64, F.lit(0)), F.least(F.col("hi") - F.col("k") * 64, F.lit(63)))
    return at.select(*by, F.shiftright("k", 2).cast("int").alias("cx"), F.shiftright("gy", 8).cast("int").alias("cy"), ((F.col("gy") % CHUNK_CELLS) * 4 + F.col("k") % 4).cast("int").alias("w"), bits.alias("bits"))


def span_words(spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cx, cy, w, bits) of spans (by, gy, lo, hi)."""
    return merged(_placed(spans, by), by)


def polygon_words(shapes: DataFrame, by: tuple[str, ...], polygons: str = "polygons") -> DataFrame:
    """(by, cx, cy, w, bits) of multipolygons, which ``by`` tells apart: each polygon's holes come off before the union, all on words."""
    ring = _placed(polygon_spans(shapes, by, polygons), (*by, "__p", "__r"))
    outer, holes = F.bit_or(F.when(F.col("__r") == 0, F.col("bits"))), F.bit_or(F.when(F.col("__r") > 0, F.col("bits")))
    polygon = ring.groupBy(*by, "__p", *KEY).agg(outer.bitwiseAND(F.bitwise_not(F.coalesce(holes, _none()))).alias("bits"))
    return merged(polygon.where("bits <> 0"), by)


def cell_words(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The words of cells (by, gx, gy)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gx") % 64).cast("int"))
    w = (F.col("gy") % CHUNK_CELLS) * 4 + F.floor(F.col("gx") % CHUNK_CELLS / 64)
    return merged(cells.select(*by, F.shiftright("gx", 8).cast("int").alias("cx"), F.shiftright("gy", 8).cast("int").alias("cy"), w.cast("int").alias("w"), bit.alias("bits")), by)


def word_cells(words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells (by, gx, gy) of words."""
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftrightunsigned", F.col("bits"), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    rows = words.withColumn("k", F.explode(held))
    return rows.select(*by, (F.col("cx") * CHUNK_CELLS + F.col("w") % 4 * 64 + F.col("k")).cast("long").alias("gx"), (F.col("cy") * CHUNK_CELLS + F.floor(F.col("w") / 4)).cast("long").alias("gy"))


def index_sum(per_column: int, per_row: int) -> Column:
    """The sum of ``per_column * gx + per_row * gy`` over the cells of a word, without making them: a sum over the six bits of their places."""
    count = F.bit_count("bits").cast("long")
    within = sum((F.bit_count(F.col("bits").bitwiseAND(F.lit(mask).cast("long"))).cast("long") * (1 << n) for n, mask in enumerate(PLACE_BITS)), F.lit(0).cast("long"))
    gx = count * (F.col("cx") * CHUNK_CELLS + F.col("w") % 4 * 64) + within
    return gx * per_column + count * (F.col("cy") * CHUNK_CELLS + F.floor(F.col("w") / 4)) * per_row


def merged(words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each word: the union of all rows of it."""
    return words.groupBy(*by, *KEY).agg(F.bit_or("bits").alias("bits"))


def _with(a: DataFrame, b: DataFrame, by: tuple[str, ...], how: str) -> DataFrame:
    return a.join(b.select(*by, *KEY, F.col("bits").alias("__other")), [*by, *KEY], how)


def without(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What is in ``a`` and not in ``b``."""
    left = _with(a, b, by, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("__other", _none()))))
    return left.where("bits <> 0").drop("__other")


def common(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What is in both."""
    # a left join, so that ``a``, which may hold words of very many shapes, is never broadcast
    return _with(a, b, by, "left").withColumn("bits", F.col("bits").bitwiseAND(F.coalesce("__other", _none()))).where("bits <> 0").drop("__other")


def area(words: DataFrame, *by: str) -> DataFrame:
    """(by, area_m2) of sets: four square metres for each bit."""
    return words.groupBy(*by).agg((F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)) * CELL_AREA).cast("long").alias("area_m2"))


def chunk_bounds(cx: Column, cy: Column) -> Column:
    """Edges of a chunk in metres; the last ones end with the arena."""
    low = lambda c: c * CHUNK_METRES - ARENA_HALF
    high = lambda c: F.least(F.lit(ARENA_HALF), low(c + 1))
    return F.struct(low(cx).alias("min_x"), low(cy).alias("min_y"), high(cx).alias("max_x"), high(cy).alias("max_y"))


def within_grid(words: DataFrame) -> DataFrame:
    """Words without the bits of the padding beyond the arena's last column and row."""
    first = F.col("cx") * CHUNK_CELLS + F.col("w") % 4 * 64
    row = F.col("cy") * CHUNK_CELLS + F.floor(F.col("w") / 4)
    mask = F.when((row < GRID_CELLS) & (first < GRID_CELLS), range_mask(F.lit(0), F.least(F.lit(63), GRID_CELLS - 1 - first))).otherwise(_none())
    return words.withColumn("bits", F.col("bits").bitwiseAND(mask)).where("bits <> 0")


def ingest(held: DataFrame, incoming: DataFrame, region: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage with newly read chunks added, padding masked and clipped to the active region if there is one."""
    new = within_grid(incoming)
    return merged(held.unionByName(new if region is None else common(new, region, by)), by)


def evict(held: DataFrame, chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage without the chunks (by, cx, cy) given up."""
    return held.join(chunks.select(*by, "cx", "cy").distinct(), [*by, "cx", "cy"], "left_anti")


def install_region(coverage: DataFrame, region: DataFrame, consumed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage clipped to a region; fails the job for an arena where something has been consumed, as a region is chosen before play."""
    begun = consumed.groupBy(*by).agg(F.count("*").alias("__begun"))
    clipped = common(coverage, region, by)
    rows = clipped.join(begun, list(by), "left") if by else clipped.crossJoin(begun)  # one row
    return rows.withColumn("bits", required(F.col("bits"), F.coalesce("__begun", _none()) == 0, "the region can't change once cells are consumed").cast("long")).drop("__begun")


def restored(consumed: DataFrame, active: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Saved consumed cells; fails the job if they aren't part of the active land."""
    rows = _with(consumed, active, by, "left")
    beyond = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("__other", _none())))
    return rows.withColumn("bits", required(F.col("bits"), beyond == 0, "consumed cells lie outside the active land").cast("long")).drop("__other")


def consume(shapes: DataFrame, coverage: DataFrame, consumed: DataFrame, key: str, known_chunks: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, area_m2, unknown): fresh cells of each shape, a cell of several to the smallest key; and whether a chunk of it isn't known.

    Where ``known_chunks`` is given, a shape that meets a chunk that isn't known takes nothing.
    Spark's estimate of a side doesn't know how many words a shape has, so no side by shape is broadcast.
    """
    rows = shapes
    if known_chunks is not None:
        known = known_chunks.select(*by, F.col("cx").cast("int"), F.col("cy").cast("int")).distinct().withColumn("__known", F.lit(True))
        met = rows.select(*by, key, "cx", "cy").distinct().join(known, [*by, "cx", "cy"], "left").groupBy(*by, key).agg(F.bool_or(F.col("__known").isNull()).alias("unknown"))
        rows = rows.join(met.hint("merge"), [*by, key])
    else:
        rows = rows.withColumn("unknown", F.lit(False))
    every = rows.select(*by, key, "unknown").distinct()
    fresh = without(common(rows.where("not unknown").drop("unknown"), coverage, by), consumed, by)
    order = Window.partitionBy(*by, *KEY).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(order), _none())))
    won = fresh.withColumn("bits", first).groupBy(*by, key).agg((F.sum(F.bit_count("bits")) * CELL_AREA).cast("long").alias("area_m2"))
    return every.join(won.hint("merge"), [*by, key], "left").withColumn("area_m2", F.coalesce("area_m2", _none()))


def first_touch(shapes: DataFrame, coverage: DataFrame, seq: str = "seq", by: tuple[str, ...] = (), salts: int = 16) -> DataFrame:
    """(by, seq, cx, cy, w, bits): for each covered cell the first shape that reaches it, as the bits that each shape was first to reach in a word.

    What a shape adds to a word are its bits without those of all shapes before it. First, shapes are dealt to ``salts`` groups, in each of which those go that add nothing to the ones before
    them: at most 64 for each word remain, however many shapes there were. So the second pass, over all that remain, has few rows for any word.
    """

    def fresh(rows: DataFrame, *keys: str) -> DataFrame:
        before = Window.partitionBy(*by, *KEY, *keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("bits").over(before), _none())))).where("bits <> 0")

    dealt = common(shapes, coverage, by).withColumn("__salt", F.pmod(F.xxhash64(seq), F.lit(salts)))
    return fresh(fresh(dealt, "__salt").drop("__salt")).select(*by, seq, *KEY, "bits")


def _lowest(bits: Column) -> Column:
    """The place of the lowest bit that is set."""
    return F.bit_count(bits.bitwiseXOR(bits - 1)) - 1


def _highest(bits: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseOR(F.call_function("shiftrightunsigned", bits, F.lit(k)))
    return F.bit_count(bits) - 1


def awards(touched: DataFrame, seq: str = "seq") -> DataFrame:
    """Area and bounds of the cells that each shape was awarded (``first_touch``)."""
    first, row = F.col("cx") * CHUNK_CELLS + F.col("w") % 4 * 64, F.col("cy") * CHUNK_CELLS + F.floor(F.col("w") / 4)
    metres = lambda c: c * CELL_METRES - ARENA_HALF
    # one less than the smallest number would overflow
    low = F.when(F.col("bits") == SIGN, F.lit(63)).otherwise(_lowest(F.col("bits")))
    return touched.groupBy(seq).agg(
        (F.sum(F.bit_count("bits")) * CELL_AREA).cast("long").alias("area_m2"), metres(F.min(first + low)).alias("min_x"), metres(F.min(row)).alias("min_y"),
        metres(F.max(first + _highest(F.col("bits"))) + 1).alias("max_x"), metres(F.max(row) + 1).alias("max_y"),
    )


def footprint_state(footprints: DataFrame, coverage: DataFrame, consumed: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, state): unknown if a cell isn't covered, else gone, partial or untouched."""
    rows = _with(footprints, coverage, by, "left").withColumnRenamed("__other", "__covered")
    rows = _with(rows, consumed, by, "left").withColumnsRenamed({"__other": "__eaten"})
    outside = lambda c: F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(c, _none()))) != 0
    told = rows.groupBy(*by, key).agg(
        F.bool_or(outside("__covered")).alias("u"), F.bool_or(F.col("bits").bitwiseAND(F.coalesce("__eaten", _none())) != 0).alias("some"), F.bool_or(outside("__eaten")).alias("left")
    )
    return told.select(*by, key, F.when(F.col("u"), "unknown").when(~F.col("left"), "gone").when(F.col("some"), "partial").otherwise("untouched").alias("state"))


def pack(words: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cx, cy, content): chunks of 8192 bytes, lowest bit first."""
    number = F.lpad(F.hex("bits"), 16, "0")
    turned = F.concat(*(F.substring(number, k, 2) for k in range(15, 0, -2)))
    held = words.groupBy(*by, "cx", "cy").agg(F.map_from_entries(F.collect_list(F.struct("w", turned.alias("t")))).alias("held"))  # at most 1024 words
    rows = held.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1))))
    rows = rows.select(*by, "cx", "cy", F.struct("w", F.coalesce(F.try_element_at("held", F.col("w")), F.lit("0" * 16)).alias("t")).alias("part"))
    parts = rows.groupBy(*by, "cx", "cy").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select(*by, "cx", "cy", F.unhex(F.array_join(F.transform("parts", lambda p: p["t"]), "")).alias("content"))


def unpack(chunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Words of packed chunks; fails the job for a chunk of another length or with bits beyond the arena."""
    sound = required(F.col("content"), F.octet_length("content") == CHUNK_BYTES, "a chunk has 8192 bytes")
    rows = chunks.withColumn("h", F.hex(sound)).select(*by, "cx", "cy", "h", F.explode(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1))).alias("w"))
    rows = rows.withColumn("h", F.expr("substring(h, w * 16 + 1, 16)")).where(F.col("h") != "0" * 16)
    half = lambda first: F.conv(F.concat(*(F.substring("h", k, 2) for k in range(first + 6, first - 1, -2))), 16, 10).cast("long")
    told = rows.select(*by, "cx", "cy", "w", F.shiftleft(half(9), 32).bitwiseOR(half(1)).alias("bits"))
    first, row = F.col("cx") * CHUNK_CELLS + F.col("w") % 4 * 64, F.col("cy") * CHUNK_CELLS + F.floor(F.col("w") / 4)
    mask = F.when((row < GRID_CELLS) & (first < GRID_CELLS), range_mask(F.lit(0), F.least(F.lit(63), GRID_CELLS - 1 - first))).otherwise(_none())
    return told.withColumn("bits", required(F.col("bits"), F.col("bits").bitwiseAND(F.bitwise_not(mask)) == 0, "a chunk has bits beyond the arena").cast("long"))
