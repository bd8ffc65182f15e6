"""Coverage from sets of tiles: what is complete, what is made anew, and which cells."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import cells, coverage, words
from tesserae.sources.tiles import encode_tile, tile_fragments

# around longitude 0 and latitude 0 tiles are 2446 m wide, so an arena meets four of them
SECTORS = "sector long, lon double, lat double, basis double"
TILES = "x long, y long, revision int, content binary"
FOUR = [(8191, 8191), (8191, 8192), (8192, 8191), (8192, 8192)]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def sector(spark):
    return spark.createDataFrame([(1, 0.0, 0.0, 0.0)], SECTORS)


def tiles(spark, *rows):
    return spark.createDataFrame([(x, y, r, bytearray(encode_tile("building", [({}, rings) for rings in f]) if isinstance(f, list) else f)) for x, y, r, f in rows], TILES)


def area(held):
    return held.agg(F.sum(F.bit_count("bits"))).first()[0] or 0


def chunks(told, only_changed=False):
    return {(r["cx"], r["cy"]) for r in told.collect() if r["changed"] or not only_changed}


def test_a_missing_tile_leaves_its_chunks_unknown(spark):
    full = tiles(spark, *((x, y, 1, []) for x, y in FOUR))
    made, told = coverage.refresh(sector(spark), full)
    assert told.count() == 36 and made.count() == 0  # empty tiles are known to be empty
    _, told = coverage.refresh(sector(spark), full.where("x = 8192 OR y = 8192"))
    assert chunks(told) == {(x, y) for x in range(6) for y in range(6) if x > 2 or y < 2}


def test_only_changed_sets_are_made_anew_and_others_arent_read(spark):
    a = tiles(spark, *((x, y, 1, [[box(500, 500, 700, 700)]]) for x, y in FOUR))
    made, told = coverage.refresh(sector(spark), a)
    held = made.cache(), told.cache()
    before = area(made)
    # a second revision of one tile; the others' contents are no tiles any more, so reading them would fail
    b = tiles(spark, (8192, 8192, 2, [[box(500, 500, 700, 700)], [box(1000, 1000, 1100, 1100)]]), *((x, y, 1, b"\xff\xff") for x, y in FOUR))
    stale = coverage.refresh(sector(spark), b, held)[1]
    assert chunks(stale, True) == {(x, y) for x in range(2, 6) for y in range(3)}
    readable = b.where("x = 8192 AND y = 8192").unionByName(a.where("x <> 8192 OR y <> 8192")).unionByName(tiles(spark, (8191, 8191, 0, b"\xff")))
    made, told = coverage.refresh(sector(spark), readable, held)
    assert area(made) > before and chunks(told, True) == chunks(stale, True)
    whole, _ = coverage.refresh(sector(spark), readable)
    key = lambda df: sorted(tuple(r) for r in df.select("sector", "cx", "cy", "w", "bits").collect())
    assert key(made) == key(whole)
    # nothing changed: nothing is decoded, whatever the contents
    again, told = coverage.refresh(sector(spark), b, (whole, told.drop("changed")))
    assert not chunks(told, True) and key(again) == key(whole)


def test_a_tile_that_went_drops_its_chunks(spark):
    a = tiles(spark, *((x, y, 1, [[box(500, 500, 700, 700)]]) for x, y in FOUR))
    held = coverage.refresh(sector(spark), a)
    made, told = coverage.refresh(sector(spark), a.where("NOT (x = 8191 AND y = 8192)"), held)
    assert not chunks(told, True) and (0, 0) not in chunks(told)
    assert {(r["cx"], r["cy"]) for r in made.select("cx", "cy").distinct().collect()} <= chunks(told)


def test_malformed_tiles_are_never_empty_coverage(spark):
    bad = tiles(spark, *((x, y, 1, b"<html>blocked</html>") for x, y in FOUR))
    with pytest.raises(Exception, match="wire type|beyond|index"):
        coverage.refresh(sector(spark), bad)[0].collect()


def test_only_desired_chunks_are_made(spark):
    a = tiles(spark, *((x, y, 1, [[box(100, 100, 3900, 3900)]]) for x, y in FOUR))
    requests = spark.createDataFrame([(1, 1, -1400.0, -1400.0, 20.0, 0.0, 0.0), (1, 7, 1400.0, 1400.0, 20.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 20.0, 0.0, 0.0)], "sector long, seq long, x double, y double, radius double, dx double, dy double")
    wanted = coverage.desired_chunks(requests)
    assert [(r["cx"], r["cy"]) for r in wanted.orderBy("ordinal").collect()][0] == (5, 5)
    made, told = coverage.refresh(sector(spark), a, desired=wanted)
    assert chunks(told) == {(r["cx"], r["cy"]) for r in wanted.collect()} == {(5, 5)}
    assert {(r["cx"], r["cy"]) for r in made.select("cx", "cy").distinct().collect()} == {(5, 5)}


def test_seam_courtyards_and_repeats_count_once(spark):
    rings = [box(-16, 20, 16, 120), box(-8, 40, 8, 100)[::-1]]
    left = [[(x + 4096, y) for x, y in r] for r in rings]
    t = tiles(spark, (8191, 8192, 1, [left, left]), (8192, 8192, 1, [rings, rings]), (8191, 8191, 1, []), (8192, 8191, 1, []))
    made, _ = coverage.refresh(sector(spark), t)
    got = {(r["gx"], r["gy"]) for r in words.word_cells(made).collect()}
    metre = 2446 / 4096
    whole = spark.createDataFrame([(1, [[[{"x": x * metre, "y": -y * metre} for x, y in r] for r in rings]])], "id long, polygons array<array<array<struct<x:double,y:double>>>>")
    want = {(r["gx"], r["gy"]) for r in cells.polygon_cells(whole, "id").collect()}
    assert len(got) > 100 and len(got ^ want) <= 0.1 * len(want)


def test_polygon_words_take_each_polygons_holes_off_first(spark):
    ring = lambda *b: [{"x": float(x), "y": float(y)} for x, y in box(*b)]
    shapes = spark.createDataFrame([(1, [[ring(0, 0, 100, 100), ring(20, 20, 80, 80)], [ring(40, 40, 60, 60)]]), (2, [[ring(-1500, -1500, 1500, 1500)]])], "id long, polygons array<array<array<struct<x:double,y:double>>>>")
    count = {r["id"]: r["n"] for r in words.polygon_words(shapes, ("id",)).groupBy("id").agg(F.sum(F.bit_count("bits")).alias("n")).collect()}
    assert count == {1: 2500 - 900 + 100, 2: 1500 * 1500}
    sums = words.polygon_words(shapes, ("id",)).groupBy("id").agg(F.sum(words.index_sum(3, 1)).alias("s"))
    cell_sums = cells.polygon_cells(shapes, "id").groupBy("id").agg(F.sum(F.col("gx") * 3 + F.col("gy")).alias("s"))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, cell_sums.collect()))


def test_tiles_keep_their_properties_and_holes(spark):
    raw = encode_tile("building", [({"render_height": 12.5, "colour": "red"}, [box(0, 0, 4096, 4096), box(1000, 1000, 2000, 2000)[::-1]]), ({}, [box(-50, -50, -10, -10)])])
    t = spark.createDataFrame([(14, 8192, 8192, bytearray(raw), 0.0, 0.0)], "z int, x int, y int, content binary, lon double, lat double")
    for df in (tile_fragments(t, "building", 0.0, 0.0), tile_fragments(t, "building", "lon", "lat", keep=("lon",))):
        (row,) = df.collect()
        assert row["properties"] == {"render_height": "12.5", "colour": "red"} and len(row["polygons"][0]) == 2


def test_equal_shapes_of_a_tile_are_decoded_into_one_row(spark):
    box, other = [(10, 10), (900, 10), (900, 700), (10, 700)], [(10, 10), (900, 10), (900, 701), (10, 701)]
    content = encode_tile("building", [({"height": k}, [box if k % 3 else other]) for k in range(30)])
    rows = spark.createDataFrame([(14, 3, 4, bytearray(content)), (14, 3, 5, bytearray(content))], "z int, x int, y int, content binary")
    every, once = (tile_fragments(rows, "building", -179.0, 84.0, distinct=d) for d in (False, True))
    assert every.count() == 60 and sorted((r["y"], r["nth"], r["properties"]["height"]) for r in once.collect()) == [(4, 0, "0.0"), (4, 1, "1.0"), (5, 0, "0.0"), (5, 1, "1.0")]
    shapes = lambda df: {str(r) for r in df.select("y", "polygons").collect()}
    assert shapes(every) == shapes(once)


def test_packed_tiles_are_dealt_to_as_many_tasks_as_spark_has(spark):
    sectors = spark.createDataFrame([(k, 0.05 * k, 10.0, 10.0) for k in range(40)], "sector long, lon double, lat double, basis double")
    there = coverage.contributors(sectors).select("x", "y").distinct().withColumns({"revision": F.lit(1), "content": F.lit(encode_tile("building", [({}, [[(0, 0), (4096, 0), (4096, 4096), (0, 4096)]])]))})
    seen, real = [], coverage.tile_fragments
    coverage.tile_fragments = lambda read, *a, **k: seen.append(read.rdd.getNumPartitions()) or real(read, *a, **k)
    try:
        coverage.refresh(sectors, there)
    finally:
        coverage.tile_fragments = real
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
