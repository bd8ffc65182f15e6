import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import graph, words


def cells_of(df):
    return {(r["gx"], r["gy"]) for r in words.word_cells(df).collect()}


@pytest.fixture(scope="module")
def sets(spark):
    rng = random.Random(2)
    return [{(rng.randrange(60, 140) if k else rng.randrange(1400, 1500), rng.randrange(250, 260)) for _ in range(300)} for k in (1, 1, 0)]


def frame(spark, cells):
    return words.cell_words(spark.createDataFrame(sorted(cells), "gx long, gy long"))


def test_algebra_of_words_is_that_of_cells(spark, sets):
    a, b, _ = (frame(spark, s) for s in sets)
    assert cells_of(a) == sets[0] and cells_of(words.merged(a.unionByName(b))) == sets[0] | sets[1]
    assert cells_of(words.common(a, b)) == sets[0] & sets[1] and cells_of(words.without(a, b)) == sets[0] - sets[1]
    assert words.area(a).first()[0] == 4 * len(sets[0])


def test_spans_become_words(spark):
    spans = spark.createDataFrame([(3, 0, 1499), (4, 63, 64), (5, 70, 70), (6, 9, 8), (5, 60, 75)], "gy long, lo long, hi long")
    assert cells_of(words.span_words(spans)) == {(x, 3) for x in range(1500)} | {(63, 4), (64, 4)} | {(x, 5) for x in range(60, 76)}


def test_chunks_are_packed_low_bit_first_and_checked(spark, sets):
    packed = words.pack(frame(spark, sets[0] | sets[2]))
    for r in packed.collect():
        want = bytearray(8192)
        for gx, gy in sets[0] | sets[2]:
            if (gx // 256, gy // 256) == (r["cx"], r["cy"]):
                bit = gy % 256 * 256 + gx % 256
                want[bit // 8] |= 1 << bit % 8
        assert bytes(r["content"]) == bytes(want)
    assert cells_of(words.unpack(packed)) == sets[0] | sets[2]
    for content, message in ((b"short", "8192 bytes"), (b"\xff" * 8192, "beyond the arena")):
        with pytest.raises(Exception, match=message):
            words.unpack(spark.createDataFrame([(5, 5, content)], "cx int, cy int, content binary")).collect()


def test_padding_is_masked_on_arrival(spark):
    full = spark.createDataFrame([(5, 0, 3, -1), (5, 5, 879, -1), (5, 5, 880, -1), (0, 0, 0, -1)], "cx int, cy int, w int, bits long")
    got = cells_of(words.within_grid(full))
    assert got == {(x, 0) for x in range(64)} | {(x, 0) for x in range(1472, 1500)} | {(x, 1499) for x in range(1472, 1500)}


def test_regions_and_restored_cells_fail_closed(spark, sets):
    a, b, _ = (frame(spark, s) for s in sets)
    none = a.where("bits = 0")
    assert cells_of(words.install_region(a, b, none)) == sets[0] & sets[1]
    with pytest.raises(Exception, match="can't change"):
        words.install_region(a, b, b).collect()
    assert cells_of(words.restored(words.common(a, b), a)) == sets[0] & sets[1]
    with pytest.raises(Exception, match="outside"):
        words.restored(b, a).collect()


@pytest.mark.parametrize("per_task", [500_000, 40])
def test_components_against_union_find(spark, monkeypatch, per_task):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", per_task)
    rng = random.Random(per_task)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 480)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (999, 999), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = graph.connected_components(df)
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in root} and got.count() == len(root)
    assert graph.connected_components(df.where(F.lit(False))).count() == 0


def test_first_touch_of_a_crowded_word_against_cells(spark):
    from tesserae.operators import cells as C

    rng = random.Random(8)
    rows = [(k, rng.uniform(-60, 60), rng.uniform(-20, 20), rng.choice([3.0, 8.0, 20.0])) for k in range(800)] + [(1000, -1499.0, -1499.0, 9.0), (1001, 1499.0, 1499.0, 9.0)]
    discs = spark.createDataFrame(rows, "seq long, x double, y double, radius double")
    spans = C.disc_spans(discs)
    grid = spark.range(1500).withColumnRenamed("id", "gx").withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1499).cast("long")))).where("(gx + gy) % 3 <> 0")
    got = words.first_touch(words.span_words(spans, ("seq",)), words.cell_words(grid))
    want = C.first_touch(C.span_cells(spans), grid)
    key = lambda df: sorted(map(tuple, df.select("seq", "gx", "gy").collect()))
    assert key(words.word_cells(got, ("seq",))) == key(want)
    assert sorted(map(tuple, words.awards(got).collect())) == sorted(map(tuple, C.awards(want).collect()))
