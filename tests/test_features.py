import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import frames, runs, shapes, tags
from tesserae.operators import features, graph, grids


def test_osm_json_fails_closed(spark, tmp_path):
    good = {"version": 0.6, "elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"a": "b"}}, {"type": "way", "id": 2, "nodes": [1, 1], "version": 3}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    rows = features.read_osm_json(spark, str(tmp_path / "good.json")).orderBy("id").collect()
    assert [r["type"] for r in rows] == ["node", "way"] and rows[1]["nodes"] == [1, 1]
    for bad in ({**good, "remark": "timed out"}, {"version": 1}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="partial|no elements"):
            features.read_osm_json(spark, str(tmp_path / "bad.json")).collect()


def test_half_up_and_wrapping(spark):
    df = spark.createDataFrame([(-2.5, 190.0), (2.5, -180.0)], "v double, lon double")
    assert [tuple(r) for r in df.select(frames.half_up(F.col("v")), frames.wrap_degrees(F.col("lon"))).collect()] == [(-2, -170.0), (3, -180.0)]


@pytest.mark.parametrize(("lat", "tiles"), [(60.0, 16), (84.9, 361)])
def test_water_tile_plan_counts(spark, lat, tiles):
    row = grids.water_tiles(spark.createDataFrame([(1, 30.0, lat)], "id int, lon double, lat double")).first()
    assert row["tile_count"] == tiles


def test_cells_own_their_west_and_south_edges(spark):
    df = spark.createDataFrame([(10.0, 50.0), (11.0, 50.0), (10.5, 51.0), (10.5, 50.5), (370.0, 50.2)], "lon double, lat double")
    inside = frames.cell_contains(F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(50.0), F.lit(11.0), F.lit(51.0))
    assert [r[0] for r in df.select(inside).collect()] == [True, False, False, True, True]


def test_viewports_across_the_date_line(spark):
    df = spark.createDataFrame([(179.9, 10.0, -179.9, 10.1, 1)], "west double, south double, east double, north double, id int")
    cells = grids.visible_cells(df, "id").collect()
    assert {r["col"] == 0 for r in cells} == {True, False} and all(r["total"] == len(cells) for r in cells)
    dense = spark.createDataFrame([(-180.0, -80.0, 180.0, 80.0, 1)], "west double, south double, east double, north double, id int")
    rows = grids.visible_cells(dense, "id").collect()
    assert len(rows) == 1 and rows[0]["row"] is None and rows[0]["total"] > 400


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7000, 7000), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(51)) and all(got[1000 + k] == 1000 for k in range(40)) and got[7000] == 7000 and len(got) == 92
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_insert_once_rejects_conflicts(spark):
    old = spark.createDataFrame([("a", "1")], "id string, digest string")
    assert features.insert_once(old, spark.createDataFrame([("a", "1"), ("b", "2")], "id string, digest string"), "id", "digest").collect()[0]["id"] == "b"
    with pytest.raises(Exception, match="conflicting"):
        features.insert_once(old, spark.createDataFrame([("a", "9")], "id string, digest string"), "id", "digest").collect()


def test_chunks_are_pruned_and_versioned(spark, tmp_path):
    rows = spark.createDataFrame([("0-0", "v1", 1), ("0-1", "v1", 2), ("0-2", "v2", 3)], "chunk_id string, version string, id int")
    features.write_chunks(rows, str(tmp_path / "c"))
    assert [r["id"] for r in features.read_chunks(spark, str(tmp_path / "c"), ["0-1"], "v1").collect()] == [2]
    with pytest.raises(Exception, match="another version"):
        features.read_chunks(spark, str(tmp_path / "c"), ["0-2"], "v1").collect()


def test_names_are_found_without_accents(spark):
    places = spark.createDataFrame([(1, "Orléans", 5), (2, "New Orleans", 9), (3, "orleans", 1)], "id int, full string, population int")
    places = places.select("id", "population", features.folded("full").alias("name")).withColumn("search_text", F.col("name"))
    assert [r["id"] for r in features.name_search(places, " ORLÉANS ").collect()] == [1, 3, 2]


def test_geonames(spark, tmp_path):
    line = lambda i, name, alt, lat, kind: "\t".join([str(i), name, name, alt, str(lat), "30", kind, "PPL", "XX", "", "", "", "", "", "500", "", "", "", ""])
    (tmp_path / "g.tsv").write_text("\n".join([line(1, "A", "B,C,A,D,E,B", 50, "P"), line(2, "M", "", 50, "T"), line(3, "N", "", 89, "P")]))
    rows = features.geonames(spark, str(tmp_path / "g.tsv")).collect()
    assert [(r["id"], r["other_names"]) for r in rows] == [(1, ["B", "C", "D"])]


def test_milestones_goals_and_unknown_water(spark):
    df = spark.createDataFrame([(9_999_999, 40), (10_000_000, 4_000_000)], "area long, total long")
    got = df.select(runs.milestone_count(F.col("area")), runs.auto_goal(F.col("total"))).collect()
    assert [tuple(r) for r in got] == [(7, 40), (8, 100_000)]
    with pytest.raises(Exception, match="unknown water class"):
        spark.createDataFrame([("lava", None)], "k string, c string").select(tags.is_water(F.col("k"), F.col("c"))).collect()


def test_circumcircle_and_holes(spark):
    pts = "named_struct('x', {0}D, 'y', {1}D)"
    df = spark.range(1).select(*[F.expr(pts.format(x, y)).alias(n) for n, x, y in (("a", 0.0, 0.0), ("b", 4.0, 0.0), ("c", 0.0, 4.0), ("d", 8.0, 0.0))])
    r = df.select(shapes.circumcircle(F.col("a"), F.col("b"), F.col("c")).alias("k"), shapes.circumcircle(F.col("a"), F.col("b"), F.col("d")).alias("n")).first()
    assert (r["k"]["x"], r["k"]["y"]) == (2.0, 2.0) and r["n"] is None


def test_fingerprints_unit_by_unit(spark):
    from tesserae.functions.checks import LANES, fingerprint

    def lanes(texts):
        state = [first for first, _ in LANES]
        for text in texts:
            raw = text.encode("utf-16-be")
            for unit in [*(int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw), 2)), 0]:
                state = [(s ^ unit) * factor % 2**32 for s, (_, factor) in zip(state, LANES, strict=True)]
        return "".join(f"{s:08x}" for s in state)

    cases = [[], [""], ["a"], ["a", ""], ["", "a"], ["ab", "c"], ["a", "bc"], ["Ünï 日本", "😀 x"], ["long " * 500], ["b", "a"]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "id int, v array<string>").select("id", fingerprint(F.col("v")).alias("f"))
    got = {r["id"]: r["f"] for r in df.collect()}
    assert got == {k: lanes(c) for k, c in enumerate(cases)} and len(set(got.values())) == len(cases)


def test_raw_extracts_with_provenance(spark, tmp_path):
    import hashlib

    from tesserae.sources import extracts

    good = json.dumps({"generator": "g", "osm3s": {"timestamp_osm_base": "2024-01-01T00:00:00Z"}, "elements": [{"type": "way", "id": 1}, {"type": "node", "id": 2}]}).encode()
    (tmp_path / "a.json").write_bytes(good)
    (row,) = extracts.read_extracts(spark, str(tmp_path / "a.json")).collect()
    assert row["raw_sha256"] == hashlib.sha256(good).hexdigest() and row["elements"] == 2 and row["osm_timestamp"].startswith("2024") and row["bytes"] == len(good)
    for n, bad in enumerate((json.dumps({"remark": "timed out", "elements": [{"type": "way", "id": 1}]}), json.dumps({"elements": []}), "<html>")):
        (tmp_path / f"bad{n}.json").write_text(bad)
        with pytest.raises(Exception, match="extract"):
            extracts.read_extracts(spark, str(tmp_path / f"bad{n}.json")).collect()


def test_sector_queries_split_at_the_date_line(spark):
    from tesserae.sources import extracts

    df = spark.createDataFrame([(1, 10.0, 50.0), (2, 179.99, 0.0)], "id int, lon double, lat double")
    got = {r["id"]: r["q"] for r in df.select("id", extracts.sector_query(F.col("lon"), F.col("lat"), F.col("lat"), False).alias("q")).collect()}
    assert got[1].count("building") == 2 and got[2].count("wr[") == 2 and ",180.0000000);" in got[2] and ",-180.0000000," in got[2]
