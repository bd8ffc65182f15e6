"""A store of keyed state: lookups that read one bucket, deletes, and commits that happen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from tesserae.sources.state_store import ConflictError, StateStore

RUNS, MASKS = "sector string, area long", "sector string, key string, bits binary"


@pytest.fixture()
def store(spark, tmp_path):
    return StateStore(spark, str(tmp_path / "store"), {"runs": ("sector",), "masks": ("sector", "key")}, "sector", buckets=8)


def runs(spark, *rows):
    return spark.createDataFrame(rows, RUNS)


def masks(spark, *rows):
    return spark.createDataFrame([(s, k, bytearray([b])) for s, k, b in rows], MASKS)


def state(store):
    m = store.manifest()
    return sorted((r["sector"], r["area"]) for r in store.read("runs", manifest=m).collect()), sorted((r["sector"], r["key"], r["bits"][0]) for r in store.read("masks", manifest=m).collect())


def test_put_load_and_reset_of_one_owner(spark, store):
    assert store.version() == 0
    with pytest.raises(KeyError):
        store.read("runs")
    assert store.put({"runs": runs(spark, ("a", 4), ("b", 8)), "masks": masks(spark, ("a", "0,0", 1), ("a", "1,0", 2), ("b", "5,5", 3))}) == 1
    assert [r["area"] for r in store.read("runs", ["a"]).collect()] == [4]
    assert sorted(r["key"] for r in store.read("masks", ["a"]).collect()) == ["0,0", "1,0"]
    assert store.read("masks", ["zzz"]).count() == 0
    assert store.delete(["a", "none"]) == 2
    assert state(store) == ([("b", 8)], [("b", "5,5", 3)])
    assert sorted(r["sector"] for r in store.read("runs", manifest=store.manifest(1)).collect()) == ["a", "b"]  # as it was


def test_rows_of_equal_keys_are_replaced_and_others_stay(spark, store):
    store.put({"runs": runs(spark, ("a", 4)), "masks": masks(spark, ("a", "0,0", 1), ("a", "1,0", 2))})
    store.put({"runs": runs(spark, ("a", 12)), "masks": masks(spark, ("a", "0,0", 9))})
    assert state(store) == ([("a", 12)], [("a", "0,0", 9), ("a", "1,0", 2)])
    store.put({"runs": runs(spark, ("a", 16)), "masks": masks(spark, ("a", "2,2", 5))}, replace=True)
    assert state(store) == ([("a", 16)], [("a", "2,2", 5)])


def test_a_failed_writer_leaves_the_old_state(spark, store):
    store.put({"runs": runs(spark, ("a", 4)), "masks": masks(spark, ("a", "0,0", 1))})
    before = state(store)
    bad = masks(spark, ("a", "0,0", 7)).withColumn("bits", F.when(F.col("key") == "0,0", F.raise_error(F.lit("disk is full")).cast("binary")).otherwise(F.col("bits")))
    with pytest.raises(Exception, match="disk is full"):
        store.put({"runs": runs(spark, ("a", 8)), "masks": bad})  # the runs are written, but nothing names them
    with pytest.raises(Exception, match="occurs twice"):
        store.put({"runs": runs(spark, ("a", 8)), "masks": masks(spark, ("a", "0,0", 7), ("a", "0,0", 8))})
    assert state(store) == before and store.version() == 1
    assert store.vacuum() >= 2 and state(store) == before


def test_one_of_two_writers_from_one_state_wins(spark, store, monkeypatch):
    store.put({"runs": runs(spark, ("a", 4)), "masks": masks(spark, ("a", "0,0", 1))})
    old, other = store.manifest(), StateStore(spark, store.path, store.tables, "sector", buckets=8)
    other.put({"runs": runs(spark, ("b", 1))})
    monkeypatch.setattr(store, "manifest", lambda version=None: old)
    with pytest.raises(ConflictError):
        store.put({"runs": runs(spark, ("c", 2))})
    monkeypatch.undo()
    assert state(store)[0] == [("a", 4), ("b", 1)]


def test_lookups_read_their_bucket_only_and_commits_touch_theirs_only(spark, store):
    every = [(f"s{k}", k) for k in range(200)]
    store.put({"runs": runs(spark, *every), "masks": masks(spark, *((s, "0,0", 1) for s, _ in every))})
    assert len(store.read("runs", ["s5"]).inputFiles()) == 1 < len(store.read("runs").inputFiles())
    before = store.manifest()["buckets"]["runs"]
    store.put({"runs": runs(spark, ("s5", 99))})
    after = store.manifest()["buckets"]["runs"]
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    asked = spark.createDataFrame([("s5",), ("s7",), ("s7",)], "sector string")
    assert sorted(r["area"] for r in store.read("runs", asked).collect()) == [7, 99]
    store.put({"runs": runs(spark)})  # nothing to put
    assert store.read("runs").count() == 200
    store.vacuum(keep=1)
    assert store.read("runs").count() == 200 and store.read("masks").count() == 200


def test_null_keys_fail(spark, store):
    with pytest.raises(Exception, match="null"):
        store.put({"runs": runs(spark, (None, 1), ("", 2))})
    assert store.version() == 0


def test_replacing_an_owner_takes_its_rows_from_every_table(spark, store):
    store.put({"runs": runs(spark, ("a", 4), ("b", 1)), "masks": masks(spark, ("a", "0,0", 1), ("b", "0,0", 1))})
    store.put({"runs": runs(spark, ("a", 5)), "masks": masks(spark)}, replace=True)
    assert state(store) == ([("a", 5), ("b", 1)], [("b", "0,0", 1)])
