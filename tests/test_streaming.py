import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators import cells
from tesserae.streaming import runs


def test_stream_equals_batch_for_fixed_radii_and_rewards_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    full = bytes([255]) * 8192
    moves = [("s", k, "move", None, None, float(dx), float(dy), 12.0) for k, (dx, dy) in enumerate(rng.integers(-30, 30, (20, 2)), 1)]
    coverage = [("s", 0, "coverage", f"{x},{y}", full, None, None, None) for x in range(6) for y in range(6) if (x, y) != (2, 2)]
    late = [("s", 100, "coverage", "2,2", full, None, None, None)]
    schema = runs.EVENTS
    for n, part in enumerate((coverage + moves[:10], moves[5:], late)):  # five moves come twice
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    (tmp_path / "in").mkdir()
    for n in range(3):
        for p in (tmp_path / f"in{n}").glob("part-*"):
            p.rename(tmp_path / "in" / f"{n}.parquet")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = runs.run_stream(events).writeStream.format("memory").queryName("runs").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("runs").toPandas().sort_values("seq")
    assert got["seq"].is_unique and len(got) >= 20

    x = y = 0.0
    sweeps = []
    for _, k, *_, dx, dy, r in moves:
        sweeps.append((k, x, y, x + dx, y + dy, r))
        x, y = x + dx, y + dy
    shapes = spark.createDataFrame(sweeps, "seq long, x double, y double, x2 double, y2 double, radius double")
    covered = spark.range(1500).withColumnRenamed("id", "gx").withColumn("gy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1499).cast("long"))))
    early = covered.where("not (gx div 256 = 2 and gy div 256 = 2)")
    want = cells.first_touch(cells.span_cells(cells.capsule_spans(shapes)), early).groupBy("seq").agg((F.count("*") * 4).alias("gained")).toPandas()
    merged = got[got.seq < 100].merge(want, on="seq", how="left", suffixes=("", "_want")).fillna({"gained_want": 0})
    assert (merged["gained"] == merged["gained_want"]).all()
    assert isinstance(got, pd.DataFrame) and (got["area"].diff().dropna() >= 0).all()


FULL = bytes([255]) * 8192


def stream_of(spark, folder, schema, parts):
    """A stream that brings one part after the other."""
    folder.mkdir()
    add(spark, folder, schema, parts)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def add(spark, folder, schema, parts):
    for part in parts:
        n = len(list(folder.glob("*.parquet")))
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder.parent / f"{folder.name}-{n}"))
        (file,) = (folder.parent / f"{folder.name}-{n}").glob("part-*")
        file.rename(folder / f"{n:03}.parquet")


def cover(seq, *chunks):
    return [("s", seq, "coverage", c, FULL, None, None, None) for c in chunks]


def move(seq, dx, dy, r=10.0):
    return ("s", seq, "move", None, None, float(dx), float(dy), r)


def gains(spark, tmp_path, name, parts, resident):
    events = stream_of(spark, tmp_path / name, runs.EVENTS, parts)
    query = runs.run_stream(events, resident).writeStream.format("memory").queryName(name).outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    return {r["seq"]: r["gained"] for r in spark.table(name).collect()}


def test_evicted_chunks_are_unknown_and_what_was_consumed_stays(spark, tmp_path):
    # chunk 2,2 is at the origin, 3,2 from 36 m to the east; three chunks may stay
    parts = [cover(0, "2,2", "3,2", "0,0"), [move(1, 0, 0)], cover(2, "5,5"), [move(3, 300, 0)], cover(4, "1,1", "4,4"), [move(5, -300, 0), move(6, 60, 200)], cover(7, "2,2"), [move(8, -60, -200)]]
    bounded, whole = gains(spark, tmp_path, "bounded", parts, 3), gains(spark, tmp_path, "whole", parts, 36)
    assert bounded[1] == whole[1] > 0 and bounded[3] == whole[3] > 0
    # of 2,2 and 3,2, which the present shape met, 2,2 had to go for 4,4, after 0,0 and 5,5 and so on; what is resident gains the same
    assert bounded[6] <= whole[6] and bounded[5] == whole[5] == 0
    assert sum(bounded.values()) <= sum(whole.values())
    # brought back, a chunk pays for what wasn't consumed before, and for nothing else
    again = gains(spark, tmp_path, "again", [*parts, cover(9, "2,2", "3,2"), [move(10, 0, 0), move(11, 240, 0), move(12, -240, 0)]], 3)
    assert again[10] == 0 and again[12] == 0


def test_runs_are_saved_whole_and_once(spark, tmp_path):
    from tesserae.sources.state_store import StateStore

    path = str(tmp_path / "store")
    parts = [cover(0, "2,2", "3,2"), [move(1, 5, 5), move(2, 20, 0), move(3, 100, 0)], [move(4, -50, 30)]]
    events = stream_of(spark, tmp_path / "in", runs.EVENTS, parts)
    save, calls = runs.save_to(path), []

    def twice_and_failing(batch, number):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            bad = batch.withColumn("bits", F.when(F.col("chunk").isNotNull(), F.raise_error(F.lit("disk is full")).cast("binary")))
            save(bad, number)
        save(batch, number)
        save(batch, number)  # as when the stream died before it noted the batch

    def run():
        q = runs.saved_runs(events).writeStream.option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").foreachBatch(twice_and_failing).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="disk is full"):
        run()
    store = StateStore(spark, path, runs.TABLES, "sector")
    assert [r["area"] for r in store.read("runs", ["s"]).collect()] == [0] and "masks" not in {t for t in store.manifest()["buckets"] if store.manifest()["buckets"][t]}
    run()  # the killed batch is run again, from the state before it
    store = StateStore(spark, path, runs.TABLES, "sector")
    (saved,) = store.read("runs", ["s"]).collect()
    masks = store.read("masks", ["s"]).collect()
    assert saved["area"] == 4 * sum(int(np.bitwise_count(np.frombuffer(m["bits"], np.uint8)).sum()) for m in masks) > 0 and saved["seq"] == 4
    assert {m["chunk"] for m in masks} <= {"2,2", "3,2"} and store.version() == 3 and store.read("batches", ["stream runs"]).first()["batch"] == 2
    want = gains(spark, tmp_path, "plain", parts, 36)
    assert saved["area"] == sum(want.values())


def test_rewards_are_reserved_once_and_paid_once_after_the_delay(spark, tmp_path):
    from tesserae.streaming import absorption as A

    reserve = lambda seq, name, area=4, need=10.0, generation=1, sector="s": (sector, seq, "reserve", name, area, need, generation)
    start = [("s", 0, "radius", None, None, 20.0, None), ("s", 1, "generation", None, None, None, 1), ("t", 0, "radius", None, None, 20.0, None)]
    parts = [start, [reserve(2, "a"), reserve(3, "a"), reserve(4, "b", 8), reserve(5, "wide", need=21.0), reserve(6, "stale", generation=0)], [reserve(2, "a"), reserve(4, "b", 8)]]
    parts += [[reserve(10 + k, f"c{k}", 1, sector="t", generation=0) for k in range(9)]]
    folder = tmp_path / "in"
    events = stream_of(spark, folder, A.EVENTS, parts)
    query = A.rewards(events, delay_ms=1500, most=5).writeStream.format("memory").queryName("paid").outputMode("update").start()

    def wait(ready):
        for _ in range(120):
            rows = [tuple(r) for r in spark.table("paid").select("sector", "id", "area", "total").collect()]
            if ready(rows):
                return rows
            time.sleep(0.5)
        raise AssertionError(rows)

    try:
        rows = wait(lambda rows: len(rows) >= 7)  # batches without data go on for as long as there may be timers
        assert sorted(r[1] for r in rows if r[0] == "s") == ["a", "b"] and max(r[3] for r in rows if r[0] == "s") == 12
        assert sum(r[0] == "t" for r in rows) == 5  # no more than may be pending
        # paid ones never again; those that didn't fit in before may come again; a smaller radius or a new generation gives a reservation up
        add(spark, folder, A.EVENTS, [[reserve(2, "a"), reserve(20, "d"), reserve(21, "shrunk", need=19.0)], [("s", 22, "radius", None, None, 15.0, None)], [reserve(30 + k, f"c{k}", 1, sector="t", generation=0) for k in range(9)]])
        rows = wait(lambda rows: len(rows) >= 12)
        assert sorted(r[1] for r in rows if r[0] == "s") == ["a", "b", "d"] and sorted(r[1] for r in rows if r[0] == "t") == sorted(f"c{k}" for k in range(9))
        add(spark, folder, A.EVENTS, [[reserve(40, "old")], [("s", 41, "generation", None, None, None, 2)], [reserve(42, "old"), reserve(43, "new", generation=2)]])
        rows = wait(lambda rows: any(r[1] == "new" for r in rows))
        time.sleep(2)
        assert sorted(r[1] for r in wait(bool) if r[0] == "s") == ["a", "b", "d", "new"]
    finally:
        query.stop()
