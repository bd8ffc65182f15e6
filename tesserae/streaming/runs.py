"""Runs as a stateful stream: coverage and moves by sector, each covered cell rewarded once.

State per sector is the run (area, position, last shape) and, for each chunk, the bits of covered and consumed cells.
Replayed or repeated moves find their cells consumed, so rewards happen once; coverage that comes late
makes the present shape count again for the new cells. Only so many chunks of coverage stay resident: a new one takes the place of the one that was used longest ago and that the
present shape doesn't meet. Its cells are unknown from then on, while what was consumed there stays consumed.

``saved_runs`` gives, for each batch, the run and the chunks that changed, however often they did, and ``save_to`` puts them into a store in one commit with the batch's number:
a batch that fails leaves the store as it was and is run again, one that comes again is known and left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesserae.functions.constants import ARENA_HALF, CELL_AREA, CELL_METRES, CHUNK_CELLS, GRID_CELLS, GROWTH, RADIUS_CAP, RADIUS_START
from tesserae.sources.state_store import StateStore

#: Chunks of coverage that stay in a sector's state.
RESIDENT = 36
SAVED = "sector string, seq long, x double, y double, radius double, area long, chunk string, bits binary"
OUTPUT = "sector string, seq long, x double, y double, radius double, gained long, area long"
#: Events: kind 'coverage' brings a chunk's bits; kind 'move' goes by (dx, dy), with an own radius or that of the run.
EVENTS = "sector string, seq long, kind string, chunk string, bits binary, dx double, dy double, radius double"


def radius_of(area: int) -> float:
    return min(RADIUS_CAP, math.sqrt(RADIUS_START**2 + GROWTH * area))


def shape_cells(x: float, y: float, x2: float, y2: float, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose centre lies within r of the segment."""
    low = lambda v: max(0, math.ceil((v - r + ARENA_HALF) / CELL_METRES - 0.5))
    high = lambda v: min(GRID_CELLS - 1, math.floor((v + r + ARENA_HALF) / CELL_METRES - 0.5))
    gx, gy = np.meshgrid(np.arange(low(min(x, x2)), high(max(x, x2)) + 1), np.arange(low(min(y, y2)), high(max(y, y2)) + 1))
    px, py = (gx + 0.5) * CELL_METRES - ARENA_HALF, (gy + 0.5) * CELL_METRES - ARENA_HALF
    dx, dy = x2 - x, y2 - y
    size = dx * dx + dy * dy
    t = np.clip(((px - x) * dx + (py - y) * dy) / size, 0, 1) if size else 0.0
    near = (px - x - t * dx) ** 2 + (py - y - t * dy) ** 2 <= r * r
    return gx[near], gy[near]


class RunProcessor(StatefulProcessor):
    """For each move of a sector, in order of seq within a batch: the new position, what it gained, and the run's area."""

    def __init__(self, resident: int = RESIDENT):
        self.resident = resident

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "area long, x double, y double, seq long, fx double, fy double, radius double")
        self.covered = handle.getMapState("covered", "key string", "bits binary")
        self.consumed = handle.getMapState("consumed", "key string", "bits binary")
        self.used = handle.getMapState("used", "key string", "seq long")
        self.dirty: set[str] = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        area, x, y, last, fx, fy, radius = self.run.get() if self.run.exists() else (0, 0.0, 0.0, -1, 0.0, 0.0, RADIUS_START)
        out = []
        events = pd.concat(list(rows)).sort_values(["seq", "kind"])
        for e in events.itertuples():
            if e.kind == "coverage":
                new = np.frombuffer(e.bits, np.uint8)
                if self.covered.containsKey((e.chunk,)):
                    new = new | np.frombuffer(self.covered.getValue((e.chunk,))[0], np.uint8)
                self.covered.updateValue((e.chunk,), (new.tobytes(),))
                self.used.updateValue((e.chunk,), (max(int(e.seq), int(last)),))
                self._make_room(e.chunk, fx, fy, x, y, radius)
                gained = self._consume(fx, fy, x, y, radius) if last >= 0 else 0
                if not gained:
                    continue
            elif e.seq <= last:
                continue  # replayed
            else:
                fx, fy, last = x, y, e.seq
                radius = float(e.radius) if not pd.isna(e.radius) else radius_of(area)
                half = ARENA_HALF + min(RADIUS_CAP, radius)
                x, y = min(half, max(-half, x + e.dx)), min(half, max(-half, y + e.dy))
                gained = self._consume(fx, fy, x, y, radius, last)
            area += gained
            out.append((key[0], e.seq, x, y, radius, gained, area))
        self.run.update((int(area), float(x), float(y), int(last), float(fx), float(fy), float(radius)))
        if out:
            yield pd.DataFrame(out, columns=["sector", "seq", "x", "y", "radius", "gained", "area"])

    def _make_room(self, new: str, *shape: float) -> None:
        """Give up chunks beyond the number that may stay."""
        held = {k[0]: v[0] for k, v in self.used.iterator()}
        while len(held) > self.resident:
            gx, gy = shape_cells(*shape)
            met = {f"{cx},{cy}" for cx, cy in zip((gx // CHUNK_CELLS).tolist(), (gy // CHUNK_CELLS).tolist(), strict=True)} | {new}
            gone = min(held.keys() - met or held.keys() - {new}, key=lambda k: (held[k], k))
            del held[gone]
            self.covered.removeKey((gone,))
            self.used.removeKey((gone,))

    def _consume(self, x: float, y: float, x2: float, y2: float, r: float, seq: int | None = None) -> int:
        """Area of cells within the shape that are covered and weren't consumed; chunks without coverage stay unknown."""
        gx, gy = shape_cells(x, y, x2, y2, r)
        chunk = (gy // CHUNK_CELLS) * 8 + gx // CHUNK_CELLS
        fresh = 0
        for c in np.unique(chunk):
            name = (f"{c % 8},{c // 8}",)
            if not self.covered.containsKey(name):
                continue
            if seq is not None:
                self.used.updateValue(name, (int(seq),))
            own = chunk == c
            mask = np.zeros(CHUNK_CELLS * CHUNK_CELLS, bool)
            mask[gy[own] % CHUNK_CELLS * CHUNK_CELLS + gx[own] % CHUNK_CELLS] = True
            eaten = np.frombuffer(self.consumed.getValue(name)[0], np.uint8) if self.consumed.containsKey(name) else np.zeros(8192, np.uint8)
            new = np.packbits(mask, bitorder="little") & np.frombuffer(self.covered.getValue(name)[0], np.uint8) & ~eaten
            if new.any():
                fresh += int(np.bitwise_count(new).sum())
                self.consumed.updateValue(name, ((eaten | new).tobytes(),))
                self.dirty.add(name[0])
        return fresh * CELL_AREA

    def close(self) -> None:
        pass


class SavingProcessor(RunProcessor):
    """What a batch has changed: the run without a chunk, and each changed chunk once."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.dirty = set()
        for _ in super().handleInputRows(key, rows, timerValues):
            pass
        area, x, y, last, _, _, radius = self.run.get()
        out = [(key[0], last, x, y, radius, area, None, None)]
        out += [(key[0], last, None, None, None, None, k, bytes(self.consumed.getValue((k,))[0])) for k in sorted(self.dirty)]
        yield pd.DataFrame(out, columns=["sector", "seq", "x", "y", "radius", "area", "chunk", "bits"])


def run_stream(events: DataFrame, resident: int = RESIDENT) -> DataFrame:
    """Positions, gains and areas of runs from a stream of events; needs the RocksDB state store."""
    return events.groupBy("sector").transformWithStateInPandas(RunProcessor(resident), OUTPUT, "Update", "None")


def saved_runs(events: DataFrame, resident: int = RESIDENT) -> DataFrame:
    """Each batch's runs and changed chunks, for ``save_to``."""
    return events.groupBy("sector").transformWithStateInPandas(SavingProcessor(resident), SAVED, "Update", "None")


#: Tables and keys of a store of runs; its owner is the sector.
TABLES = {"runs": ("sector",), "masks": ("sector", "chunk"), "batches": ("sector",)}


def save_to(path: str, stream: str = "runs"):
    """A foreachBatch function that puts a batch of ``saved_runs`` into the store at a path, whole and once."""

    def save(batch: DataFrame, number: int) -> None:
        store = StateStore(batch.sparkSession, path, TABLES, "sector")
        mark = batch.sparkSession.createDataFrame([(f"stream {stream}", number)], "sector string, batch long")
        if "batches" in store.manifest()["schemas"] and store.read("batches", [f"stream {stream}"]).where(F.col("batch") >= number).count():
            return  # it was committed before the stream noted so
        batch = batch.persist()
        try:
            runs = batch.where("chunk IS NULL").drop("chunk", "bits")
            store.put({"runs": runs, "masks": batch.where("chunk IS NOT NULL").select("sector", "chunk", "seq", "bits"), "batches": mark})
        finally:
            batch.unpersist()

    return save


def latest_runs(updates: DataFrame, path: str):
    """A foreachBatch sink: the last row of each sector of a batch goes to a folder of its own by batch, written whole or not at all."""

    def save(batch: DataFrame, number: int) -> None:
        from tesserae.operators.features import latest

        latest(batch, ["sector"], "seq", F.col("area")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(save)
