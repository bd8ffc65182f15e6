"""Delayed rewards for whole buildings: reserved once, paid once after a delay, and only if what they rest on still holds.

State per sector is the generation (of the catalogue that candidates come from), the radius, the reservations with the time when they fall due, and the buildings that have been
paid for. A reservation is made for a building that is neither reserved nor paid, while there are fewer than ``PENDING`` of them; one that was computed for another generation than
the present one is discarded. When its timer expires, a reservation is paid if the building still fits the radius, else it is given up without a trace. A new
generation gives up all reservations of the old one. Replayed events find the building reserved or paid, so they change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY_MS = 420
PENDING = 128
#: Events: 'generation' and 'radius' set these; 'reserve' asks for a building that needs a radius and is worth an area, found for a generation.
EVENTS = "sector string, seq long, kind string, id string, area long, need double, generation long"
OUTPUT = "sector string, id string, area long, total long, paid_at long"


class AbsorptionProcessor(StatefulProcessor):
    def __init__(self, delay_ms: int = DELAY_MS, most: int = PENDING):
        self.delay_ms, self.most = delay_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "generation long, radius double, total long")
        self.pending = handle.getMapState("pending", "id string", "area long, need double, due long")
        self.paid = handle.getMapState("paid", "id string", "area long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, radius, total = self.run.get() if self.run.exists() else (0, 0.0, 0)
        now = timerValues.getCurrentProcessingTimeInMs()
        held = {k[0] for k in self.pending.keys()}
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            if e.kind == "generation":
                if e.generation > generation:
                    generation = int(e.generation)
                    for name in held:
                        self.pending.removeKey((name,))
                    held = set()
            elif e.kind == "radius":
                radius = float(e.need)
            elif e.generation == generation and e.need <= radius and e.id not in held and len(held) < self.most and not self.paid.containsKey((e.id,)):
                due = now + self.delay_ms
                self.pending.updateValue((e.id,), (int(e.area), float(e.need), due))
                self.handle.registerTimer(due)
                held.add(e.id)
        self.run.update((generation, radius, total))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, radius, total = self.run.get()
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (name,), (area, need, due) in sorted(self.pending.iterator()):  # at most so many as may be pending
            if due > now:
                continue
            self.pending.removeKey((name,))
            if need <= radius:
                total += area
                self.paid.updateValue((name,), (area,))
                out.append((key[0], name, area, total, due))
        self.run.update((generation, radius, total))
        if out:
            yield pd.DataFrame(out, columns=["sector", "id", "area", "total", "paid_at"])

    def close(self) -> None:
        pass


def rewards(events: DataFrame, delay_ms: int = DELAY_MS, most: int = PENDING) -> DataFrame:
    """Payments of a stream of events, each building of a sector once; needs the RocksDB state store."""
    return events.groupBy("sector").transformWithStateInPandas(AbsorptionProcessor(delay_ms, most), OUTPUT, "Update", "processingTime")
