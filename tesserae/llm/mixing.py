"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equally many documents. The target of a source is its share of the slots by weight among the
sources that still have blocks; when one runs out, the others' shares grow. With t(v) as the slots used when every source has had v blocks for
each unit of its weight, or all it has, block k (from 0) of a source of weight m gets the release time floor(t(k / m)) and the deadline
ceil(t((k + 1) / m)). In every slot, of the released blocks the one with the
earliest deadline is next (ties: by source). Then each source's count of blocks is at every time less than
one block from its target, for any number of sources and blocks, as times are exact whole-number arithmetic on the weights.

The schedule is one stream of slots, made by one task that holds one block of each source and writes (source, block, slot) as it
goes, about a million blocks in a few seconds. Documents join it by source and block.

Defined results: a null source is the source of the empty name; null texts are
documents like others; rows that repeat an id are each scheduled; an empty table gives an
empty result; other columns play no part, whatever their names, and ``in_mixed_order`` returns them as they are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, stage

ROWS_PER_BUCKET = 4096
SLOTS_AT_ONCE = 50_000


class Targets:
    """When each source is due how many blocks: exact, from whole weights and numbers of blocks. Asked for blocks in ascending order."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, int]):
        self.weights = weights
        order = sorted((Fraction(n, weights[s]), s) for s, n in blocks.items())
        self.phase = dict.fromkeys(blocks, 0)
        # until all sources have had ends[k] blocks for each unit of weight, slots are done[k] + left[k] * that number
        self.ends, self.done, self.left = [], [0], [sum(weights.values())]
        for end, s in order:
            self.ends.append((end.numerator, end.denominator))
            self.done.append(self.done[-1] + blocks[s])
            self.left.append(self.left[-1] - weights[s])

    def time(self, source: str, block: int) -> tuple[int, int]:
        """Slots used when this source is due ``block`` blocks: a numerator and a denominator."""
        weight, phase = self.weights[source], self.phase[source]
        while phase < len(self.ends) and self.ends[phase][0] * weight < block * self.ends[phase][1]:
            phase += 1
        self.phase[source] = phase
        return self.done[phase] * weight + self.left[phase] * block, weight


def pfair_slots(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline), slot by slot, for whole weights."""
    blocks = {s: n for s, n in blocks.items() if n}
    targets = Targets(blocks, {s: weights[s] for s in blocks})

    def window(source: str, block: int) -> tuple[int, int]:
        (a, m), (b, _) = targets.time(source, block), targets.time(source, block + 1)
        return a // m, -(-b // m)

    later = [(*window(s, 0), s, 0) for s in blocks]
    heapq.heapify(later)
    ready: list[tuple[int, str, int, int]] = []
    for slot in range(sum(blocks.values())):
        while later and later[0][0] <= slot:
            release, deadline, s, k = heapq.heappop(later)
            heapq.heappush(ready, (deadline, s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, slot, release, deadline
        if k + 1 < blocks[s]:
            release, deadline = window(s, k + 1)
            heapq.heappush(later, (release, deadline, s, k + 1))


def whole_weights(sizes: dict[str, int], weights: dict[str, float] | None, exponent: float) -> dict[str, int]:
    """Targets as whole numbers: the weights given, exactly (1 where none is, a billionth at least), or sizes to a power, to a thousandth."""
    if weights is None:
        return {s: max(1, round(1000 * n**exponent)) for s, n in sizes.items()}
    exact = {s: max(Fraction(weights.get(s, 1)).limit_denominator(10**9), Fraction(1, 10**9)) for s in sizes}
    common = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def schedule(counts: DataFrame, weights: dict[str, float] | None, exponent: float, block_docs: int) -> DataFrame:
    """source, block, slot, release, deadline for a table of sources and their numbers of rows n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes: dict[str, int] = {}
        for batch in batches:
            sizes.update(zip(batch["source"], batch["n"].tolist(), strict=True))
        held = []
        for row in pfair_slots({s: -(-n // block_docs) for s, n in sizes.items()}, whole_weights(sizes, weights, exponent)):
            held.append(row)
            if len(held) == SLOTS_AT_ONCE:
                yield pd.DataFrame(held, columns=columns)
                held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    columns = ["source", "block", "slot", "release", "deadline"]
    return stage(counts.coalesce(1).mapInPandas(run, "source string, block long, slot long, release long, deadline long"), "mixing-slots")


def _scheduled(rows: DataFrame, weights: dict[str, float] | None, exponent: float, block_docs: int) -> DataFrame:
    """The rows (id, source and others) with block, slot, release, deadline and position."""
    counts = stage(rows.groupBy("source").agg(F.count("*").alias("n")), "mixing-counts")
    slots = schedule(counts, weights, exponent, block_docs)
    # a document's number within its source: buckets of bounded size, whose first numbers come from their counts
    parts = counts.select("source", F.ceil(F.col("n") / ROWS_PER_BUCKET).alias("parts"))
    rows = rows.join(parts, "source").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    sums = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "mixing-bases")
    within = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("id"))
    numbered = rows.withColumn("nth", within - 1).join(bases, ["source", "bucket"]).withColumn("nth", F.col("nth") + F.col("base"))
    numbered = numbered.withColumn("block", F.floor(F.col("nth") / block_docs)).drop("bucket", "base")
    placed = numbered.join(slots, ["source", "block"])
    return placed.withColumn("position", F.col("slot") * block_docs + F.col("nth") % block_docs).drop("nth")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, exponent: float = 0.7, block_docs: int = 8) -> DataFrame:
    """doc_id, source, block, slot, release, deadline and position.

    Targets are ``weights`` by source; else document counts to the power ``exponent``.
    ``position`` orders all documents; those of one block follow one another.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    placed = _scheduled(rows, weights, exponent, block_docs)
    return placed.select(F.col("id").alias("doc_id"), "source", "block", "slot", "release", "deadline", "position")


def in_mixed_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, exponent: float = 0.7, block_docs: int = 8) -> DataFrame:
    """All rows and columns of ``docs``, range-partitioned and sorted by their position in the mixture.

    Rows that come from files are told apart by file and row, and only ids and sources move for the schedule; others move whole.
    """
    small_batches(docs.sparkSession)
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    key = [F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")]
    try:
        at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
        placed = _scheduled(docs.select(*key, *at), weights, exponent, block_docs).select("file", "row", "position")
        placed = docs.select(doc, *at).join(placed.hint("shuffle_hash"), ["file", "row"])
    except AnalysisException:
        placed = _scheduled(docs.select(*key, doc), weights, exponent, block_docs)
    mixed = placed.select("doc", "position").repartitionByRange(shuffle_partitions(docs.sparkSession), "position").sortWithinPartitions("position")
    return mixed.select("doc.*")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_pfair_mixing": op5_pfair_mixing}
ORACLES: dict[str, str] = {}
