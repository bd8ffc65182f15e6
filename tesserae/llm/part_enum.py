"""Jaccard self-join of shingle sets by PartEnum signatures.

Sets fall into bands of nearly equal size. Two sets that are similar enough lie
in the same or in neighbouring bands and differ in at most k elements, where k
follows from the larger one's band. A hash splits the feature domain into
k + t + e parts for each band, so such a pair agrees on at least t + e of them;
signatures are the contents of all subsets of t parts (t falls with k), tagged with band
and subset, and the pair shares one. Subsets without any element are signed only
by sets with at most k parts in use: with more, one of the agreed parts holds an element.

Sets that share a signature are linked when their exact similarity reaches the
threshold: first each with the smallest member of each of its groups; then components
of the links found collapse the groups, overlapping groups are put together, and what is still apart within
one group is compared (see ``collide``). Necessary
conditions (sizes, and parity sketches whose distance never exceeds the sets')
come before every exact comparison. So no group's pairs are emitted as such, and
no link between components is lost.

Sets are told apart by 64-bit digests of 64-bit shingle hashes: sets whose digests collide, which is improbable, would count as equal.

Defined results: texts that are null, empty or blank have the empty set and link
with nothing; rows that repeat an id are one node of the graph only if their
texts agree; equal texts always share a component; an empty table gives an empty result;
other columns of the input play no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collide import SIGNATURES_PER_BUCKET, candidates, linked_components, merged
from .common import IdFilter, release_memory, shuffle_partitions, small_batches, stage, stage_result, text_or_empty
from .shingles import mix, set_digests, shingle_sets
from .tokens import pieces_of_batch

_STEP = np.uint64(0x9E3779B97F4A7C15)
SKETCH_WORDS = 16
LONG_WORDS = 256  # of the sketch of a long set, which has half a bit to one bit for each element
FINE_WORDS = 1 << 14  # of the second look at sets that a sketch is too coarse for


class Scheme:
    """Bands, parts and subsets for the similarity threshold num / den."""

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den
        self.low = [1]

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        self._grow(int(sizes.max(initial=1)) + 1)
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1

    @cache  # noqa: B019  one scheme per worker
    def instance(self, band: int) -> tuple[int, int, np.ndarray]:
        """k, number of parts and the subsets of parts for pairs whose larger set is in this band."""
        self._grow(self.low[-1])
        while band + 2 > len(self.low):
            self._grow(self.low[-1])
        most = self.low[band + 1] - 1
        k = 2 * most * (self.den - self.num) // (self.den + self.num)
        t = 3 if k <= 3 else 2 if k <= 9 else 1
        e = 0
        if t == 1:  # room for parts that stay empty by chance
            least = self.low[max(0, band - 1)]
            empty = (k + 1) * math.exp(-least / (k + 1))
            e = math.ceil(empty + 2 * math.sqrt(empty))
        parts = k + t + e
        subsets = np.array(list(itertools.combinations(range(parts), t)), np.int64) if t > 1 else np.arange(parts)[:, None]
        return k, parts, subsets

    def similar(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)


def signatures(elements: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of all signatures of sets given end to end."""
    ends = np.cumsum(sizes)
    starts, bands = ends - sizes, scheme.bands(np.maximum(sizes, 1))
    owners, found = [], []
    for band in np.unique(bands[sizes > 0]).tolist():
        own = np.flatnonzero((bands == band) & (sizes > 0))
        count = sizes[own]
        row = np.repeat(np.arange(len(own)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + starts[own][row]
        values = elements[at]
        for instance in (band, band + 1):
            k, parts, subsets = scheme.instance(instance)
            if k == 0:
                continue
            salt = np.uint64((instance + 1) * int(_STEP) % (1 << 64))
            part = (mix(values ^ salt) >> np.uint64(11)) % np.uint64(parts)
            cell = row * parts + part.astype(np.int64)
            used = np.bincount(cell, minlength=len(own) * parts).reshape(len(own), parts)
            content = np.zeros(len(own) * parts, np.uint64)
            np.add.at(content, cell, mix(values + salt))
            content = content.reshape(len(own), parts)
            if subsets.shape[1] == 1:
                sums, filled = content, used > 0
            else:
                sums, filled = content[:, subsets].sum(axis=2, dtype=np.uint64), used[:, subsets].sum(axis=2) > 0
            filled |= ((used > 0).sum(axis=1) <= k)[:, None]
            tags = (np.arange(len(subsets), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + salt
            signed = mix(sums + tags[None, :])
            r, c = np.nonzero(filled)
            owners.append(own[r])
            found.append(signed[r, c])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def parity_sketches(elements: np.ndarray, sizes: np.ndarray, most: int = SKETCH_WORDS) -> list[np.ndarray]:
    """For each set, the parities of the numbers of elements that hash to each of some bits: four for each element, up to ``most`` words; and for long sets half a bit to one, up to ``LONG_WORDS``.

    With as many bits for every long set, so many would differ by chance that all pairs of long sets passed. The number of bits is a power of 2; the lower half of them XORed with the upper half is the sketch of half the size. However few the bits,
    no more of them differ than elements do, so a sketch never turns away a pair that links.
    """
    log = np.log2(np.maximum(sizes, 1))
    words = np.maximum(np.clip(4 << np.ceil(log).astype(np.int64) >> 6, 4, most), np.minimum(1 << np.floor(log).astype(np.int64) >> 6, LONG_WORDS))
    start = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = (elements >> np.uint64(7)) & (words[owner] * 64 - 1).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, start[owner] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return np.split(out.view(np.int64), start[1:]) if len(sizes) else []


def _sets(texts: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([t.encode() for t in texts], width)


def part_enum_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), set_id (equal for equal shingle sets)."""
    small_batches(docs.sparkSession)
    return stage_result(lambda: _components(docs, id_col, text_col, width, num, den), docs.sparkSession, "partenum")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces_of_batch(batch):
                elements, sizes = _sets(part["text"], width)
                node, sketch, fine = set_digests(elements, sizes)[0], parity_sketches(elements, sizes), [None] * len(sizes)
                long = np.flatnonzero(sizes * 4 > SKETCH_WORDS * 64)
                own = np.concatenate([np.zeros(0, np.uint64), *(elements[e - n : e] for e, n in zip(np.cumsum(sizes)[long], sizes[long], strict=True))])
                for k, words in zip(long.tolist(), parity_sketches(own, sizes[long], FINE_WORDS), strict=True):
                    fine[k] = words.tobytes()
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n": sizes, "node": node, "sketch": sketch, "fine": pd.Series(fine, dtype=object)})
        release_memory()

    described = stage(rows.mapInPandas(describe, f"doc_id {id_type}, n long, node long, sketch array<long>, fine binary"), "partenum-sets")
    nodes = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine"))
    nodes = stage(nodes, "partenum-nodes")
    fine, nodes = nodes.select("node", "n", "fine").where("fine IS NOT NULL"), nodes.drop("fine")

    elements = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), math.ceil(0.65 * elements / SIGNATURES_PER_BUCKET))

    def signed(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in pieces_of_batch(batch):
            elements, sizes = _sets(part["text"], width)
            owner, sig = signatures(elements, sizes, scheme)
            yield set_digests(elements, sizes)[0][owner], sig

    scheme = Scheme(num, den)
    found = stage(candidates(rows.select("text"), signed, buckets), "partenum-candidates")
    classes = linked_components(
        found, nodes.drop("doc_id"), lambda x, y: _may_link(x, y, num, den), lambda told: _near(told, num, den), lambda wanted: _needed_sets(wanted, nodes, rows, width), lambda pairs, sets: (_verified_together if "place" in pairs.columns else _verified)(pairs, sets, num, den), "partenum", "n", lambda pairs: (_finer if "place" in pairs.columns else _finer_stars)(pairs, fine, num, den), lambda groups, _: merged(groups),
    )

    placed = nodes.select("node", "doc_id").join(classes, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(least, "component").select("node", "component_id")
    out = described.where("n > 0").join(placed, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("node").alias("set_id"))
    empty = described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("set_id"))
    return out.unionAll(empty)


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Necessary for a link: sizes within the ratio, and no more different parities than different elements are allowed."""
    a, b = F.col(f"n{x}"), F.col(f"n{y}")
    p, q = F.col(f"sketch{x}"), F.col(f"sketch{y}")
    words = F.least(F.size(p), F.size(q))  # sizes within the ratio differ by one halving at most
    half = lambda s: F.when(F.size(s) > words, F.zip_with(F.slice(s, F.lit(1), words), F.slice(s, words + 1, words), lambda v, w: v.bitwiseXOR(w))).otherwise(s)
    flips = F.aggregate(F.zip_with(half(p), half(q), lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda t, n: t + n)
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (flips * (den + num) <= (a + b) * (den - num))


def _near(told: dict[str, np.ndarray], num: int, den: int):
    """The same for rows given as arrays."""
    n, words = told["n"].astype(np.int64), np.array([len(s) for s in told["sketch"]], np.int64)
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sketches(width: int) -> tuple[np.ndarray, np.ndarray]:
        """All sketches of this many words and more folded to it, and the rows they are in."""
        if width not in folded:
            place, parts = np.zeros(len(words), np.int64), []
            for w in np.unique(words[words >= width]).tolist():
                own = np.flatnonzero(words == w)
                place[own] = sum(map(len, parts)) + np.arange(len(own))
                told_as = np.stack([told["sketch"][k] for k in own]).astype(np.int64).view(np.uint64)  # bits of signed numbers count wrongly
                while told_as.shape[1] > width:
                    half = told_as.shape[1] // 2
                    told_as = told_as[:, :half] ^ told_as[:, half:]
                parts.append(told_as)
            folded[width] = np.concatenate(parts), place
        return folded[width]

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        good = np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
        width = np.minimum(words[i], words[j])
        for w in np.unique(width[good]).tolist():
            rows, place = sketches(w)
            own = np.flatnonzero(good & (width == w))
            for part in np.array_split(own, -(-len(own) * w // (1 << 22))):
                x, y = i[part], j[part]
                flips = np.bitwise_count(rows[place[x]] ^ rows[place[y]]).sum(axis=1, dtype=np.int64)
                good[part] = flips * (den + num) <= (n[x] + n[y]) * (den - num)
        return good

    return test


def _needed_sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, elements) of the nodes wanted, from one document of each."""
    let = IdFilter(wanted.join(nodes.select("node", "doc_id"), "node"), IdFilter.cell("doc_id"))
    texts = rows.select(IdFilter.cell("doc_id").alias("cell"), "text")

    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces_of_batch(batch[let.lets(batch["cell"].to_numpy())]):
                elements, sizes = _sets(part["text"], width)
                raw, ends = elements.tobytes(), 8 * np.cumsum(sizes)
                sets = [raw[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pd.DataFrame({"node": set_digests(elements, sizes)[0], "elements": sets})
        release_memory()

    return stage(texts.mapInPandas(shingle, "node long, elements binary").join(wanted, "node", "left_semi"), "partenum-needed")


def _dealt(pairs: DataFrame, told: DataFrame, columns: list[str], block: int = 256) -> DataFrame:
    """(a, node, columns): for each node a of the pairs, its own row of ``told`` (node, columns) and then those of its partners.

    The partners of a node come in blocks of bounded size, each with its own copy of the node's row. Columns are null for nodes that ``told`` lacks.
    """
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = pairs.join(degree, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks")).select("a", "block", "b")
    dealt = dealt.select("a", "block", F.col("b").alias("node")).unionAll(dealt.select("a", "block", F.col("a").alias("node")).distinct())
    dealt = dealt.join(told, "node", "left").repartition(shuffle_partitions(pairs.sparkSession), "a", "block")
    return dealt.withColumn("rank", (F.col("node") != F.col("a")).cast("int")).sortWithinPartitions("a", "block", "rank").select("a", "node", *columns)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs whose sets are similar enough, compared exactly."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme, pivot, own = Scheme(num, den), None, None
        for batch in batches:
            linked = []
            for a, node, raw in zip(batch["a"].tolist(), batch["node"].tolist(), batch["elements"], strict=True):
                x = np.frombuffer(raw, np.uint64)
                if node == a:
                    pivot, own = a, x
                elif pivot == a:
                    shared = len(np.intersect1d(own, x, assume_unique=True))
                    if scheme.similar(shared, len(own), len(x)):
                        linked.append((a, node))
            yield pd.DataFrame(linked, columns=["a", "b"])
        release_memory()

    return _dealt(pairs, sets, ["elements"]).mapInPandas(compare, "a long, b long").distinct()


def _flips(x: np.ndarray, y: np.ndarray) -> int:
    """The number of places in which two sketches differ, the longer one folded."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _finer_stars(pairs: DataFrame, fine: DataFrame, num: int, den: int) -> DataFrame:
    """What ``_finer`` keeps, for pairs (a, b) without a place: a node's sketch comes once for each block of its partners."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, size = None, 0
        for batch in batches:
            kept = []
            for a, node, n, raw in zip(batch["a"].tolist(), batch["node"].tolist(), batch["n"].tolist(), batch["fine"], strict=True):
                x = None if raw is None else np.frombuffer(raw, np.uint64)
                if node == a:
                    own, size = x, n
                elif own is None or x is None or _flips(own, x) * (den + num) <= (size + n) * (den - num):
                    kept.append((a, node))
            yield pd.DataFrame(kept, columns=["a", "b"])
        release_memory()

    return _dealt(pairs, fine, ["n", "fine"]).mapInPandas(test, "a long, b long")


def _finer(pairs: DataFrame, fine: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, place) without those whose finer sketches differ in more places than a link allows; those of sets that have none stay. A place's sketches come once for all of its pairs."""
    ends = pairs.select("place", F.col("a").alias("node")).unionAll(pairs.select("place", F.col("b").alias("node"))).distinct()

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = {node: (n, np.frombuffer(raw, np.uint64)) for node, n, raw in zip(right["node"].tolist(), right["n"].tolist(), right["fine"], strict=True)}

        def may(a: int, b: int) -> bool:
            if a not in held or b not in held:
                return True
            (n, x), (m, y) = held[a], held[b]
            return _flips(x, y) * (den + num) <= (n + m) * (den - num)

        return left[[may(a, b) for a, b in zip(left["a"].tolist(), left["b"].tolist(), strict=True)]]

    told = ends.join(fine, "node").select(F.col("place").alias("at"), "node", "n", "fine")
    return pairs.groupBy("place").cogroup(told.groupBy("at")).applyInPandas(test, "a long, b long, place long")


def _verified_together(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The same for pairs (a, b, place): all sets of a place, of bounded size in all, come once, and its pairs look them up."""
    ends = pairs.select("place", F.col("a").alias("node")).unionAll(pairs.select("place", F.col("b").alias("node"))).distinct()

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        scheme, held = Scheme(num, den), {n: np.frombuffer(raw, np.uint64) for n, raw in zip(right["node"].tolist(), right["elements"], strict=True)}
        linked = []
        for a, b in zip(left["a"].tolist(), left["b"].tolist(), strict=True):
            x, y = held[a], held[b]
            if scheme.similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                linked.append((a, b))
        del held, right
        release_memory()
        return pd.DataFrame(linked, columns=["a", "b"])

    held = ends.join(sets, "node").select(F.col("place").alias("at"), "node", "elements")
    return pairs.groupBy("place").cogroup(held.groupBy("at")).applyInPandas(compare, "a long, b long").distinct()


def op4_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_part_enum": op4_part_enum}
ORACLES: dict[str, str] = {}
