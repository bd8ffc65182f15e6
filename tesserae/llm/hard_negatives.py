"""Hard negatives by exact search with an orthogonal PCA rotation.

Components are scaled to whole numbers, and a score is the whole inner product. All rows are turned by the eigenvectors of their second
moments, which leaves inner products as they are and moves most of them into the leading components. An anchor and a row then
have the partial product of the leading components, and what the others can add is at most the product of the residual norms, plus a slack for
rounding. A pair whose bounds lie outside the scores still wanted is discarded; more components are added to the rest, and what survives
is verified by whole products, so the rotation decides how fast the search is and nothing else.

Rows lie in blocks, and so do anchors; each pair of an anchor block with a group of row blocks is one bounded piece of work. What an anchor
already has among the anchors of its own block bounds what it takes from the rest, so few candidates are shuffled.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; nor do rows so long that a score could pass
2**60. Shorter vectors count as padded with zeros, empty ones as zero. "Other" rows are rows of another id; rows that repeat an id each take part, and an
anchor row that occurs twice has its results twice. Scores may be equal or negative: ties go by id, and a positive with a negative score has no negatives. An empty table
gives an empty result; further columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, small_batches, stage, stage_result

ROWS_PER_BLOCK = 4096
ROWS_PER_GROUP = 8192
ANCHORS_PER_BLOCK = 8192
ROWS_AT_ONCE = 512
PAIRS_AT_ONCE = 1 << 17
LEAST, MOST = -(1 << 61), 1 << 61
BLOCK = "ids binary, labels binary, whole binary, turned binary"
FOUND = "a int, i int, w int, id long, score long"


@dataclass
class Block:
    """Some rows: their ids, labels, whole components and turned components."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray

    @classmethod
    def of(cls, records: pd.DataFrame, dims: int) -> Block:
        def joined(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in records[name]]) if len(records) else np.zeros(0, kind)

        return cls(joined("ids", np.int64), joined("labels", np.int32), joined("whole", np.int32).reshape(-1, dims), joined("turned", np.float32).reshape(-1, dims))

    def take(self, rows) -> Block:
        return Block(self.ids[rows], self.labels[rows], self.whole[rows], self.turned[rows])

    def record(self) -> dict[str, bytes]:
        return {k: np.ascontiguousarray(x).tobytes() for k, x in vars(self).items()}

    def residual(self, k: int) -> np.ndarray:
        """Norms of what lies beyond the first k turned components."""
        return np.sqrt((self.turned[:, k:].astype(np.float64) ** 2).sum(axis=1))


class Rotation:
    """An orthogonal matrix whose first rows hold most of the data's weight, and the bounds that follow."""

    def __init__(self, moments: np.ndarray):
        self.dims = len(moments)
        self.matrix = np.linalg.eigh(moments)[1].T[::-1].copy()
        d = self.dims
        self.levels = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d})
        # by how much a partial product and a norm can be off, as a share of the norms: single precision, and a matrix not quite orthogonal
        self.slack = (2 * d + 32) * 2.0**-23 + float(np.abs(self.matrix @ self.matrix.T - np.eye(d)).sum())

    def turn(self, whole: np.ndarray) -> np.ndarray:
        return (whole.astype(np.float64) @ self.matrix.T).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole inner products of rows i of ``a`` with rows j of ``b``."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), PAIRS_AT_ONCE):
        part = slice(k, k + PAIRS_AT_ONCE)
        out[part] = np.einsum("nd,nd->n", a[i[part]].astype(np.int64), b[j[part]].astype(np.int64))
    return out


def surviving(rotation: Rotation, anchors: Block, rows: Block, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wanted pairs whose bounds allow a score from ``low`` to ``high`` of the anchor: indices of anchors and of rows."""
    low32 = np.nextafter(low.astype(np.float32), np.float32(-np.inf))[:, None]
    high32 = np.nextafter(high.astype(np.float32), np.float32(np.inf))[:, None]
    norms = anchors.residual(0), rows.residual(0)
    done, i, part = 0, None, np.zeros(wanted.shape, np.float32)
    for k in rotation.levels:
        rest = [x.residual(k) * (1 + rotation.slack) for x in (anchors, rows)]
        if i is None:
            part += anchors.turned[:, done:k] @ rows.turned[:, done:k].T
            reach = np.outer(*(x.astype(np.float32) for x in rest)) + np.outer(*(x.astype(np.float32) for x in norms)) * np.float32(rotation.slack)
            wanted = wanted & (part + reach >= low32) & (part - reach <= high32)
            if np.count_nonzero(wanted) * 16 < wanted.size:  # few are left: go on with them alone
                i, j = np.nonzero(wanted)
                part = part[i, j]
        else:
            for c in range(done, k):
                part += anchors.turned[i, c] * rows.turned[j, c]
            reach = rest[0][i] * rest[1][j] + norms[0][i] * norms[1][j] * rotation.slack
            keep = (part + reach >= low32[i, 0]) & (part - reach <= high32[i, 0])
            i, j, part = i[keep], j[keep], part[keep]
        done = k
    return np.nonzero(wanted) if i is None else (i, j)


def search(rotation: Rotation, anchors: Block, rows: Block, lows: np.ndarray, highs: np.ndarray, take: int, same: bool) -> pd.DataFrame:
    """For each anchor and each of its ranges of scores, the first ``take`` rows of the same label (and another id) or of a different label.

    i, w, id, score; ranges are the columns of ``lows`` and ``highs``, empty where low exceeds high.
    """
    lows, found = lows.copy(), pd.DataFrame({"i": [], "w": [], "id": [], "score": []}, dtype=np.int64)
    open_ = lows <= highs
    for k in range(0, len(rows.ids), ROWS_AT_ONCE):
        some = rows.take(slice(k, k + ROWS_AT_ONCE))
        alike = anchors.labels[:, None] == some.labels[None, :]
        wanted = alike & (anchors.ids[:, None] != some.ids[None, :]) if same else ~alike
        low, high = np.where(open_, lows, MOST).min(axis=1), np.where(open_, highs, LEAST).max(axis=1)
        i, j = surviving(rotation, anchors, some, wanted & (low <= high)[:, None], low, high)
        score = products(anchors.whole, some.whole, i, j)
        new = [found]
        for w in range(lows.shape[1]):
            at = np.flatnonzero((score >= lows[i, w]) & (score <= highs[i, w]))
            new.append(pd.DataFrame({"i": i[at], "w": w, "id": some.ids[j[at]], "score": score[at]}))
        found = first_of(pd.concat(new), take)
        full = found.groupby(["i", "w"])["score"].agg(["size", "min"])
        full = full[full["size"] == take]
        at = full.index.get_level_values(0).to_numpy(int), full.index.get_level_values(1).to_numpy(int)
        lows[at] = np.maximum(lows[at], full["min"].to_numpy(np.int64))
    return found


def first_of(found: pd.DataFrame, take: int) -> pd.DataFrame:
    """The first ``take`` of each anchor and range: highest scores first, then smallest ids."""
    found = found.iloc[np.lexsort((found["id"], -found["score"], found["w"], found["i"]))]
    return found[found.groupby(["i", "w"]).cumcount() < take].reset_index(drop=True)


def _ranked(found: DataFrame, take: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("a", "i", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= take)


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label and whole components of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    # NaN sorts above infinity, so both fail the comparison
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x * scale) + 1)), F.lit(0.0))
    return rows.where(largest * largest * F.size("v") <= 2.0**60).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out, flat = np.zeros((len(lengths), dims), np.int32), column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def fit_rotation(rows: DataFrame, dims: int) -> Rotation:
    """The eigenvectors of the second moments of all rows: sums per task, added up by Spark; dims * dims numbers reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_pydict({"at": np.arange(dims * dims, dtype=np.int32), "s": total.ravel()})

    moments = np.zeros(dims * dims)
    for r in rows.select("v").mapInArrow(sums, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        moments[r["at"]] = r["s"]
    return Rotation(moments.reshape(dims, dims))


def _packed(rows: DataFrame, rotation: Rotation, anchor_every: int) -> DataFrame:
    """Blocks of rows of one task: block, n, n_anchors and the matrices."""
    dims = rotation.dims

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, ...]] = []
        made = 0

        def block() -> pd.DataFrame:
            ids, labels, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            out = Block(ids, labels, whole, rotation.turn(whole)).record()
            return pa.RecordBatch.from_pylist([{"block": task << 32 | made, "n": len(ids), "n_anchors": int((ids % anchor_every == 0).sum()), **out}], schema=schema)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32), _matrix(batch.column(2), dims)))
            if sum(len(x[0]) for x in held) >= ROWS_PER_BLOCK:
                yield block()
                made += 1
        if any(len(x[0]) for x in held):
            yield block()

    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("n_anchors", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "whole", "turned"))])
    return rows.select("vec_id", "label", "v").mapInArrow(pack, f"block long, n long, n_anchors long, {BLOCK}")


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    scale: int = 256,
    anchor_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    share: tuple[int, int] = (50, 95),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id is a multiple of ``anchor_every``. For each, the first ``positives`` other rows of its label, and for each of these the first
    ``negatives`` rows of different labels whose score is within ``share`` per cent of the positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark, ROWS_PER_BLOCK)
    rows = whole_rows(vectors, id_col, vector_col, F.col(label) if isinstance(label, str) else label, scale)
    return stage_result(lambda: _mined(rows, anchor_every, positives, negatives, share), spark, "negatives")


def _mined(rows: DataFrame, anchor_every: int, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    spark = rows.sparkSession
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    rotation = fit_rotation(rows, dims)
    packed = stage(_packed(rows, rotation, anchor_every), "negatives-rows")
    size = packed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_anchors"), F.lit(0)).alias("anchors")).first()
    n_groups = max(1, shuffle_partitions(spark), -(-size["n"] // ROWS_PER_GROUP))
    n_blocks = max(1, -(-size["anchors"] // ANCHORS_PER_BLOCK))

    def dealt_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The anchors of each block, dealt evenly to the anchor blocks by their place in it."""
        for batch in batches:
            out = []
            for k in range(len(batch)):
                own = Block.of(batch.iloc[k : k + 1], dims)
                at = np.flatnonzero(own.ids % anchor_every == 0)
                to = (np.arange(len(at)) + int(batch["block"].iloc[k]) * 0x9E37 % n_blocks) % n_blocks
                out += [{"a": int(a), "block": int(batch["block"].iloc[k]), **own.take(at[to == a]).record()} for a in np.unique(to)]
            yield pd.DataFrame(out, columns=["a", "block", "ids", "labels", "whole", "turned"])

    def anchor_block(key: tuple, records: pd.DataFrame) -> pd.DataFrame:
        """One record for an anchor block, with the least score that each anchor's positives can have."""
        own = Block.of(records.sort_values("block"), dims)
        low = np.full((len(own.ids), 1), LEAST, np.int64)
        found = search(rotation, own, own, low, np.full_like(low, MOST), positives, True)
        return pd.DataFrame([{"a": key[0], **own.record(), "lows": _raised(low, found, positives).tobytes(), "highs": np.full_like(low, MOST).tobytes()}])

    def cell(take: int, same: bool):
        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame(columns=["a", "i", "w", "id", "score"])
            own = Block.of(left, dims)
            lows, highs = (np.frombuffer(left[c].iloc[0], np.int64).reshape(len(own.ids), -1) for c in ("lows", "highs"))
            found = search(rotation, own, Block.of(right, dims), lows, highs, take, same)
            return found.assign(a=key[0])[["a", "i", "w", "id", "score"]]

        return run

    def searched(anchors: DataFrame, take: int, same: bool) -> DataFrame:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = anchors.withColumn("r", every(n_groups))
        right = packed.withColumn("r", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int")).drop("n", "n_anchors").withColumn("a", every(n_blocks))
        return _ranked(left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInPandas(cell(take, same), FOUND), take)

    def with_ranges(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """An anchor block with a range of scores for each positive, raised by what its own anchors offer."""
        if not len(left):
            return pd.DataFrame(columns=["a", "ids", "labels", "whole", "turned", "lows", "highs"])
        own = Block.of(left, dims)
        lows, highs = np.full((len(own.ids), positives), MOST, np.int64), np.full((len(own.ids), positives), LEAST, np.int64)
        at, score = (right["i"].to_numpy(int), right["place"].to_numpy(int) - 1), right["score"].to_numpy(np.int64)
        part = lambda p: score // 100 * p + score % 100 * p // 100  # noqa: E731  score * p // 100 where that product would not fit
        lows[at], highs[at] = -(-score // 100 * share[0] + -score % 100 * share[0] // 100), part(share[1])
        found = search(rotation, own, own, lows, highs, negatives, False)
        return pd.DataFrame([{"a": key[0], **own.record(), "lows": _raised(lows, found, negatives).tobytes(), "highs": highs.tobytes()}])

    ranges = f"a int, {BLOCK}, lows binary, highs binary"
    dealt = packed.where("n_anchors > 0").mapInPandas(dealt_anchors, f"a int, block long, {BLOCK}")
    anchors = stage(dealt.groupBy("a").applyInPandas(anchor_block, ranges), "negatives-anchors")
    near = stage(searched(anchors, positives, True), "negatives-positives")
    ranged = stage(anchors.drop("lows", "highs").groupBy("a").cogroup(near.groupBy("a")).applyInPandas(with_ranges, ranges), "negatives-ranges")
    hard = searched(ranged, negatives, False).select("a", "i", (F.col("w") + 1).alias("nth"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("a", "i", F.col("place").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    def anchor_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, raw in zip(batch["a"], batch["ids"], strict=True):
                ids = np.frombuffer(raw, np.int64)
                yield pd.DataFrame({"a": a, "i": np.arange(len(ids)), "anchor_id": ids})

    named = anchors.select("a", "ids").mapInPandas(anchor_ids, "a int, i int, anchor_id long")
    out = hard.join(near, ["a", "i", "nth"]).join(named, ["a", "i"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _raised(lows: np.ndarray, found: pd.DataFrame, take: int) -> np.ndarray:
    """Lowest scores that still count, where an anchor has ``take`` rows already."""
    out = lows.copy()
    last = found[found.groupby(["i", "w"]).cumcount() == take - 1]
    at = last["i"].to_numpy(int), last["w"].to_numpy(int)
    out[at] = np.maximum(out[at], last["score"].to_numpy(np.int64))
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": ORACLE}
