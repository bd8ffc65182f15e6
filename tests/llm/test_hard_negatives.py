"""Hard negatives against all products, with the cases that rows can bring."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import hard_negatives as H

from ..oracle import connect, same

SCHEMA = "vec_id long, embedding array<float>, label int, a string, i string, w string, v string, score string, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)


def brute(rows, every=50, n_pos=5, n_neg=3):
    own = []
    for vec_id, v, label in rows:
        if vec_id is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  what is missing is zero
    out = []
    for anchor, v, label in own:
        if anchor % every:
            continue
        scored = sorted((-dot(v, u), k, other) for k, u, other in own if k != anchor)
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            fits = [(k, -t) for t, k, other in sorted((-dot(v, u), k, other) for k, u, other in own) if other != label and 50 * -s <= 100 * -t <= 95 * -s][:n_neg]
            out += [(anchor, p, r + 1, k, -s, t) for r, (k, t) in enumerate(fits)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in H.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some(seed, n, dims=12, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for k in range(n):
        label = rng.randrange(labels)
        rows.append((k, [0.6 * c + rng.gauss(0, 0.6) for c in centres[rng.choice([label, label, rng.randrange(labels)])]], label))
    return rows


def test_against_all_products(spark):
    rows = some(1, 600)
    assert mined(table(spark, rows).repartition(5)) == brute(rows)


def test_ties_copies_nulls_and_odd_lengths(spark):
    rows = some(2, 260, dims=6)
    rows += [(1000 + k, list(rows[50][1]), k % 3) for k in range(120)]  # copies of an anchor under all labels
    rows += [(2000 + k, [0.0] * 6, k % 2) for k in range(20)] + [(2100, [], 1), (2150, [], 0), (2200, [1.0], 0), (2250, [float(x) for x in range(9)], 1)]
    rows += [(3000, None, 1), (3050, [1.0, None], 1), (3100, [math.nan, 1.0], 1), (3150, [math.inf] * 6, 0), (3200, [-math.inf], 0), (3250, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(3300, [30000.0] * 6, 1), (3301, [-30000.0] * 6, 1), (3302, [29000.0] * 6, 0), (3303, [1e-30] * 6, 0)]
    rows += [rows[100], rows[100], rows[101]]  # rows that repeat
    assert mined(table(spark, rows).repartition(3)) == brute(rows)


def test_rows_beyond_the_range_of_scores_take_no_part(spark):
    rows = some(3, 120, dims=4)
    assert mined(table(spark, [*rows, (5000, [3e38] * 4, 1)])) == brute(rows)


def test_empty_and_tiny_tables(spark):
    for rows in ([], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert mined(table(spark, rows)) == []


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = some(4, 500)
    want = brute(rows)
    for name, value in (("ANCHORS_PER_BLOCK", 3), ("ROWS_PER_BLOCK", 40), ("ROWS_PER_GROUP", 60), ("ROWS_AT_ONCE", 7), ("PAIRS_AT_ONCE", 16)):
        monkeypatch.setattr(H, name, value)
    assert mined(table(spark, rows).repartition(4)) == want


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(5)
    whole = (rng.normal(size=(700, 32)) * np.geomspace(200, 2, 32)).astype(np.int32) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]
    whole = np.floor(whole).astype(np.int32)
    rotation = H.Rotation((whole.astype(float).T @ whole))
    block = H.Block(np.arange(700), np.zeros(700, np.int32), whole, rotation.turn(whole))
    score = whole.astype(np.int64) @ whole.astype(np.int64).T
    low = np.sort(score, axis=1)[:, -10]
    i, j = H.surviving(rotation, block, block, np.ones((700, 700), bool), low, np.full(700, H.MOST))
    kept = np.zeros((700, 700), bool)
    kept[i, j] = True
    assert kept[score >= low[:, None]].all() and kept.mean() < 0.05
    assert (H.products(whole, whole, i, j) == score[i, j]).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    same(spark, connect(f"/root/testdata/{sf}"), H.op11_hard_negatives, H.ORACLE, f"/root/testdata/{sf}")


def test_labels_by_expression(spark):
    rows = some(6, 200)
    got = H.hard_negatives(table(spark, rows), label=F.col("label") * 0 + 1)
    assert got.count() == 0  # no label differs
