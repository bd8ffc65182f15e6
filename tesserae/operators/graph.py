"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.staging import stage

EDGES_PER_TASK = 500_000


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node of the component.

    Every task first replaces its own edges by stars of the same components, which
    settles what few edges there are in one task. For more tasks, the large-star and
    small-star steps of Kiveris et al. (2014) alternate until the edges stay the same, which takes a number of rounds logarithmic in the
    nodes. Each step is a map-side combined minimum per node and an equi-join, so
    the neighbours of a hub are never gathered in one place. Rows with a null end
    and loops add no link; a node that only has loops is its own component.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select("a")
    pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    given = stage(pairs, "components-edges")
    tasks = max(1, -(-given.count() // EDGES_PER_TASK))
    pairs = stage(given.coalesce(tasks).mapInPandas(_stars, given.schema), "components-0")
    mark, n = None, 0
    while tasks > 1:  # one task has seen all edges otherwise
        n += 1
        step = _small_star(_large_star(pairs))
        # steps never add edges, so the last count bounds this one; few edges don't need many tasks and files
        pairs = stage(step if mark is None else step.coalesce(max(1, -(-mark[0] // EDGES_PER_TASK))), f"components-{n}")
        # an order-free mark of the edge set: its size and the sum of a hash of each edge
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = stars.unionAll(roots)
    alone = loops.distinct().select(F.col("a").alias("node"), F.col("a").alias("component")).join(found.select("node").hint("merge"), "node", "left_anti")
    return found.unionAll(alone)


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges from every node to the smallest of its component within runs of bounded size."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= EDGES_PER_TASK:
            held, n = [_star_edges(pd.concat(held))], 0
            if len(held[0]) > EDGES_PER_TASK // 2:
                yield held.pop()
    if held:
        yield _star_edges(pd.concat(held))


def _star_edges(edges: pd.DataFrame) -> pd.DataFrame:
    nodes, at = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    x, y = at[: len(edges)], at[len(edges) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[own], "b": nodes[root[own]]})


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and all its neighbours."""
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of these."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
