"""Groups of nodes that share signatures, and components of the links found within them.

Nodes are 64-bit numbers. Each has any number of 64-bit signatures; two nodes that share one are compared unless links
have already put them in one component. First, each node is compared with the smallest member of each of its groups. Components
of these links collapse the groups. Of groups that still hold several components, pairs of members in different ones are compared next. The pairs of a group are never emitted
as such: a cheap necessary condition is tested within the task, on arrays, and only pairs that meet it leave the task. Where more pairs meet it than there are
members, as many as members leave it first, chosen so that they join what all would; these links collapse the groups once more, and then all pairs that are still apart are compared.

A signature that is frequent within one task (``LOCAL_HOT``) doesn't send all its nodes to one bucket: the task tells
the members under the signature's own group name and sends only the smallest, with a mark. The bucket tells what it gets
of a marked signature under the same name, so the members from all tasks form one group. Large groups are dealt in
blocks of ``MEMBERS_PER_BLOCK``, and every pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.graph import connected_components

from .common import release_memory, shuffle_partitions, stage, stage_result
from .shingles import mix, segment_sums

LOCAL_HOT = 32
SIGNATURES_PER_BUCKET = 500_000
SIGNATURES_PER_CHUNK = 600_000
MEMBERS_PER_BLOCK = 512
ROWS_PER_RUN = 20_000
PAIRS_PER_STEP = 1 << 18
WEIGHT_PER_PART = 1 << 20
SHORT = np.uint64((1 << 47) - 1)
MARK = np.uint64(1 << 47)

CANDIDATES = "a long, b long, gid long"
_NAME, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _sorted_groups(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and nodes in order without repeats, the first row of each signature and its number of rows."""
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    # most signatures have one row; only those of more have an order to find
    same = np.append(False, sig[1:] == sig[:-1]) if len(sig) else np.zeros(0, bool)
    if len(shared := np.flatnonzero(same | np.append(same[1:], False))):
        node[shared] = node[shared][np.lexsort((node[shared], sig[shared]))]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
    return sig, node, head, np.diff(np.append(head, len(sig)))


def _name(bucket: np.ndarray | int, short: np.ndarray) -> np.ndarray:
    """The name of the group of a hot signature, alike in tasks and buckets; odd."""
    return (mix(short * _NAME + np.uint64(bucket) if np.isscalar(bucket) else short * _NAME + bucket) | np.uint64(1)).view(np.int64)


def _rows(a: np.ndarray, b: np.ndarray, gid: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a, "b": b, "gid": gid})


def _star(node: np.ndarray, head: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    """Each group's smallest node with each other one, without repeats."""
    first = np.repeat(node[head], size)
    own = np.ones(len(node), bool)
    own[head] = False
    pairs = np.stack([first[own], node[own]], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    pairs = pairs[fresh]
    return _rows(pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))


def _select(rows: np.ndarray, head: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, heads and sizes of chosen groups only."""
    kept = rows[np.repeat(chosen, size)]
    size = size[chosen]
    return kept, np.cumsum(size) - size, size


def _joined(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have so many rows at least, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= least:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def candidates(rows: DataFrame, signed: Callable[[pd.DataFrame], Iterator[tuple[np.ndarray, np.ndarray]]], buckets: int, least: int = 1) -> DataFrame:
    """Pairs (gid 0) and members of groups (a, with the group's gid); ``signed`` gives (node, signature) arrays of a batch, of ``least`` rows at least where there are as many."""
    many = np.uint64(buckets)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in _joined(batches, least):
            for node, sig in signed(batch):
                held.append((node, sig))
                count += len(sig)
                if count >= SIGNATURES_PER_CHUNK:
                    told, held, count = deal(held), [], 0
                    yield told
        if count:
            yield deal(held)
        release_memory()

    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        """Signatures by bucket: each node's number of them, and 47 bits and a mark of each. What is told already is a bucket of its own."""
        node, sig = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket, short = sig % many, sig // many & SHORT
        key, node, head, size = _sorted_groups(bucket << np.uint64(47) | short, node) if buckets < 1 << 16 else _sorted_groups(sig, node)
        bucket, short = (key >> np.uint64(47), key & SHORT) if buckets < 1 << 16 else (key % many, key // many & SHORT)
        hot = size >= LOCAL_HOT
        out = []
        if hot.any():
            own, first, n = _select(node, head, size, hot)
            pairs = _star(own, first, n)
            names = np.repeat(_name(bucket[head[hot]], short[head[hot]]), n)
            told = (np.append(pairs["a"], own), np.append(pairs["b"], np.zeros(len(own), np.int64)), np.append(pairs["gid"], names))
            out.append((buckets + int(own[0] % 1_000_003), *(x.tobytes() for x in told)))
            short = short.copy()
            short[head[hot]] |= MARK
            keep = np.repeat(~hot, size)
            keep[head] = True
            node, bucket, short = node[keep], bucket[keep], short[keep]
        if (bucket[1:] < bucket[:-1]).any():
            order = np.argsort(bucket, kind="stable")
            node, bucket, short = node[order], bucket[order], short[order]
        bucket = bucket.astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        raw = np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        for first, last in zip(np.append(0, cuts).tolist(), np.append(cuts, len(node)).tolist(), strict=True):
            order = np.argsort(node[first:last])
            own = node[first:last][order]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out.append((int(bucket[first]), own[begin].tobytes(), np.diff(np.append(begin, len(own))).astype("<u4").tobytes(), raw[first:last][order].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "nodes", "counts", "sigs"])

    def meet(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        """All signatures of one bucket, sorted: what several nodes share."""
        if key[0] >= buckets:
            return _rows(*(np.frombuffer(b"".join(batch[c]), np.int64) for c in ("nodes", "counts", "sigs")))
        node = np.concatenate([np.repeat(np.frombuffer(n, np.int64), np.frombuffer(c, "<u4")) for n, c in zip(batch["nodes"], batch["counts"], strict=True)])
        raw = np.frombuffer(b"".join(batch["sigs"]), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        short = wide.view("<u8").ravel()
        marked = np.unique(short[short >= MARK] & SHORT)
        short, node, head, size = _sorted_groups(short & SHORT, node)
        several = size > 1
        node, (short, size) = node[np.repeat(several, size)], (short[head[several]], size[several])
        head = np.cumsum(size) - size
        pairs = _star(node, head, size)
        # groups of three and more, those of the same members once, under a digest of them; even, as hot groups have odd names
        hot = np.isin(short, marked)
        gid = (mix(segment_sums(mix(node.view(np.uint64) + _SALT), size) + size.astype(np.uint64)) & ~np.uint64(1)).view(np.int64)
        gid[gid == 0] = 2
        gid[hot] = _name(int(key[0]), short[hot])
        chosen = np.zeros(len(size), bool)
        chosen[np.unique(gid, return_index=True)[1]] = True
        chosen &= hot | (size > 2)
        own, _, n = _select(node, head, size, chosen)
        out = pd.concat([pairs, _rows(own, np.zeros(len(own), np.int64), np.repeat(gid[chosen], n))])
        del batch, node, raw, wide, short, own, gid
        release_memory()
        return out

    dealt = rows.mapInPandas(sign, "bucket long, nodes binary, counts binary, sigs binary")
    return dealt.groupBy("bucket").applyInPandas(meet, CANDIDATES)


Near = Callable[[dict[str, np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def linked_components(
    found: DataFrame, nodes: DataFrame, may_link: Callable[[str, str], Column], near: Near, prepare: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame, DataFrame], DataFrame], label: str, weight: str | None = None, refine: Callable[[DataFrame], DataFrame] | None = None,
    split: Callable[[DataFrame, DataFrame], DataFrame] | None = None, carry: bool = False,
) -> DataFrame:
    """(node, component) of all nodes with a verified link.

    ``may_link(x, y)`` is a necessary condition on the columns of ``nodes`` with these suffixes, and ``near`` is the same on arrays: for
    the columns of some nodes it gives the test of pairs of their row numbers. ``prepare(nodes)`` gets
    what the exact comparison needs of some nodes, and ``compare(pairs, prepared)`` keeps the pairs (a, b) that are links. With a column ``weight`` of nodes, pairs of large groups come
    with a column ``place`` of pairs whose nodes, of bounded weight in all, are best looked up together.
    ``refine`` may turn some pairs, with a place or without, away that can't be links. ``split(groups, nodes)`` may deal the members (gid, node, class) of groups to other ones,
    so long as all pairs that ``near`` passes still meet. With ``carry``, for columns of few bytes, the members of groups have those of ``nodes`` too, so that they are joined once.
    """
    return stage_result(lambda: _linked(found, nodes, may_link, near, prepare, compare, label, weight, refine, split, carry), nodes.sparkSession, f"{label}-classes")


def _linked(found: DataFrame, nodes: DataFrame, may_link, near: Near, prepare, compare, label: str, weight: str | None, refine, split, carry: bool) -> DataFrame:
    features = [c for c in nodes.columns if c != "node"]
    a, b = (nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in features)).hint("shuffle_hash") for side in "ab")
    pairs = found.where("gid = 0").select("a", "b").distinct()
    pairs = stage(pairs.join(a, "a").join(b, "b").where(may_link("_a", "_b")).select("a", "b"), f"{label}-pairs", dictionary=False)
    large = stage(found.where("gid <> 0").select("gid", F.col("a").alias("node")).distinct(), f"{label}-groups", dictionary=False)
    links = _compared(pairs if refine is None else stage(refine(pairs), f"{label}-refined"), prepare, compare, label)
    classes = connected_components(links)
    for whole in (False, True):
        groups = _apart(large, classes, nodes if carry else None, label)
        groups = groups if split is None else stage(split(groups, nodes), f"{label}-split", dictionary=False)
        if groups.isEmpty():
            break
        more = _between(groups, nodes, near, whole).groupBy("a", "b").agg(F.min("gid").alias("gid"), F.max("rest").alias("rest"))
        more = stage(more.join(pairs.withColumn("told", F.lit(True)), ["a", "b"], "left"), f"{label}-more", dictionary=False)
        rest = more.agg(F.max("rest")).first()[0]
        more = more.where("told is null").select("a", "b", "gid")
        left = more.select("a", "b") if weight is None else _placed(more, groups, nodes, weight)
        new = _compared(left if refine is None else stage(refine(left), f"{label}-refined"), prepare, compare, label)
        if not new.isEmpty():
            links = links.unionAll(new)
            classes = connected_components(links)
        if not rest:
            break
        pairs, large = pairs.unionAll(more.select("a", "b")), groups.select("gid", "node")
    return classes


def _compared(pairs: DataFrame, prepare, compare, label: str) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    return stage(compare(pairs, prepare(stage(wanted, f"{label}-wanted", dictionary=False))), f"{label}-links", dictionary=False)


def _placed(pairs: DataFrame, apart: DataFrame, nodes: DataFrame, weight: str) -> DataFrame:
    """Pairs (a, b, place): the members of a group are dealt to parts of bounded weight, and a place is a pair of parts, so a node is looked up once for each part that it is compared with, not for each pair."""
    size = apart.join(nodes.select("node", weight), "node").groupBy("gid").agg(F.greatest(F.ceil(F.count("*") / MEMBERS_PER_BLOCK), F.ceil(F.sum(weight) / WEIGHT_PER_PART)).alias("__parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("__parts"))
    return pairs.join(size, "gid").select("a", "b", F.xxhash64("gid", F.least(part("a"), part("b")), F.greatest(part("a"), part("b"))).alias("place"))


def _apart(large: DataFrame, classes: DataFrame, nodes: DataFrame | None, label: str) -> DataFrame:
    """(gid, node, class, count) of the members of groups that hold several components, and columns of ``nodes`` if given."""
    told = large.join(classes.hint("shuffle_hash"), "node", "left").select("gid", "node", F.coalesce("component", "node").alias("class"))
    return stage(several_classes(told if nodes is None else with_columns(told, nodes)), f"{label}-apart", dictionary=False)


def several_classes(groups: DataFrame) -> DataFrame:
    """The members (gid, node, class) of groups that hold several classes, and the group's ``count`` of them."""
    apart = groups.groupBy("gid").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("count")).where("x <> y").select("gid", "count")
    return groups.join(apart.hint("shuffle_hash"), "gid")


def with_columns(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members with the columns of ``nodes`` that they lack."""
    missing = [c for c in nodes.columns if c not in groups.columns]
    return groups.join(nodes.select("node", *missing).hint("shuffle_hash"), "node") if missing else groups


def with_counts(groups: DataFrame) -> DataFrame:
    """Members with the ``count`` of their group, if they lack it."""
    return groups if "count" in groups.columns else groups.join(groups.groupBy("gid").count(), "gid")


def merged(groups: DataFrame) -> DataFrame:
    """Groups (gid, node, class) put together with those that have the same smallest member, by a hash, where that leaves no more pairs to test.

    Sets that share a passage share many signatures, so their groups overlap and a pair would be told by each of them. All pairs that met still meet.
    """
    told = groups.groupBy("gid").agg(F.min(F.xxhash64("node")).alias("lead"), F.count("*").alias("n"))
    size = groups.join(told, "gid").select("lead", "node").distinct().groupBy("lead").agg(F.count("*").alias("all"))
    apart = told.groupBy("lead").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    leads = size.join(apart, "lead").where(F.col("all") * F.col("all") <= F.col("pairs")).select("lead", F.col("lead").alias("to"))
    named = told.join(leads, "lead", "left").select("gid", F.coalesce("to", "gid").alias("to"))
    return groups.join(named, "gid").groupBy(F.col("to").alias("gid"), "node").agg(F.first("class").alias("class"))


def _forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the edges between some nodes make a spanning forest: each tree takes its first edge to another one, until none has any."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    chosen, root, open_ = np.zeros(len(x), bool), np.arange(len(nodes)), np.arange(len(x))
    while len(open_ := open_[root[x[open_]] != root[y[open_]]]):
        first = np.full(len(nodes), len(x))
        for ends in (x, y):
            np.minimum.at(first, root[ends[open_]], open_)
        new = np.unique(first[first < len(x)])
        chosen[new] = True
        p, q = x[new], y[new]
        while (root[p] != root[q]).any():
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, root[p], low)
            np.minimum.at(root, root[q], low)
            while (root[root] != root).any():
                root = root[root]
    return chosen


def _sparse(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Numbers of edges between classes that join all that the edges join: one forest, and further ones of what is left for as long as there are at most so many edges."""
    left, out = np.arange(len(x)), np.zeros(0, np.int64)
    while len(left):
        chosen = _forest(x[left], y[left])
        if len(out) and len(out) + chosen.sum() > most:
            break
        out, left = np.append(out, left[chosen]), left[~chosen]
    return out


def _between(apart: DataFrame, nodes: DataFrame, near: Near, whole: bool) -> DataFrame:
    """Pairs (a, b, gid, rest) of members of one group that are in different classes and near.

    If not the whole is wanted and a run of rows has more pairs than rows, it gives no more pairs than rows, which join what all of its pairs join, and ``rest`` says that some are left.
    """
    dealt = with_columns(with_counts(apart), nodes).withColumn("__blocks", F.ceil(F.col("count") / MEMBERS_PER_BLOCK).cast("int")).withColumn("__block", F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.withColumns({"__low": F.least("__block", "__other"), "__high": F.greatest("__block", "__other")})
    key = ["gid", "__low", "__high"]
    dealt = dealt.drop("count", "__blocks", "__other").repartition(shuffle_partitions(apart.sparkSession), *key).sortWithinPartitions(*key)

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        """Each row with the next, the next but one, and so on, as far as groups reach."""
        run = np.flatnonzero(np.append(True, (rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1]).any(axis=1)))
        left = np.repeat(np.append(run[1:], len(rows)), np.diff(np.append(run, len(rows)))) - np.arange(len(rows)) - 1
        node, kind, block = (rows[c].to_numpy() for c in ("node", "class", "__block"))
        within = (rows["__low"] == rows["__high"]).to_numpy()
        passes = near({c: rows[c].to_numpy() for c in rows.columns})
        at, step, out, waiting, held = np.arange(len(rows)), 0, [], [], 0
        while len(at) or held:
            step += 1
            at = at[left[at] >= step]
            i = at[(kind[at] != kind[at + step]) & (within[at] | (block[at] != block[at + step]))]
            waiting.append((i, i + step))
            held += len(i)
            if held >= PAIRS_PER_STEP or not len(at):
                i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
                good = passes(i, j) if len(i) else np.zeros(0, bool)
                out.append(np.stack([i[good], j[good]]))
                waiting, held = [], 0
        i, j = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        # a pair that meets in several groups of a run counts once
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        order = np.lexsort((b, a))
        fresh = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))] if len(order) else order
        rest = not whole and len(fresh) > len(rows)
        if rest:
            fresh = fresh[_sparse(kind[i[fresh]], kind[j[fresh]], len(rows))]
        return pd.DataFrame({"a": a[fresh], "b": b[fresh], "gid": rows["gid"].to_numpy()[i[fresh]], "rest": rest})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= ROWS_PER_RUN:
                rows = pd.concat(held, ignore_index=True)
                last = rows[key].to_numpy()[-1]
                open_ = (rows[key].to_numpy() == last).all(axis=1)
                if not open_.all():
                    yield test(rows[~open_])
                    held, n = [rows[open_]], int(open_.sum())
        if held:
            yield test(pd.concat(held, ignore_index=True))
        release_memory()

    return dealt.mapInPandas(meet, "a long, b long, gid long, rest boolean")
