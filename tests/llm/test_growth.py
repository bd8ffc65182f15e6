"""Work of the operators on pairs doesn't grow with the square of chance groups."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import collide, fuzzy_lines, part_enum


def features(n):
    """Lines that all agree on two blocks of little content; every tenth agrees with the line before it."""
    rng = np.random.default_rng(7)
    blocks = rng.integers(0, 1 << fuzzy_lines.BITS, (n, fuzzy_lines.BLOCKS))
    shares = np.full((n, fuzzy_lines.BLOCKS), 50)
    blocks[:, :2], shares[:, :2] = 5, 15
    for k in range(10, n, 10):
        blocks[k] = blocks[k - 1]
        blocks[k, 5] ^= 3
    shares[::17, 0] = 40  # these hold enough of the two blocks
    blocks[::34, 2:] = blocks[0, 2:] ^ (1 << np.arange(len(blocks[::34])) % 20)[:, None]
    return fuzzy_lines.packed(blocks, shares)


def test_a_group_alike_by_chance_is_split_and_no_pair_is_lost(spark):
    n = 400
    low, high, share = features(n)
    nodes = spark.createDataFrame([(k, int(low[k]), int(high[k]), int(share[k]), 100) for k in range(n)], "node long, low long, high long, share long, size int")
    groups = spark.createDataFrame([(8, k, k) for k in range(n)], "gid long, node long, class long")
    passes = fuzzy_lines._near({"low": low, "high": high, "share": share, "size": np.full(n, 100)})
    i, j = np.triu_indices(n, 1)
    good = passes(i, j)
    want = set(zip(i[good].tolist(), j[good].tolist(), strict=True))
    met, tested = set(), 0
    for r in fuzzy_lines._split(groups, nodes).groupBy("gid").agg({"node": "collect_list"}).toDF("gid", "members").collect():
        met |= set(itertools.combinations(sorted(r["members"]), 2))
        tested += len(r["members"]) ** 2
    assert len(want) > 60 and want <= met
    assert tested < n * n / 20


def test_pairs_of_blocks_without_content_are_no_signature():
    low, high, share = features(50)
    size = np.full(50, 200)
    every, kept = (fuzzy_lines.line_signatures(low, high, size, *x) for x in ((), (share,)))
    assert len(kept[0]) == len(every[0])  # 30 of 255 is enough
    thin = share & ~(255 | 255 << 8) | 8 | 8 << 8
    kept = fuzzy_lines.line_signatures(low, high, size, thin)
    assert len(kept[0]) == len(every[0]) - 50  # 16 of 255 is not: with five others alike, two hold at least a third of 51


def test_pairs_of_stars_are_looked_at_by_finer_sketches_before_sets_are_sent(spark, monkeypatch):
    """Long texts that share a passage and don't link: no pair of them comes to the exact comparison; the pair that links does."""
    rng, words = np.random.default_rng(3), lambda tag, n: [f"{tag}{k}" for k in range(n)]
    texts = [" ".join(words("same", 2600) + words(f"own{k}x", 900)) for k in range(6)]
    texts.append(texts[2] + " end")
    compared, real = [], part_enum._verified
    monkeypatch.setattr(part_enum, "_verified", lambda pairs, *rest: compared.append(pairs.count()) or real(pairs, *rest))
    docs = spark.createDataFrame([(k, texts[k]) for k in rng.permutation(7).tolist()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in part_enum.part_enum_components(docs).collect()}
    assert got == {k: 2 if k == 6 else k for k in range(7)} and compared[0] == 1


def test_finer_sketches_of_stars_keep_what_those_of_places_keep(spark):
    rng = np.random.default_rng(15)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(base, 3000 - int(rng.choice([20, 300, 500])), replace=False)) for _ in range(20)]
    sets[3] = sets[3][:100]  # too short for a finer one
    words = part_enum.parity_sketches(np.concatenate(sets), np.array([len(s) for s in sets]), part_enum.FINE_WORDS)
    fine = spark.createDataFrame([(n, len(s), bytearray(w.tobytes())) for n, (s, w) in enumerate(zip(sets, words, strict=True)) if len(s) > 256], "node long, n long, fine binary")
    pairs = spark.createDataFrame([(a, b, 7) for a in range(20) for b in range(a + 1, 20)], "a long, b long, place long")
    kept = [sorted((r["a"], r["b"]) for r in df.collect()) for df in (part_enum._finer(pairs, fine, 80, 100), part_enum._finer_stars(pairs.drop("place"), fine, 80, 100))]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 190


def test_a_group_of_near_members_gives_no_more_pairs_than_members_at_first(spark):
    n = 300
    nodes = spark.range(n).select(F.col("id").alias("node"))
    groups = spark.createDataFrame([(g, k, k) for g in (3, 4) for k in range(n)], "gid long, node long, class long")

    def near(told):
        return lambda i, j: told["node"][i] % 3 == told["node"][j] % 3  # three sets, in which all are near

    first, every = ({(r["a"], r["b"]): r["rest"] for r in collide._between(groups, nodes, near, whole).collect()} for whole in (False, True))
    assert set(every) == {(a, b) for a, b in itertools.combinations(range(n), 2) if a % 3 == b % 3} and not any(every.values())
    assert set(first) < set(every) and len(first) <= 2 * n and all(first.values())
    root = list(range(n))
    for a, b in sorted(first):
        root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root)) == 3


def test_links_that_the_first_pairs_miss_are_found(spark):
    """All members of a group are near, but only those of neighbouring numbers link."""
    n = 60
    groups = spark.createDataFrame([(k, 0, 8) for k in range(n)], "a long, b long, gid long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    near = lambda told: lambda i, j: np.ones(len(i), bool)
    got = collide.linked_components(groups, nodes, lambda x, y: F.lit(True), near, lambda wanted: wanted, lambda pairs, _: pairs.where("b = a + 1 and b % 20 <> 0"), "test").collect()
    assert {r["node"]: r["component"] for r in got} == {k: k - k % 20 for k in range(n)}


def test_few_pairs_take_one_look(spark, monkeypatch):
    looks, real = [], collide._between
    monkeypatch.setattr(collide, "_between", lambda *args: looks.append(args[-1]) or real(*args))
    groups = spark.createDataFrame([(k, 0, 8) for k in range(40)], "a long, b long, gid long")
    near = lambda told: lambda i, j: told["node"][i] // 2 == told["node"][j] // 2
    got = collide.linked_components(groups, spark.range(40).toDF("node"), lambda x, y: F.lit(True), near, lambda wanted: wanted, lambda pairs, _: pairs, "test").collect()
    assert {r["node"]: r["component"] for r in got} == {k: k - k % 2 for k in range(40)} and looks == [False]


def test_groups_that_overlap_are_put_together_and_no_pair_is_lost(spark):
    """Forty groups of nearly the same members, and chance groups of one member that would be larger together than apart."""
    rng = np.random.default_rng(21)
    members = {g: sorted(rng.choice(60, 55, replace=False).tolist()) for g in range(2, 42)}
    members |= {g: [1000, *range(g * 100, g * 100 + 3)] for g in range(50, 90)}
    groups = spark.createDataFrame([(g, k, k % 7) for g, own in members.items() for k in own], "gid long, node long, class long")
    got = {}
    for r in collide.merged(groups).collect():
        assert r["class"] == r["node"] % 7
        got.setdefault(r["gid"], []).append(r["node"])
    met = lambda groups: {p for own in groups for p in itertools.combinations(sorted(own), 2)}
    assert all(len(own) == len(set(own)) for own in got.values()) and met(members.values()) <= met(got.values())
    assert sum(map(len, got.values())) < 0.4 * groups.count() and sum(len(own) ** 2 for own in got.values()) <= sum(len(own) ** 2 for own in members.values())


def test_sketches_of_long_sets_turn_away_what_shares_a_passage():
    rng, draw = np.random.default_rng(22), lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    sizes, passage = [1500, 3000, 5000, 9000, 15000], draw(500)
    sets = [np.unique(np.append(passage, draw(n - 500))) for n in sizes for _ in range(2)]
    sets += [np.unique(np.append(x[: -len(x) // 20], draw(len(x) // 20))) for x in sets]  # each with one that links
    n = np.array([len(x) for x in sets])
    sketches = part_enum.parity_sketches(np.concatenate(sets), n)
    told = np.empty(len(n), object)
    told[:] = sketches
    passes = part_enum._near({"n": n, "sketch": told}, 80, 100)
    k = np.arange(10)
    assert passes(k, k + 10).all() and not passes(k[::2], k[1::2]).any()
    assert max(map(len, sketches)) <= part_enum.LONG_WORDS and max(len(s) for s, m in zip(sketches, n, strict=True) if m < 2048) <= 16


def test_members_of_groups_keep_the_columns_and_counts_that_they_bring(spark):
    n = 200
    low, high, share = features(n)
    nodes = spark.createDataFrame([(k, int(low[k]), int(high[k]), int(share[k]), 100) for k in range(n)], "node long, low long, high long, share long, size int")
    groups = spark.createDataFrame([(g, k, k) for g, own in ((8, range(n)), (10, range(20, 40))) for k in own], "gid long, node long, class long")
    dealt = fuzzy_lines._split(groups, nodes).cache()
    sizes = {r["gid"]: r["count"] for r in dealt.groupBy("gid").count().collect()}
    told = {k: (int(low[k]), int(high[k]), int(share[k]), 100) for k in range(n)}
    rows = dealt.collect()
    assert all(r["count"] == sizes[r["gid"]] and told[r["node"]] == (r["low"], r["high"], r["share"], r["size"]) for r in rows) and sizes[10] == 20
    pairs = lambda groups: {(r["a"], r["b"]) for r in collide._between(groups, nodes, fuzzy_lines._near, True).collect()}
    assert pairs(dealt) == pairs(groups) != set()


def test_signatures_come_in_order_with_the_nodes_of_each_in_order():
    rng = np.random.default_rng(23)
    for n in (0, 1, 2, 5000):
        sig, node = rng.integers(0, 900, n).astype(np.uint64), rng.integers(0, 40, n)
        want = sorted(set(zip(sig.tolist(), node.tolist(), strict=True)))
        s, k, head, size = collide._sorted_groups(sig, node)
        assert list(zip(s.tolist(), k.tolist(), strict=True)) == want and size.sum() == len(want) and (s[head] == np.unique(sig)).all()
