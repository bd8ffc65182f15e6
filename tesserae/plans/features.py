"""Queries over the driver's tables for grouping, ranking, graph and tag operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import runs, tags
from tesserae.operators import cells, features, graph, spatial_join

from . import bridge as B


def latest_version(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_extendedprice")
    return features.latest(li, ["l_partkey", "l_suppkey"], "l_linenumber", F.struct("l_orderkey", "l_extendedprice"))


LATEST = "SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber DESC, l_orderkey, l_extendedprice) = 1"


def geometry_dedupe(spark, sf_dir):
    """Of parts with equal footprints (size and height), relations before ways, then the smallest id."""
    p = B.rects(spark, sf_dir).select("id", "w", "h", (F.col("cx") % 100).alias("place"), F.when(F.col("id") % 3 == 0, 0).otherwise(1).alias("kind"))
    return features.first_of(p, ["w", "h", "place"], F.col("kind"), F.col("id"))


DEDUPE = f"SELECT id, w, h, place, kind FROM (SELECT id, w, h, cx % 100 AS place, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS kind FROM ({B.RECTS})) QUALIFY row_number() OVER (PARTITION BY w, h, place ORDER BY kind, id) = 1"

TAGS = "map_from_arrays(array('highway','waterway','natural','landuse','leisure','building','height','building:levels'), array({}))"
VALUES = {
    "highway": "CASE WHEN k % 7 = 0 THEN 'primary' WHEN k % 7 = 1 THEN 'no' END",
    "waterway": "CASE WHEN k % 11 = 0 THEN 'river' END",
    "natural": "CASE k % 5 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' WHEN 2 THEN 'heath' END",
    "landuse": "CASE k % 6 WHEN 0 THEN 'basin' WHEN 1 THEN 'forest' WHEN 2 THEN 'retail' END",
    "leisure": "CASE WHEN k % 4 = 0 THEN 'park' END",
    "building": "CASE WHEN k % 13 = 0 THEN 'yes' END",
    "height": "CASE k % 8 WHEN 0 THEN (k % 90) || ' m' WHEN 1 THEN (k % 90) || ',5' WHEN 2 THEN (k % 90) || 'ft' WHEN 3 THEN 'tall' WHEN 4 THEN '5000' END",
    "building:levels": "CASE WHEN k % 3 = 0 THEN CAST(k % 600 AS STRING) END",
}


def _tagged(spark, sf_dir):
    keys = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    made = keys.select("k", F.expr(TAGS.format(", ".join(VALUES.values()))).alias("tags"))
    return made.select("k", tags.sanitized(F.col("tags")).alias("tags"))


V = "(SELECT p_partkey AS k FROM part) p, LATERAL (SELECT " + ", ".join(f'{v.replace("STRING", "VARCHAR")} AS "{n}"' for n, v in VALUES.items()) + ") v"


def classify_background(spark, sf_dir):
    return _tagged(spark, sf_dir).select("k", tags.background_kind(F.col("tags")).alias("b")).select("k", "b.kind_group", "b.kind")


CLASSIFY = f"""WITH c AS (SELECT k, CASE WHEN building = 'yes' THEN NULL WHEN highway = 'primary' THEN 'roads:primary' WHEN waterway IS NOT NULL THEN 'water:' || waterway WHEN "natural" = 'water' THEN 'water:water'
  WHEN landuse = 'basin' THEN 'water:basin' WHEN "natural" IN ('wood', 'heath') THEN 'parks:' || "natural" WHEN landuse = 'forest' THEN 'parks:forest' WHEN leisure = 'park' THEN 'parks:park' END AS x FROM {V})
SELECT k, split_part(x, ':', 1) AS kind_group, split_part(x, ':', 2) AS kind FROM c WHERE x IS NOT NULL UNION ALL SELECT k, NULL, NULL FROM c WHERE x IS NULL"""


def height_from_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select("k", tags.building_height(F.col("tags")).alias("height"))


HEIGHT = f"""WITH h AS (SELECT k, regexp_extract(height, '^([0-9]+([,][0-9]+)?)', 1) AS n, height, CAST("building:levels" AS DOUBLE) AS l FROM {V}),
  m AS (SELECT k, CASE WHEN n <> '' THEN CAST(replace(n, ',', '.') AS DOUBLE) * (CASE WHEN height LIKE '%ft' THEN 0.3048 ELSE 1.0 END) END AS m, l FROM h)
SELECT k, CASE WHEN m > 0 AND m < 2000 THEN m WHEN l > 0 AND l < 500 THEN l * 3 END AS height FROM m"""


def background_counts(spark, sf_dir):
    b = _tagged(spark, sf_dir).select(tags.background_kind(F.col("tags")).alias("b"))
    return b.groupBy(F.coalesce("b.kind_group", F.lit("none")).alias("kind_group")).agg(F.count("*").alias("n"))


def render_attributes(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 > 0 THEN p_size * 1.0D - 3 END").alias("h"), F.expr("CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 9 * 1.0D END").alias("m"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN '#AbC' WHEN 1 THEN ' Red ' WHEN 2 THEN '#12345' END").alias("c"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END").alias("hide"))
    return p.select("p_partkey", tags.render_attributes(F.col("h"), F.col("m"), F.col("c"), F.col("hide")).alias("r")).select("p_partkey", "r.*")


RENDER = """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_size * 1.0 - 3 END AS h, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 9 AS DOUBLE) END AS m, p_partkey AS k FROM part),
  v AS (SELECT *, coalesce(h > 0 AND h <= 3660, false) AND (m IS NULL OR coalesce(m >= 0 AND m < h, false)) AS ok FROM p)
SELECT p_partkey, CAST(CASE WHEN ok THEN h END AS DOUBLE) AS height, CASE WHEN ok THEN coalesce(m, 0.0) END AS min_height, CASE k % 4 WHEN 0 THEN '#aabbcc' WHEN 1 THEN 'red' END AS colour, k % 3 = 0 AS hide_3d,
  CASE WHEN ok THEN 'source-approximation' WHEN h IS NULL THEN 'missing' ELSE 'invalid' END AS height_provenance, CASE WHEN m IS NULL THEN 'ground-fallback' WHEN ok THEN 'source-approximation' ELSE 'invalid' END AS min_height_provenance FROM v"""


def chunk_index(spark, sf_dir):
    b = B.rects(spark, sf_dir).selectExpr("cx AS x", "cy AS y", "4 * w * h AS area", "cx - w AS min_x", "cy - h AS min_y", "cx + w AS max_x", "cy + h AS max_y")
    return features.chunk_index(b, 300.0, 3000.0, 10)


CHUNK = f"""SELECT CAST(least(9, greatest(0, floor((cx + 1500 + 1e-6) / 300))) AS BIGINT) || '-' || CAST(least(9, greatest(0, floor((cy + 1500 + 1e-6) / 300))) AS BIGINT) AS chunk_id, count(*) AS building_count, sum(4 * w * h) AS area,
  min(cx - w) AS min_x, min(cy - h) AS min_y, max(cx + w) AS max_x, max(cy + h) AS max_y FROM ({B.RECTS}) GROUP BY 1"""


def best_record(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("level"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 7919 % 1000).alias("elapsed"), (F.col("o_orderkey") * 31 % 500).alias("score"))
    return features.merge_best(o, "level", "seq")


BEST = """WITH r AS (SELECT o_custkey AS level, o_orderkey AS seq, o_orderkey * 7919 % 1000 AS elapsed, o_orderkey * 31 % 500 AS score FROM orders),
  m AS (SELECT level, min(elapsed) AS elapsed FROM r GROUP BY level), f AS (SELECT level, elapsed, min(seq) AS seq FROM r JOIN m USING (level, elapsed) GROUP BY level, elapsed)
SELECT f.level, f.elapsed, max(r.score) AS score FROM f JOIN r ON r.level = f.level AND r.seq >= f.seq GROUP BY f.level, f.elapsed"""


def progress_upsert(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").selectExpr("o_custkey % 300 AS sector_id", "o_orderpriority AS version", "o_orderstatus = 'F' AS completed", "o_orderkey * 4 % 10000 AS consumed_area")
    return features.progress_upsert(o, ["sector_id", "version"])


def campaign_summary(spark, sf_dir):
    s = B.table(spark, sf_dir, "customer").selectExpr("c_nationkey AS campaign_id", "c_custkey AS sector_id")
    p = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sector_id")).agg(
        F.bool_or(F.col("o_orderstatus") == "F").alias("completed"), F.max(F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 1000 * 1.0D END")).alias("total_area"), F.max(F.expr("o_orderkey % 1500 - 200")).alias("consumed_area")
    )
    return features.campaign_summary(s, p)


SUMMARY = """WITH p AS (SELECT o_custkey AS sector_id, bool_or(o_orderstatus = 'F') AS completed, max(CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END) AS total_area, max(o_orderkey % 1500 - 200) AS consumed_area FROM orders GROUP BY 1),
  j AS (SELECT c_nationkey AS campaign_id, p.* FROM customer LEFT JOIN p ON c_custkey = sector_id),
  a AS (SELECT campaign_id, count(*) FILTER (completed) AS completed, count(*) AS total, count(total_area) AS prepared, coalesce(sum(CASE WHEN total_area IS NOT NULL THEN least(total_area, greatest(0.0, CAST(consumed_area AS DOUBLE))) END), 0.0) AS consumed_area, coalesce(sum(total_area), 0.0) AS known_area FROM j GROUP BY 1)
SELECT *, completed / total * 100 AS completion_percent, CASE WHEN known_area > 0 THEN consumed_area / known_area * 100 ELSE 0.0 END AS known_percent FROM a"""


def name_search_topk(spark, sf_dir):
    places = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), features.folded("s_name").alias("name"), F.floor("s_acctbal").alias("population"))
    return features.name_search(places.withColumn("search_text", F.col("name")), "Súpplier#0000000").select("id", "name", "population")


SEARCH = "SELECT s_suppkey AS id, lower(s_name) AS name, CAST(floor(s_acctbal) AS BIGINT) AS population FROM supplier WHERE lower(s_name) LIKE '%supplier#0000000%' ORDER BY floor(s_acctbal) DESC, s_suppkey LIMIT 7"


def boundary_rank(spark, sf_dir):
    a = B.table(spark, sf_dir, "customer").selectExpr("c_nationkey", "c_custkey AS id", "c_mktsegment = 'BUILDING' AS hit", "0.0D AS west", "0.0D AS south", "c_custkey * 7919 % 97 * 1.0D AS east", "c_custkey * 31 % 11 + 1.0D AS north")
    return features.boundary_rank(a, "c_nationkey", "hit").select("c_nationkey", "id", "ordinal")


RANK = "SELECT c_nationkey, c_custkey AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, (c_custkey * 7919 % 97) * (c_custkey * 31 % 11 + 1), c_custkey) AS INTEGER) AS ordinal FROM customer"


def _intervals(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS k", "l_orderkey * 37 % 5000 * 1.0D AS lo", "l_orderkey * 37 % 5000 + l_linenumber * 1.0D AS hi")


IV = "SELECT l_suppkey AS k, CAST(l_orderkey * 37 % 5000 AS DOUBLE) AS lo, CAST(l_orderkey * 37 % 5000 + l_linenumber AS DOUBLE) AS hi FROM lineitem"


def interval_cover(spark, sf_dir):
    return cells.interval_cover(_intervals(spark, sf_dir), "k", "lo", "hi").groupBy("k").agg(F.count("*").alias("islands"), F.sum(F.col("hi") - F.col("lo")).alias("covered"))


COVER = f"""WITH i AS ({IV}), w AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-10 THEN 1 ELSE 0 END AS s FROM i),
  g AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM w), m AS (SELECT k, g, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, g)
SELECT k, count(*) AS islands, sum(hi - lo) AS covered FROM m GROUP BY k"""


def interval_overlap(spark, sf_dir):
    o = B.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "named_struct('lo', l_linenumber * 3.0D, 'hi', l_linenumber * 3.0D + l_partkey % 5) AS a", "named_struct('lo', l_linenumber * 2.0D, 'hi', l_linenumber * 2.0D + l_suppkey % 4) AS b")
    per = o.groupBy("l_orderkey").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return per.select("l_orderkey", F.aggregate(cells.interval_overlaps(F.col("a"), F.col("b")), F.lit(0.0), lambda s, i: s + i["hi"] - i["lo"]).alias("overlap"))


OVERLAP = """WITH a AS (SELECT l_orderkey AS k, l_linenumber * 3.0 AS lo, l_linenumber * 3.0 + l_partkey % 5 AS hi FROM lineitem), b AS (SELECT l_orderkey AS k, l_linenumber * 2.0 AS lo, l_linenumber * 2.0 + l_suppkey % 4 AS hi FROM lineitem)
SELECT a.k AS l_orderkey, CAST(sum(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo))) AS DOUBLE) AS overlap FROM a JOIN b ON a.k = b.k GROUP BY 1"""


def endpoint_parity(spark, sf_dir):
    """Orders as relations whose lines are members: complete if every end occurs an even number of times."""
    line = "array(named_struct('lon', l_partkey % 2 * 1.0D, 'lat', 0.0D), named_struct('lon', 9.0D, 'lat', 9.0D), named_struct('lon', l_suppkey % 2 * 1.0D, 'lat', 0.0D), IF(l_partkey % 2 = l_suppkey % 2, named_struct('lon', l_suppkey % 2 * 1.0D, 'lat', 0.0D), named_struct('lon', l_suppkey % 2 * 1.0D, 'lat', 0.0D)))"
    m = B.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS rel", "IF(l_linenumber = 7, 'node', 'way') AS type", "IF(l_returnflag = 'R', 'inner', 'outer') AS role", f"{line} AS line")
    return features.complete_relations(m)


PARITY = """WITH m AS (SELECT l_orderkey AS rel, l_linenumber <> 7 AS ok, CASE WHEN l_returnflag = 'R' THEN 'inner' ELSE 'outer' END AS role, l_partkey % 2 AS a, l_suppkey % 2 AS b FROM lineitem),
  e AS (SELECT rel, role, a AS e FROM m WHERE ok AND a <> b UNION ALL SELECT rel, role, b FROM m WHERE ok AND a <> b), o AS (SELECT DISTINCT rel FROM (SELECT rel, role, e FROM e GROUP BY ALL HAVING count(*) % 2 = 1))
SELECT m.rel, bool_and(ok) AND count(*) FILTER (role = 'outer') > 0 AND NOT bool_or(o.rel IS NOT NULL) AS complete FROM m LEFT JOIN o ON o.rel = m.rel GROUP BY m.rel"""


def components(spark, sf_dir):
    """Parts and suppliers of all lines as a graph, and orders with their customers as others."""
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10_000_000).alias("b"))
    orders = B.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("a"), (F.col("o_custkey") + 20_000_000).alias("b"))
    return graph.connected_components(lines.unionAll(orders))


# every node takes the smallest number among its neighbours' until none changes
COMPONENTS = """WITH RECURSIVE e AS MATERIALIZED (SELECT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem UNION SELECT o_orderkey + 1000000000, o_custkey + 20000000 FROM orders), g AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
  c(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM g GROUP BY a
    UNION SELECT n.node, n.component FROM (SELECT g.a AS node, min(c.component) AS component FROM c JOIN g ON g.b = c.node GROUP BY 1) n JOIN recurring.c AS r ON r.node = n.node WHERE n.component < r.component)
SELECT node, component FROM c"""


def snapshot_diff(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    before, after = o.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus"), o.where("o_orderkey % 7 <> 0").selectExpr("o_orderkey", "IF(o_orderkey % 11 = 0, 'X', o_orderstatus) AS o_orderstatus")
    return spatial_join.snapshot_diff(before, after, "o_orderkey", "o_orderstatus")


DIFF = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AND o_orderstatus <> 'X')"


def way_join(spark, sf_dir):
    """Orders as ways over line numbers as nodes; some nodes are missing."""
    li = B.table(spark, sf_dir, "lineitem")
    ways = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("nodes"))
    nodes = B.table(spark, sf_dir, "part").where("p_size > 3").selectExpr("p_partkey AS id", "p_size * 1.0D AS lon", "p_partkey * 1.0D AS lat")
    return features.way_lines(ways, nodes).select("id", F.col("line").isNotNull().alias("whole"), F.coalesce(F.aggregate("line", F.lit(0.0), lambda s, p: s * 0.5 + p["lat"]), F.lit(0.0)).alias("mark"))


WAYS = """WITH n AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_partkey) AS ns, bool_and(p_size > 3) AS whole FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT id, whole, CASE WHEN whole THEN list_reduce(list_transform(ns, lambda x: CAST(x AS DOUBLE)), lambda s, x: s * 0.5 + x, 0.0) ELSE 0.0 END AS mark FROM n"""


def suppressed_members(spark, sf_dir):
    """Parts (as ways) that are no member of an urgent order (as relation)."""
    urgent = B.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderpriority = '1-URGENT' AS counts")
    members = B.table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey").select(F.col("l_partkey").alias("id"), "counts")
    return features.without_members(B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), members).withColumnRenamed("id", "p_partkey")


SUPPRESSED = "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')"


def budget_pick(spark, sf_dir):
    """Greedy choice of parts for each brand: cheapest ids first, within a budget of sizes, 20 at most."""
    p = B.table(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey", "p_size")
    return features.take_within_budget(p, "p_brand", ["p_partkey"], "p_size", 200, 20)


PICK = """WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
  r AS (SELECT p_brand, p_partkey, p_size, n, CASE WHEN p_size <= 200 THEN 200 - p_size ELSE 200 END AS room, CASE WHEN p_size <= 200 THEN 1 ELSE 0 END AS taken, p_size <= 200 AS hit FROM o WHERE n = 1
    UNION ALL SELECT o.p_brand, o.p_partkey, o.p_size, o.n, CASE WHEN r.taken < 20 AND o.p_size <= r.room THEN r.room - o.p_size ELSE r.room END, CASE WHEN r.taken < 20 AND o.p_size <= r.room THEN r.taken + 1 ELSE r.taken END, r.taken < 20 AND o.p_size <= r.room
    FROM r JOIN o ON o.p_brand = r.p_brand AND o.n = r.n + 1)
SELECT p_brand, p_partkey, p_size FROM r WHERE hit"""


def once_only_reward(spark, sf_dir):
    """Each part is rewarded once per order customer, however often it was ordered."""
    taken = B.table(spark, sf_dir, "lineitem").join(B.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("run"), F.col("l_partkey").alias("id"))
    return features.rewards(taken, B.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_size AS BIGINT) * 4 AS area")).select(F.col("run").alias("o_custkey"), "area", F.col("rewarded").alias("parts"))


ONCE = "SELECT o_custkey, CAST(sum(p_size * 4) AS BIGINT) AS area, count(*) AS parts FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN part ON l_partkey = p_partkey GROUP BY 1"


def sector_totals(spark, sf_dir):
    """Totals and class of each nation's suppliers, and of each brand, as sectors; some nations have none here."""
    p = B.table(spark, sf_dir, "part").selectExpr("p_brand AS sector", "CAST(p_size AS DOUBLE) AS radius", "CAST(p_size AS BIGINT) * 4 AS area")
    s = B.table(spark, sf_dir, "supplier").selectExpr("concat('nation ', s_nationkey) AS sector", "10.0D + s_suppkey % 30 AS radius", "CAST(s_suppkey % 30 AS BIGINT) * 4 AS area")
    every = B.table(spark, sf_dir, "part").selectExpr("p_brand AS sector").unionAll(B.table(spark, sf_dir, "nation").selectExpr("concat('nation ', n_nationkey) AS sector")).distinct()
    return features.sector_totals(every, p.unionAll(s), "sector")


TOTALS = """WITH b AS (SELECT p_brand AS sector, CAST(p_size AS DOUBLE) AS radius, p_size * 4 AS area FROM part UNION ALL SELECT 'nation ' || s_nationkey, 10.0 + s_suppkey % 30, s_suppkey % 30 * 4 FROM supplier),
  e AS (SELECT DISTINCT p_brand AS sector FROM part UNION SELECT 'nation ' || n_nationkey FROM nation),
  t AS (SELECT e.sector, count(b.radius) AS buildings, CAST(coalesce(sum(area), 0) AS BIGINT) AS area, CAST(min(radius) AS DOUBLE) AS least_radius, count(*) FILTER (radius <= 18 * 1.06) AS edible FROM e LEFT JOIN b ON b.sector = e.sector GROUP BY 1)
SELECT *, CAST(ceil(least_radius / 1.06 + 1) AS DOUBLE) AS suggested_radius, CASE WHEN buildings = 0 THEN 'empty' WHEN buildings < 100 THEN 'sparse' ELSE 'ready' END AS suitability FROM t"""


def goal_progress(spark, sf_dir):
    a = B.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey * 4 % 12000000 AS area", "o_custkey * 4 + 4 AS total")
    goal = runs.auto_goal(F.col("total")).cast("long")
    return a.select("o_orderkey", goal.alias("goal"), runs.goal_percent(F.col("area"), goal).alias("percent"), runs.milestone_count(F.col("area")).cast("long").alias("milestones"))


GOAL = """WITH a AS (SELECT o_orderkey, o_orderkey * 4 % 12000000 AS area, o_custkey * 4 + 4 AS t FROM orders), g AS (SELECT *, CAST(greatest(4, least(100000, t, CASE WHEN 100000 <= t * 0.05 THEN 100000 WHEN 10000 <= t * 0.05 THEN 10000 WHEN 1000 <= t * 0.05 THEN 1000 WHEN 100 <= t * 0.05 THEN 100 ELSE least(100, t) // 4 * 4 END)) AS BIGINT) AS goal FROM a)
SELECT o_orderkey, goal, least(100.0, area / goal * 100) AS percent, CAST(len(list_filter([10000, 50000, 100000, 500000, 1000000, 2500000, 5000000], lambda m: area >= m)) + greatest(0, area // 5000000 - 1) AS BIGINT) AS milestones FROM g"""


def html_escape(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", F.md5(tags.html_escaped(F.col("html"))).alias("escaped_md5"))


def content_digest(spark, sf_dir):
    """One digest of each customer's orders as canonical JSON, whatever order they are read in."""
    o = B.table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus").alias("item"))
    return features.content_digest(o, "o_custkey", "item")


DIGEST = """SELECT o_custkey, sha256('[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey, o_orderstatus) || ']') AS digest FROM orders GROUP BY 1"""

QUERIES = {
    "latest_version": (latest_version, LATEST),
    "geometry_dedupe": (geometry_dedupe, DEDUPE),
    "classify_background": (classify_background, CLASSIFY),
    "height_from_tags": (height_from_tags, HEIGHT),
    "background_counts": (background_counts, f"SELECT coalesce(kind_group, 'none') AS kind_group, count(*) AS n FROM ({CLASSIFY}) GROUP BY 1"),
    "render_attributes": (render_attributes, RENDER),
    "chunk_index": (chunk_index, CHUNK),
    "best_record": (best_record, BEST),
    "progress_upsert": (progress_upsert, "SELECT o_custkey % 300 AS sector_id, o_orderpriority AS version, bool_or(o_orderstatus = 'F') AS completed, max(o_orderkey * 4 % 10000) AS consumed_area FROM orders GROUP BY 1, 2"),
    "campaign_summary": (campaign_summary, SUMMARY),
    "name_search_topk": (name_search_topk, SEARCH),
    "boundary_rank": (boundary_rank, RANK),
    "interval_cover": (interval_cover, COVER),
    "interval_overlap": (interval_overlap, OVERLAP),
    "endpoint_parity": (endpoint_parity, PARITY),
    "components": (components, COMPONENTS),
    "snapshot_diff": (snapshot_diff, DIFF),
    "way_join": (way_join, WAYS),
    "suppressed_members": (suppressed_members, SUPPRESSED),
    "budget_pick": (budget_pick, PICK),
    "once_only_reward": (once_only_reward, ONCE),
    "sector_totals": (sector_totals, TOTALS),
    "goal_progress": (goal_progress, GOAL),
    "html_escape": (html_escape, "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages"),
    "content_digest": (content_digest, DIGEST),
}
