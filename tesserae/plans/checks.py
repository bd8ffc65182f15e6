"""Queries over validation and identifier expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import checks
from tesserae.functions import frames as f
from tesserae.operators import features

from . import bridge as B
from .grids import PT, s6


def short_ids(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select("c_custkey", checks.fnv1a(F.col("c_name")).alias("hash"))


SHORT = "SELECT c_custkey, list_reduce(list_transform(string_split(c_name, ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296, CAST(2166136261 AS BIGINT)) AS hash FROM customer"


def extents(spark, sf_dir):
    p = B.points(spark, sf_dir)
    e = checks.extent_km(F.col("lon"), F.col("lat"), F.col("lon") + 0.5, F.col("lat") + 0.25, F.col("lat"))
    return p.select("id", f.half_up(e["width_km"], 6).alias("width_km"), f.half_up(e["height_km"], 6).alias("height_km"))


EXTENTS = f"SELECT id, {s6(f'(lon + 0.5 - lon) * {f.DEGREE!r} * 6378137.0 * cos(lat * {f.DEGREE!r}) / 1000')} AS width_km, {s6(f'(lat + 0.25 - lat) * {f.DEGREE!r} * 6378137.0 / 1000')} AS height_km FROM {PT}"


def canonical_tiles(spark, sf_dir):
    p = B.table(spark, sf_dir, "customer")
    return p.select("c_custkey", checks.canonical_tile(F.lit(10), F.col("c_custkey") * 37 - 9000, F.col("c_custkey") % 1024).alias("t")).select("c_custkey", "t.*")


TILES = "SELECT c_custkey, 10 AS z, ((c_custkey * 37 - 9000) % 1024 + 1024) % 1024 AS x, c_custkey % 1024 AS y FROM customer"

def content_fingerprints(spark, sf_dir):
    """The fingerprint of each customer's orders, as texts in order of their keys."""
    texts = B.table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "concat(o_orderpriority, ' ', o_orderkey) AS text")
    return features.content_fingerprints(texts, "o_custkey", "o_orderkey", "text")


def _lane(first, factor):
    return f"printf('%08x', list_reduce(c, lambda h, x: CAST(CAST(xor(h, x) AS HUGEINT) * {factor} % 4294967296 AS BIGINT), CAST({first} AS BIGINT)))"


FINGERPRINTS = f"""WITH t AS (SELECT o_custkey, list(o_orderpriority || ' ' || o_orderkey || chr(1) ORDER BY o_orderkey) AS v FROM orders GROUP BY 1),
  u AS (SELECT o_custkey, list_transform(list_filter(string_split(array_to_string(v, ''), ''), lambda x: x <> ''), lambda x: CASE WHEN x = chr(1) THEN 0 ELSE CAST(unicode(x) AS BIGINT) END) AS c FROM t)
SELECT o_custkey, {' || '.join(_lane(*x) for x in checks.LANES)} AS fingerprint FROM u"""

QUERIES = {"content_fingerprints": (content_fingerprints, FINGERPRINTS), "short_ids": (short_ids, SHORT), "extents": (extents, EXTENTS), "canonical_tiles": (canonical_tiles, TILES)}
