"""Queries over keyed state in files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.sources.staging import stage, stage_path, stage_result
from tesserae.sources.state_store import StateStore

from . import bridge as B


def saved_sectors(spark, sf_dir):
    """Sectors (customers) and their chunks (orders) put at once; some are replaced by others, some lose a chunk's old row to a new one, some are reset."""

    def build():
        runs = B.table(spark, sf_dir, "customer").selectExpr("c_custkey AS sector", "c_custkey * 4 AS area")
        chunks = B.table(spark, sf_dir, "orders").selectExpr("o_custkey AS sector", "o_orderkey AS key", "o_orderkey % 1000 AS bits").where("sector <= 10000000")
        store = StateStore(spark, stage_path(spark, "store"), {"runs": ("sector",), "chunks": ("sector", "key")}, "sector", buckets=8)
        store.put({"runs": runs, "chunks": chunks})
        again = "sector % 7 = 0"
        store.put({"runs": runs.where(again).withColumn("area", F.col("area") + 1), "chunks": chunks.where(again).where("key % 2 = 0")}, replace=True)
        store.put({"chunks": chunks.where("key % 5 = 0").withColumn("bits", F.col("bits") + 1000)})
        store.delete(runs.where("sector % 11 = 0").select("sector"))
        left = store.read("chunks").groupBy("sector").agg(F.count("*").alias("chunks"), F.sum("bits").alias("bits"))
        return stage(store.read("runs").join(left, "sector", "left").fillna(0, ["chunks", "bits"]), "store-left")

    return stage_result(build, spark, "saved-sectors")


SAVED = """WITH c AS (SELECT o_custkey AS sector, o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 1000 ELSE 0 END + o_orderkey % 1000 AS bits FROM orders WHERE o_custkey % 7 <> 0 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0)
SELECT c_custkey AS sector, c_custkey * 4 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS area, count(key) AS chunks, CAST(coalesce(sum(bits), 0) AS BIGINT) AS bits FROM customer LEFT JOIN c ON sector = c_custkey WHERE c_custkey % 11 <> 0 GROUP BY 1"""

QUERIES = {"saved_sectors": (saved_sectors, SAVED)}
