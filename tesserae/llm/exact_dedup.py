"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by their length and first bytes, then every group that still has
several members is split by its next bytes, until it is a singleton or its
texts have ended. Members of a group that ended are equal byte for byte; no
digest takes part in that decision. Each round reads eight times as many bytes
as all rounds before it, so a text of n bytes takes log8(n) rounds, and only
rows that still have company move on.

Defined results: a null text counts as empty; null ids are allowed and never
beat a non-null id; of rows that repeat both id and text one stays; an empty
table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, stage, text_or_empty

FIRST_DIGIT = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id with an equal text), group_size, kept, text_sha256."""
    text = ascii_lower(text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("rest"))
    rows = rows.select("doc_id", "rest", F.sha2("rest", 256).alias("text_sha256"), F.octet_length("rest").cast("long").alias("size"))

    groups = (
        rows.groupBy("size", F.substring("rest", 1, FIRST_DIGIT).alias("digit"))
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        .where("group_size > 1")
        .withColumn("gid", F.monotonically_increasing_id())
    )
    groups = stage(groups, "radix-groups-0")
    keyed = rows.withColumn("digit", F.substring("rest", 1, FIRST_DIGIT))
    alone = [keyed.drop("rest").join(groups.hint("shuffle_hash"), ["size", "digit"], "left_anti").select("doc_id", "text_sha256")]
    level = keyed.join(groups.hint("shuffle_hash"), ["size", "digit"])
    level = level.select("doc_id", "text_sha256", "size", "gid", "group_size", "keep_id", _tail(FIRST_DIGIT))
    level = stage(level, "radix-level-0")

    ended, depth, n = [], FIRST_DIGIT, 0
    while True:
        ended.append(level.where(F.col("size") <= depth).select(F.lit(n).alias("round"), "gid", "doc_id", "keep_id", "group_size", "text_sha256"))
        open_ = level.where(F.col("size") > depth)
        if open_.isEmpty():
            break
        width, n = 7 * depth, n + 1
        keyed = open_.select("doc_id", "text_sha256", "size", "rest", F.col("gid").alias("parent"), F.substring("rest", 1, width).alias("digit"))
        groups = (
            keyed.groupBy("parent", "digit")
            .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
            .where("group_size > 1")
            .withColumn("gid", F.monotonically_increasing_id())
        )
        groups = stage(groups, f"radix-groups-{n}")
        alone.append(keyed.drop("rest").join(groups.hint("shuffle_hash"), ["parent", "digit"], "left_anti").select("doc_id", "text_sha256"))
        level = keyed.join(groups.hint("shuffle_hash"), ["parent", "digit"])
        level = stage(level.select("doc_id", "text_sha256", "size", "gid", "group_size", "keep_id", _tail(width)), f"radix-level-{n}")
        depth += width

    single = reduce(DataFrame.unionAll, alone).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # rows that repeat an id within a group are told apart here; the key is never hot unless such repeats are
    repeat = F.row_number().over(Window.partitionBy("round", "gid", "doc_id").orderBy("text_sha256"))
    several = reduce(DataFrame.unionAll, ended).withColumn("repeat", repeat)
    several = several.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"), "text_sha256")
    return single.unionAll(several)


def _tail(width: int):
    return F.substring("rest", width + 1, 2**31 - 1 - width).alias("rest")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS n FROM documents),
     g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)
"""
QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {"op8_exact_dedup": ORACLE}
