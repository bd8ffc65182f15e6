"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[str, str]] = []  # the owner and the path of each staged table that is still there
_owners = [""]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or /tmp on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def stage_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tesserae-staged/{label}-{uuid.uuid4().hex}"
    _staged.append((_owners[-1], path))
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, level: int = 3, dictionary: bool = True) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    What was shuffled for it is of no more use then, so Spark is told to delete those files when the write ends.
    Higher levels of compression take more time and less disk. Columns of which most values differ are written faster without a dictionary.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": level, "parquet.enable.dictionary": dictionary}
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stage_result(build: Callable[[], DataFrame], spark: SparkSession, label: str) -> DataFrame:
    """Stage what ``build`` gives and delete all that was staged on the way to it, as nothing reads that any more."""
    before = len(_staged)
    out = stage(build(), label)
    _delete(spark, _staged[before:-1])
    del _staged[before:-1]
    return out


@contextmanager
def staged_for(owner: str) -> Iterator[None]:
    """Tables staged within are the owner's, for ``clear_staged``."""
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def clear_staged(spark: SparkSession, owner: str = "") -> None:
    """Delete the tables that this owner staged so far. Only for callers that have written every result of the owner that reads them."""
    _delete(spark, [x for x in _staged if x[0] == owner])
    _staged[:] = [x for x in _staged if x[0] != owner]


def _delete(spark: SparkSession, tables: list[tuple[str, str]]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for _, name in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
