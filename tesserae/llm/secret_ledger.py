"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. A blob
is scanned once per rule version, whatever number of paths and versions hold
it; the ledger keeps its findings, none included, and later runs scan only
(blob, rule version) pairs that the ledger lacks. Findings are joined back to all paths.

Defined results: a null text is the empty blob; repeated rows each get the
findings of their blob; an empty history gives an empty result; other columns
of the input play no part. Offsets count code points and ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_memory, small_batches, stage, stage_path, text_or_empty

# The kinds, in order, with their patterns, the group whose length counts and the least length.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")
BASE = ("assign", "access", "hex")
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:12]
FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base_spans string, spans string"

_compiled = [(kind, re.compile(p, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least) for kind, p, group, least in RULES]


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Where the jwt rule matches, in one pass: parts between dots are looked at once, however often a part repeats how a token begins."""
    at = text.find("eyJ")
    for run in DOTTED.finditer(text, _begin(text, at)) if at >= 0 else ():
        parts, place, k = run.group().split("."), run.start(), 0
        while k + 2 < len(parts):
            first = parts[k].find("eyJ")
            if 0 <= first <= len(parts[k]) - 11 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 11 and len(parts[k + 2]) >= 8:
                end = place + sum(map(len, parts[k : k + 3])) + 2
                yield place + first, end
                place, k = end + 1, k + 3
            else:
                place, k = place + len(parts[k]) + 1, k + 1


def _begin(text: str, at: int) -> int:
    """Where the stretch of a token's letters around a place begins."""
    while at and (text[at - 1] == "_" or text[at - 1] == "-" or (text[at - 1].isascii() and text[at - 1].isalnum())):
        at -= 1
    return at


def find_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of every finding, in that order."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(_compiled):
        if kind == "jwt":
            found += [(start, rank, kind, end) for start, end in _tokens(text)]
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for blob, text in zip(batch["blob"], batch["text"], strict=True):
            found = find_spans(text)
            told = [f"{kind}:{start}:{end}" for start, _, kind, end in found]
            base = [t for t, f in zip(told, found, strict=True) if f[2] in BASE]
            rows.append((blob, *(sum(f[2] == k for f in found) for k in BASE), ",".join(base), ",".join(told)))
        yield pd.DataFrame(rows, columns=["blob", "n_assign", "n_access", "n_hex", "base_spans", "spans"])
    release_memory()


def scan_history(history: DataFrame, ledger: str, path_col: str = "path", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Bring the ledger (a Parquet folder) up to date with ``history`` and return path, blob and its findings.

    One row per row of ``history``. The ledger is partitioned by rule version, so a new
    version scans every blob anew and leaves the findings of older ones in place.
    """
    spark = history.sparkSession
    small_batches(spark)
    rows = _placed(history, path_col, text_col)
    blobs = rows.select("path", "at", F.sha2("text", 256).alias("blob"))
    # one row of each unseen blob is scanned; which one is settled by digests and places, so texts move once and aren't sorted
    unseen = blobs.groupBy("blob").agg(F.min("at").alias("at"))
    known = read_ledger(spark, ledger, rule_version)
    if known is not None:
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    scanned = rows.select("at", "text").join(unseen.select("at").hint("shuffle_hash"), "at", "left_semi").select(F.sha2("text", 256).alias("blob"), "text")
    scanned.mapInPandas(_scan, FINDINGS).withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    # Spark takes scans of one folder for the same whenever it was listed, and would reuse an earlier run's findings for this one in
    # a plan that holds both; a condition of the run's own, true of every blob, keeps them apart
    hits = read_ledger(spark, ledger, rule_version).where(F.col("spans") != "").where(F.col("blob") != uuid.uuid4().hex).dropDuplicates(["blob"])
    out = blobs.select("path", "blob").join(hits, "blob", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return out.select("path", "blob", *counts, *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")))


def _placed(history: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, text and a number for the place of each row, the same whenever the table is read. Two rows of one number are both scanned, which changes nothing."""
    rows = [F.col(path_col).alias("path"), text_or_empty(text_col).alias("text")]
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("at")
    try:
        return history.select(*rows, place)
    except AnalysisException:  # not from files
        return stage(history.select(*rows), "ledger-history").select("path", "text", place)


def read_ledger(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame | None:
    """The ledger's rows for one rule version, or None before its first run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{FINDINGS}, rule_version string").parquet(ledger).where(F.col("rule_version") == rule_version).drop("rule_version")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two arrivals on one ledger: the second scans only blobs that the first didn't hold."""
    docs, ledger = spark.read.parquet(f"{sf_dir}/documents.parquet"), stage_path(spark, "ledger")
    arrival = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2, F.lit(0))
    first, second = (scan_history(docs.where(arrival == k), ledger, "doc_id") for k in (0, 1))
    return first.unionAll(second).select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "blob")


QUERIES = {"op7_secret_ledger": op7_secret_ledger}
ORACLES: dict[str, str] = {}
