"""A corpus pipeline: language ID, line dedup, near duplicates, mixing, packing.

Each stage gets the documents its predecessor kept and returns documents, the
last one the pieces of packed sequences. ``run`` writes each stage's result as
Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import fuzzy_lines, lang_id, mixing, packing, part_enum
from tesserae.llm.common import clear_staged, stage_path, staged_for, text_or_empty

#: Sources are mixed in proportion to their size to this power, both in order and in every window.
EXPONENT = 0.7
OWNER = "pipeline"


def _inner(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered column names, so that no column of the input can clash with one of a stage, and the numbered name of each."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(k) for c, k in names.items())), names


def _owned(stage):
    """A stage whose staged tables are the pipeline's; those of the stages before go, as their results have been written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_staged(spark, OWNER)
        with staged_for(OWNER):
            return stage(spark, docs, sf_dir)

    return run_stage


def _outer(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*(F.col(k).alias(c) for c, k in names.items()))


@_owned
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language and writes the predicted one into lang.

    Learns from the labelled documents that op2 learns from.

    Defined results: documents whose text is null or has no letter go; null labels aren't learnt from; without any label, all go; repeated
    rows stay or go together; an empty table stays empty; long texts are read whole; further columns stay as they are, whatever their names.
    """
    model = lang_id.learn_prototypes(docs.where(~lang_id.held_out()))
    rows, names = _inner(docs)
    told = lang_id.predict(rows, *model, text_col=names["text"], keep=rows.columns).where(F.col("lang_pred") != lang_id.UNKNOWN)
    return _outer(told.withColumn(names["lang"], F.col("lang_pred")), names)


@_owned
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of lines; documents of which nothing is left go.

    Defined results: null and empty texts have no line to lose and stay; blank lines stay; rows that repeat id and text keep the same lines; of
    equal lines the one with the smallest id and number stays; n_chars is counted anew where lines went; an empty table stays empty; further columns stay as they are.
    """
    rows, names = _inner(docs)
    text, size = names["text"], names["n_chars"]
    out = fuzzy_lines.fuzzy_line_dedup(rows, names["doc_id"], text).where((F.col("n_dropped") == 0) | (F.trim(text_or_empty(text)) != ""))
    return _outer(out.withColumn(size, F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col(size)).cast(docs.schema["n_chars"].dataType)), names)


@_owned
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near duplicates, the document with the smallest id stays.

    Defined results: documents without a word (null, empty or blank texts) are in no group and stay; rows that repeat an id are one document, which
    stays or goes; rows with a null id stay; an empty table stays empty; long texts are read whole; further columns stay as they are.
    """
    found = part_enum.part_enum_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    rows, names = _inner(docs)
    return _outer(rows.join(found.hint("shuffle_hash"), F.col(names["doc_id"]) == F.col("doc_id"), "left_anti"), names)


@_owned
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture.

    Defined results: null sources are one source; null and empty texts are documents like others; repeated rows each have a place of their own; documents of one
    source are in order of a hash of their id, then the id; an empty table stays empty; further columns stay as they are.
    """
    return mixing.in_mixed_order(docs, exponent=EXPONENT)


@_owned
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, each window to the targets of the mixture; queues follow the order of the rows.

    Defined results: null and empty texts yield their end token; null sources are one queue; repeated rows are packed as often as they occur; an empty table
    gives no pieces; long texts are packed whole; further columns play no part.
    """
    return packing.pack(docs, exponent=EXPONENT)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
#: Models, SimHashes, signatures and token streams have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with staged_for(f"{OWNER} {k}"):
            path = stage_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_staged(spark, OWNER)
        clear_staged(spark, f"{OWNER} {k - 1}")
        docs = spark.read.parquet(path)
    return docs
