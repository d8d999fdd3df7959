"""From raw documents to packed training sequences: five stages, each a Parquet table.

Every stage takes the documents that the one before kept, whole, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.decontaminate import decontaminate
from skyledger.llm.frames import set_aside, shipped
from skyledger.llm.packing import best_fit_packing
from skyledger.llm.quality import quality_rules
from skyledger.llm.simhash import simhash_dedup
from skyledger.llm.substring import substring_dedup
from skyledger.sources.tables import drop_table, staging, staging_path, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    plain, restored = set_aside(docs, ["text"])
    return restored(quality_rules(plain).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    return simhash_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document holds go; so do documents left empty."""
    plain, restored = set_aside(docs, ["doc_id", "text"])
    got = substring_dedup(plain).filter((F.col("n_removed") == 0) | (F.col("kept_text") != ""))
    cut = F.col("n_removed") > 0
    got = got.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n_chars = plain.columns[docs.columns.index("n_chars")]
        size = F.when(cut, F.length("text")).otherwise(F.col(f"`{n_chars}`"))
        got = got.withColumn(n_chars, size.cast(docs.schema["n_chars"].dataType))
    return restored(got)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_free),
    ("best_fit_packing", packed),
]

#: Rolling hashes, components and tilings are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage wrote on the way, and its input, go once it is written.

    A null text is an empty one, which the quality rules reject, as do very short texts; so an
    empty table and one of such texts give no rows. Null ids rank last and keep their rows apart by
    text. Rows that repeat each other are copies, of which one stays. Further columns come through
    all but the last stage as they are, whatever their names; ``n_chars`` is the only one that is
    worked out again, where a text was cut. Texts are read whole.
    """
    docs, before = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES:
        path = staging_path(spark, name)
        with staging(spark):
            write_table(apply(spark, docs, sf_dir), path)
        if before:
            drop_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
