"""Failed conversions kept as a table of their own, by step, column and reason.

The store is a Parquet table with a folder for each step, column and reason, so a report on some of
them reads their folders and nothing else. It is written from the cells that the converting pass put
next to its rows (``convert_audited``): the text is not parsed again. Equal failures are one row with
their number, so a column that is missing in a third of all rows is a few rows of the store.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.operators.cleaning import cell_error, merged_error_report

FOLDERS = ("step", "column_name", "error_type")
FIGURES = ("detail", "row_count")


@dataclass(frozen=True)
class AuditStore:
    """Failures below ``path``, which all executors share."""

    spark: SparkSession
    path: str

    def write(
        self, converted: DataFrame, steps: Mapping[str, Column], keys: Sequence[str] = ()
    ) -> None:
        """Overwrites the store with the failed cells of each step, an array column each.

        ``keys`` are columns of ``converted`` that are kept with a failure, to find its rows again;
        only failures that agree in them are one row then. A column without failures has no folder.
        """
        taken = sorted({*FOLDERS, *FIGURES, "raw", "is_text"} & set(keys))
        if taken:
            raise ValueError(f"keys are named like columns of the store: {taken}")

        def tagged(step: str) -> Column:
            fields = ("column_name", "raw", "is_text")
            return F.transform(
                F.coalesce(steps[step], F.array()),
                lambda c: F.struct(F.lit(step).alias("step"), *[c[f].alias(f) for f in fields]),
            )

        cells = converted.select(*keys, F.inline(F.concat(*[tagged(step) for step in steps])))
        found = cells.select(*keys, "step", "column_name", cell_error().alias("error")).groupBy(
            *keys, "step", "column_name", "error.error_type", "error.detail"
        )
        # Few files for each folder, yet a folder with most of the rows is not one task's.
        spread = found.agg(F.count("*").alias("row_count")).hint("rebalance", *FOLDERS)
        spread.write.mode("overwrite").partitionBy(*FOLDERS).parquet(self.path)

    def failures(
        self,
        step: str,
        columns: Sequence[str] | None = None,
        reasons: Sequence[str] | None = None,
        keys: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """The stored rows of a step, of some columns and reasons; ``keys`` gives the types of those
        that were kept."""
        names = {**(keys or {}), "detail": "string", "row_count": "long"}
        names.update(dict.fromkeys(FOLDERS, "string"))
        schema = T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in names.items()))
        found = self.spark.read.schema(schema).parquet(self.path).where(F.col("step") == step)
        if columns is not None:
            found = found.where(F.col("column_name").isin(*columns))
        if reasons is not None:
            found = found.where(F.col("error_type").isin(*reasons))
        return found

    def report(
        self,
        step: str,
        columns: Sequence[str] | None = None,
        reasons: Sequence[str] | None = None,
    ) -> DataFrame:
        """The error report of a step, from the store alone."""
        return merged_error_report(self.failures(step, columns, reasons))
