"""CSV at the edges, typed Parquet between stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.text import NA_TOKENS


def nulls_for_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text columns: every missing-value token becomes null."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not tokens:
        return df
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in text})


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """Floating columns: NaN becomes null, so there is one notion of missing."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def read_raw_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool = False,
) -> DataFrame:
    """Columns as text, by header name, missing-value tokens as null.

    Conversion is a later, audited step, so nothing is inferred: one header line is read,
    and files whose header differs from it are refused. ``multi_line`` allows line breaks
    inside quotes; a file then can no longer be split between tasks, so it is off unless
    asked for.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(schema).options(enforceSchema=False, **options).csv(path)
    return nulls_for_tokens(raw.select(*(columns or names)), na_tokens)


def read_clean(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str],
    fmt: str = "parquet",
    types: Mapping[str, str] | None = None,
    nan_as_null: bool | None = None,
) -> DataFrame:
    """A cleaned table with the named columns only; the projection reaches the scan.

    CSV holds no types: ``types`` names those of its columns that are not text. A cell that
    does not convert is null, and so is NaN. Filters on floating columns reach a Parquet scan
    only where no NaN can be met: in tables that ``write_table`` has marked, or with
    ``nan_as_null=False``.
    """
    files = [path] if isinstance(path, str) else path
    if nan_as_null is None:
        nan_as_null = fmt != "parquet" or not all(is_nan_free(spark, f) for f in files)
    clean = nulls_for_nan if nan_as_null else lambda df: df
    if fmt == "parquet":
        return clean(spark.read.parquet(*files).select(*columns))
    if fmt != "csv":
        raise ValueError(f"fmt must be 'parquet' or 'csv', got {fmt!r}")
    wanted = {c: t for c, t in (types or {}).items() if c in columns}
    text = read_raw_csv(spark, path, columns)
    return clean(text.withColumns({c: F.col(c).try_cast(t) for c, t in wanted.items()}))


#: A file of this name in a table's folder says that none of its cells is NaN. Spark skips it.
NAN_FREE = "_nan_free"


def _file(spark: SparkSession, path: str):
    """A path and the file system that keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def is_nan_free(spark: SparkSession, path: str) -> bool:
    where, files = _file(spark, f"{path}/{NAN_FREE}")
    return files.exists(where)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mark_nan: bool = False) -> None:
    """Overwrite ``path`` with Parquet, or CSV with a header.

    ``mark_nan`` counts NaN while the rows are written, and marks a Parquet table without any.
    """
    if fmt == "parquet":
        floats = [
            f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        ]
        seen = Observation() if mark_nan and floats else None
        nans = [F.count_if(F.isnan(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(floats)]
        (df.observe(seen, *nans) if seen else df).write.mode("overwrite").parquet(path)
        if mark_nan and not (seen and any(seen.get.values())):
            where, files = _file(df.sparkSession, f"{path}/{NAN_FREE}")
            files.create(where, True).close()
    elif fmt == "csv":
        (
            df.write.mode("overwrite")
            .option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        raise ValueError(f"fmt must be 'parquet' or 'csv', got {fmt!r}")


def write_bucketed(
    df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int
) -> DataFrame:
    """Overwrite ``table``, kept as Parquet at ``path``, dealt to buckets by ``keys`` and sorted
    by them inside; tables with as many buckets meet on these keys without a shuffle.

    One task writes a bucket as one file, so keys should be spread: bucket grouped rows, of which a
    hot key has few, not the rows that they were made of.
    """
    dealt = df.repartition(buckets, *keys)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def staging_root(spark: SparkSession) -> str:
    """The shared folder that intermediate tables go to.

    A folder given to ``setCheckpointDir`` comes first, then the one the session names in
    ``spark.checkpoint.dir``. Without either there is no folder all executors are known to share.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the staging root."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Staged tables of each open ``staging`` block, innermost last.
_OWNERS: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns the tables staged inside the block and removes them at its end.

    Results have to be written or collected inside, as they read the staged tables. Tables
    staged outside any block are left to whoever owns the shared folder.
    """
    paths: list[str] = []
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.remove(paths)
        for path in paths:
            drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a written table, wherever Spark's file systems keep it."""
    folder, files = _file(spark, path)
    files.delete(folder, True)


def owned_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the staging root, owned by the innermost open ``staging`` block."""
    path = staging_path(spark, name)
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared staging folder and read it back.

    Cuts the lineage, survives lost executors, and lets each later pass read only
    the columns it needs. The innermost open ``staging`` block owns the table.
    """
    return stage_measured(df, name)[0]


def stage_measured(
    df: DataFrame, name: str, measures: Sequence[Column] = ()
) -> tuple[DataFrame, dict[str, object]]:
    """``stage``, and named aggregates of the rows taken while they are written."""
    spark = df.sparkSession
    path = owned_path(spark, name)
    seen = Observation() if measures else None
    write_table(df.observe(seen, *measures) if seen else df, path)
    return spark.read.schema(df.schema).parquet(path), seen.get if seen else {}
