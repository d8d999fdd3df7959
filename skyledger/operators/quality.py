"""Null, duplicate and column-kind reports, the decisions taken from them, and imputation.

Decisions that depend on the data (which columns to drop, what to fill in) take one
aggregate over all columns together, never a job per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.money import ratio
from skyledger.operators.aggregates import one_row_per_column
from skyledger.operators.quantiles import (
    Extent,
    exact_medians,
    exact_quantiles,
    extent_measures,
    read_extents,
    some_rows,
)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# --- nulls ------------------------------------------------------------------------


def null_counts(df: DataFrame) -> DataFrame:
    """Rows and nulls of every column, one pass over the table."""
    rows = F.count(F.lit(1))
    return one_row_per_column(
        df,
        {
            c: {"total_count": rows, "null_count": F.count_if(F.col(c).isNull())}
            for c in df.columns
        },
    ).withColumn("null_pct", ratio(F.col("null_count"), F.col("total_count")) * 100)


def null_profile(df: DataFrame) -> DataFrame:
    """Columns that hold nulls, highest share first."""
    return null_counts(df).where("null_count > 0").orderBy(F.desc("null_pct"), "column_name")


def merged_null_counts(counts: DataFrame) -> DataFrame:
    """``null_counts`` of a whole table from those of its parts, laid under each other."""
    sums = counts.groupBy("column_name").agg(
        F.sum("total_count").alias("total_count"), F.sum("null_count").alias("null_count")
    )
    return sums.withColumn("null_pct", ratio(F.col("null_count"), F.col("total_count")) * 100)


def columns_with_nulls(df: DataFrame) -> list[str]:
    """Their names, in table order."""
    found = {r["column_name"] for r in null_counts(df).where("null_count > 0").collect()}
    return [c for c in df.columns if c in found]


def null_patterns(df: DataFrame) -> DataFrame:
    """How often each combination of nulls occurs; ``1`` marks a null, in table order."""
    bits = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("row_count"))


def _drop_where(df: DataFrame, condition: str) -> tuple[DataFrame, list[str]]:
    found = {r["column_name"] for r in null_counts(df).where(condition).collect()}
    names = [c for c in df.columns if c in found]
    return df.drop(*names), names


def drop_all_null_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without the columns that hold nothing but nulls; an empty table loses all of them."""
    return _drop_where(df, "null_count = total_count")


def drop_high_null_columns(
    df: DataFrame, threshold: float = 95.0
) -> tuple[DataFrame, list[str]]:
    """Without the columns whose share of nulls is strictly above ``threshold`` percent."""
    return _drop_where(df, f"null_pct > {float(threshold)}D")


# --- column kinds -----------------------------------------------------------------


@dataclass(frozen=True)
class ColumnKinds:
    categorical: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    numerical: list[str] = field(default_factory=list)


def low_cardinality(
    df: DataFrame,
    columns: Sequence[str],
    threshold: int = 20,
    estimates: Mapping[str, int] | None = None,
) -> dict[str, int]:
    """Exact distinct count of the columns that have at most ``threshold`` values.

    A sketch screens out the columns that are far wider, so the exact count only ever
    groups a few values. The limit leaves it a fourfold error; a sketch that holds few
    values is all but exact.
    """
    if not columns:
        return {}
    if estimates is None:
        estimates = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    narrow = [c for c in columns if estimates[c] <= 4 * threshold + 16]
    if not narrow:
        return {}
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in narrow]).first()
    return {c: counts[c] for c in narrow if counts[c] <= threshold}


def classify_columns(
    df: DataFrame,
    threshold: int = 20,
    ordinal: Sequence[str] = (),
    estimates: Mapping[str, int] | None = None,
) -> ColumnKinds:
    """Numbers with more than ``threshold`` values are numerical, the rest categorical.

    Spark has no ordered category type, so ``ordinal`` columns are named by the caller.
    """
    numbers = [c for c in numeric_columns(df) if c not in ordinal]
    narrow = low_cardinality(df, numbers, threshold, estimates)
    wide = [c for c in numbers if c not in narrow]
    return ColumnKinds(
        categorical=[c for c in df.columns if c not in wide and c not in ordinal],
        ordinal=[c for c in df.columns if c in ordinal],
        numerical=[c for c in df.columns if c in wide],
    )


@dataclass(frozen=True)
class TableFacts:
    """What one pass over a table tells: rows, nulls, and the mean and ends of the numbers."""

    rows: int
    nulls: dict[str, int]
    means: dict[str, float | None]
    extents: dict[str, Extent]

    @property
    def gaps(self) -> list[str]:
        return [c for c, n in self.nulls.items() if n]


#: Column that tells the rows the summaries are taken from. Worked out once for a row, ahead of the
#: measures: each of their sketches would otherwise hash the whole row anew.
DRAWN = "__drawn"


def with_drawn(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the column that ``fact_measures`` of ``columns`` reads."""
    return df.withColumn(DRAWN, some_rows(df.select(*columns)))


def fact_measures(df: DataFrame, numbers: Sequence[str]) -> list[Column]:
    """Aggregates, over ``with_drawn``, that ``read_facts`` picks up from the result."""
    return [
        F.count(F.lit(1)).alias("*:rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}:gaps") for c in df.columns],
        *[F.avg(c).alias(f"{c}:mean") for c in numbers],
        *extent_measures(numbers, F.col(DRAWN)),
    ]


def read_facts(
    row: Mapping[str, object] | Row, columns: Sequence[str], numbers: Sequence[str]
) -> TableFacts:
    return TableFacts(
        row["*:rows"],
        {c: row[f"{c}:gaps"] for c in columns},
        {c: row[f"{c}:mean"] for c in numbers},
        read_extents(row, numbers),
    )


def table_facts(df: DataFrame, numbers: Sequence[str]) -> TableFacts:
    """The facts of all columns from one aggregate."""
    row = with_drawn(df, df.columns).agg(*fact_measures(df, numbers)).first()
    return read_facts(row, df.columns, numbers)


def kind_measures(df: DataFrame) -> list[Column]:
    """Facts and a sketch of the distinct values of every number column, over ``with_drawn``."""
    numbers = numeric_columns(df)
    sketches = [F.approx_count_distinct(c).alias(f"{c}:values") for c in numbers]
    return [*fact_measures(df, numbers), *sketches]


def facts_and_kinds(
    df: DataFrame, threshold: int = 20, measured: Mapping[str, object] | None = None
) -> tuple[TableFacts, ColumnKinds]:
    """Facts and the kind of every column, from one pass over the whole table and one over
    its narrow columns. ``measured`` holds ``kind_measures`` taken already."""
    numbers = numeric_columns(df)
    row = measured or with_drawn(df, df.columns).agg(*kind_measures(df)).first()
    estimates = {c: row[f"{c}:values"] for c in numbers}
    kinds = classify_columns(df, threshold, estimates=estimates)
    return read_facts(row, df.columns, numbers), kinds


def nulls_and_kinds(df: DataFrame, threshold: int = 20) -> tuple[list[str], ColumnKinds]:
    """Columns with nulls and the kind of every column."""
    facts, kinds = facts_and_kinds(df, threshold)
    return facts.gaps, kinds


def column_kinds(df: DataFrame, threshold: int = 20, ordinal: Sequence[str] = ()) -> DataFrame:
    """``classify_columns`` as a table, one row per column."""
    kinds = classify_columns(df, threshold, ordinal)
    label = {
        **{c: "categorical" for c in kinds.categorical},
        **{c: "ordinal" for c in kinds.ordinal},
        **{c: "numerical" for c in kinds.numerical},
    }
    rows = [(c, label[c]) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string")


# --- duplicates -------------------------------------------------------------------


def copies(df: DataFrame, name: str = "copy_count") -> DataFrame:
    """Distinct rows with their number of copies: one shuffle answers both questions."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(name))


def duplicate_stats(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows that share their key with another row, as count and percent of all rows."""
    keys = list(subset or df.columns)
    n = F.col("copy_count")
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copy_count"))
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("total_count"),
            F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_count"),
        )
        .withColumn("duplicate_pct", ratio(F.col("duplicate_count"), F.col("total_count")) * 100)
        .withColumn("columns_checked", F.lit(", ".join(keys) if subset else "all columns"))
    )


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    order_by: Sequence[str | Column] | None = None,
) -> DataFrame:
    """One row per key. Rows have no order of their own, so ``order_by`` says which is first.

    The window keeps one candidate per key and task before anything is shuffled.
    """
    if not subset:
        return df.dropDuplicates()
    if not order_by:
        raise ValueError("a subset needs order_by: it decides which row is kept")
    first = Window.partitionBy(*subset).orderBy(*order_by)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def check_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    order_by: Sequence[str | Column] | None = None,
    auto_drop: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The table, cleaned unless ``auto_drop`` is off, and its duplicate report."""
    kept = drop_duplicates(df, subset, order_by) if auto_drop else df
    return kept, duplicate_stats(df, subset)


# --- imputation -------------------------------------------------------------------


def _most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text; the smallest one on ties.

    Values are counted per column across the cluster; one row per column comes back.
    """
    if not columns:
        return {}
    numbers = set(numeric_columns(df))
    cells = []
    for c in columns:
        as_number = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("string").alias("value"),
                as_number.alias("as_number"),
            )
        )
    counted = (
        df.select(F.inline(F.array(*cells)))
        .where("value is not null")
        .groupBy("column_name", "as_number", "value")
        .agg(F.count("*").alias("n"))
    )
    best = Window.partitionBy("column_name").orderBy(F.desc("n"), "as_number", "value")
    top = counted.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return {r["column_name"]: r["value"] for r in top.collect()}


def fill_values(
    df: DataFrame,
    num_cols: Sequence[str] = (),
    cat_cols: Sequence[str] = (),
    num_strategy: str = "median",
    cat_strategy: str = "mode",
    constant: str | None = None,
    exact: bool = True,
    facts: TableFacts | None = None,
) -> dict[str, object]:
    """What ``impute`` puts into the columns that hold nulls."""
    num_cols, cat_cols = list(num_cols), list(cat_cols)
    if not num_cols and not cat_cols:
        return {}
    if facts is None:
        facts = table_facts(df.select(*dict.fromkeys(num_cols + cat_cols)), num_cols)
    num_cols = [c for c in num_cols if facts.nulls[c]]
    cat_cols = [c for c in cat_cols if facts.nulls[c]]
    fills: dict[str, object] = {}
    if num_strategy == "median":
        ends = {c: facts.extents[c] for c in num_cols}
        fills |= exact_medians(df, num_cols, extents=ends, exact=exact)
    else:
        fills |= {c: facts.means[c] for c in num_cols}
    if cat_strategy == "mode":
        fills |= _most_frequent(df, cat_cols)
    else:
        fills |= {c: constant for c in cat_cols}
    return fills


def fill(
    df: DataFrame,
    fills: Mapping[str, object],
    num_cols: Sequence[str],
    cat_cols: Sequence[str],
    cat_strategy: str = "mode",
    numeric_mode: str = "text",
) -> DataFrame:
    """Nulls replaced by ``fills``; a fill of None leaves its column alone."""
    numbers = set(numeric_columns(df))
    filled: dict[str, Column] = {}
    for c, value in fills.items():
        if value is None:
            continue
        if c in num_cols:
            filled[c] = F.coalesce(F.col(c).cast("double"), F.lit(value).cast("double"))
        elif cat_strategy == "mode":
            filled[c] = F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType))
        elif c not in numbers or numeric_mode == "text":
            filled[c] = F.coalesce(F.col(c).cast("string"), F.lit(value))
    return df.withColumns(filled) if filled else df


def impute(
    df: DataFrame,
    num_cols: Sequence[str] = (),
    cat_cols: Sequence[str] = (),
    num_strategy: str = "median",
    cat_strategy: str = "mode",
    constant: str | None = None,
    numeric_mode: str = "text",
    exact: bool = True,
    facts: TableFacts | None = None,
) -> DataFrame:
    """Nulls replaced by median or mean, by mode, or by a constant; other columns stay.

    A number column among ``cat_cols`` filled with a text constant becomes text
    (``numeric_mode="text"``) or keeps its type and its nulls (``"keep"``). A column that
    holds nothing but nulls has no median, mean or mode and keeps them.

    One pass finds the columns with nulls, the means and the ends of the numbers; ``facts``
    spares it.
    """
    if cat_strategy not in ("mode", "constant"):
        raise ValueError(f"cat_strategy must be 'mode' or 'constant', got {cat_strategy!r}")
    if numeric_mode not in ("text", "keep"):
        raise ValueError(f"numeric_mode must be 'text' or 'keep', got {numeric_mode!r}")
    fills = fill_values(
        df, num_cols, cat_cols, num_strategy, cat_strategy, constant, exact, facts
    )
    return fill(df, fills, num_cols, cat_cols, cat_strategy, numeric_mode)


# --- filter -----------------------------------------------------------------------


@dataclass(frozen=True)
class FilterResult:
    rows: DataFrame
    categorical: list[str]
    numerical: list[str]


def filter_allowed(
    df: DataFrame,
    allowed: Mapping[str, Sequence[object]],
    na_cols: Sequence[str] = (),
    strict: bool = False,
) -> FilterResult:
    """Rows whose columns hold allowed values.

    NOTE: unless ``strict``, a column listed in ``na_cols`` is *not* filtered; it is
    returned, by type, as one to impute.
    """
    skipped = [] if strict else [c for c in allowed if c in set(na_cols)]
    rows = df
    for c, values in allowed.items():
        if c not in skipped:
            rows = rows.where(F.col(c).isin(*values))
    text = [c for c in skipped if isinstance(df.schema[c].dataType, T.StringType)]
    return FilterResult(rows, text, [c for c in skipped if c not in text])


# --- profile ----------------------------------------------------------------------


def column_profile(df: DataFrame, cache: bool = False, exact: bool = True) -> DataFrame:
    """Rows, nulls, distinct values and most frequent value of every column, and for
    numbers zeros, mean, standard deviation, ends and quartiles.

    Exact distinct counts and most frequent values shuffle every distinct value. With
    ``exact=False`` sketches estimate quartiles and distinct counts, and the most frequent
    value is null.
    """
    numbers = numeric_columns(df)
    quartiles = exact_quantiles(
        df, {c: [0.25, 0.5, 0.75] for c in numbers}, exact=exact, cache=cache
    )
    nothing = F.max(F.lit(None).cast("double"))
    measures = {}
    for c in df.columns:
        x = F.col(c).cast("double") if c in numbers else None
        measures[c] = {
            "row_count": F.count(F.lit(1)),
            "null_count": F.count_if(F.col(c).isNull()),
            "zero_count": F.count_if(x == 0) if c in numbers else F.count_if(F.lit(False)),
            "mean": F.avg(x) if c in numbers else nothing,
            "std": F.stddev_samp(x) if c in numbers else nothing,
            "min": F.min(x) if c in numbers else nothing,
            "max": F.max(x) if c in numbers else nothing,
        }
        if not exact:
            measures[c]["distinct_count"] = F.approx_count_distinct(c)
            measures[c]["top_value"] = F.max(F.lit(None).cast("string"))
            measures[c]["top_count"] = F.max(F.lit(None).cast("long"))
    constants = {
        c: dict(zip(("p25", "p50", "p75"), quartiles.get(c, [None] * 3))) for c in df.columns
    }
    basics = one_row_per_column(df, measures, constants)
    if not exact:
        return basics
    counted = basics.join(_value_counts(df), "column_name", "left")
    return counted.na.fill(0, ["distinct_count"])  # a column of nulls has no value to count


def _value_counts(df: DataFrame) -> DataFrame:
    """Distinct values and the most frequent one (smallest text on ties) per column."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in df.columns
    ]
    counted = (
        df.select(F.inline(F.array(*cells)))
        .where("value is not null")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )
    distinct = counted.groupBy("column_name").agg(F.count("*").alias("distinct_count"))
    best = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    top = counted.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return distinct.join(
        top.select("column_name", F.col("value").alias("top_value"), F.col("n").alias("top_count")),
        "column_name",
    )


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of number columns, one pass."""
    names = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, corr double")
    row = df.agg(*[F.corr(a, b).alias(f"corr_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"corr_{i}").alias("corr")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))
