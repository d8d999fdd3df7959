"""Missing categories predicted by a random forest."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.sources.tables import owned_path, stage

# Texts that mark a missing category, and the fill for missing features.
MISSING_TEXTS = ("nan", "None", "NaN")
FEATURE_FILL = "Missing"

#: Training rows of one combination: enough that hardly a tree's random draw leaves it out.
COPIES = 16


def alphabetical_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, code)``: the alphabetical rank of each value in its text column."""
    return ordered_codes(_cells(df, columns, F.lit("").alias("key")).distinct())


def _cells(df: DataFrame, columns: Sequence[str], *more: Column) -> DataFrame:
    """A row for each cell of the columns."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), *more) for c in columns]
    return df.select(F.inline(F.array(*cells)))


def ordered_codes(values: DataFrame) -> DataFrame:
    """``(feature, value, code)``: the rank of each value of ``(feature, value, key)`` by key, value.

    Values are sorted across the cluster in ranges; a value's rank is the number of values in
    the ranges before it plus its place in its own range. The ranges are written down before
    they are counted, so both steps see the same ones, and no dictionary visits the driver.
    """
    ranges = stage(
        values.repartitionByRange("feature", "key", "value").withColumn(
            "part", F.spark_partition_id()
        ),
        "codes",
    )
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("feature", "part").agg(F.count("*").alias("n"))
    offsets = sizes.select(
        "feature", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("feature", "part").orderBy("key", "value"))
    return (
        ranges.withColumn("place", place)
        .join(offsets, ["feature", "part"])
        .select("feature", "value", (F.col("offset") + F.col("place") - 1).cast("double").alias("code"))
    )


def _by_class(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each feature's values with their most frequent class, the smallest on ties, as key."""
    cells = _cells(cases, columns, F.col("_label").alias("key"), F.col("_rows"))
    counted = cells.groupBy("feature", "value", "key").agg(F.sum("_rows").alias("n"))
    first = Window.partitionBy("feature", "value").orderBy(
        F.col("key").isNull(), F.desc("n"), "key"
    )
    top = counted.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return top.select("feature", "value", F.coalesce("key", F.lit("")).alias("key"))


def digits(code: Column, width: int, base: int) -> list[Column]:
    """A code below ``width`` as one number if ``base`` allows, else as digits of equal size.

    Digits are the fewest that stay below ``base`` each, the highest first: a threshold on the
    first sets blocks of neighbouring codes apart, and the next ones part a block, so trees can
    cut between any two codes although no digit has more than ``base`` values.
    """
    levels = 1
    while base**levels < width:
        levels += 1
    size = width if levels == 1 else math.ceil(width ** (1 / levels) - 1e-9)
    size += size**levels < width
    return [
        F.floor(code / float(size**i)).cast("double") % float(size) for i in reversed(range(levels))
    ]


def impute_predicted(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    num_trees: int = 100,
    max_depth: int = 30,
    seed: int = 42,
    max_width: int = 1_000,
    max_classes: int = 1_000,
    max_cases: int | None = None,
) -> DataFrame:
    """``target`` filled where it is missing, by a forest trained on the other rows.

    Features are label-encoded and enter as plain numbers, each value told apart. Values are
    numbered by their most frequent class, then alphabetically: purely alphabetical numbers may
    need trees as deep as a feature is wide, and Spark's are 30 deep at most. A feature of more
    than ``max_width`` distinct values enters as the digits of its number, no value merged with
    another, since the widest number sets the size of the forest's histograms. A target of more
    than ``max_classes`` classes is refused for the same reason. Trees grow until their leaves
    are pure or ``max_depth`` deep.

    The forest learns from distinct combinations of features and class, ``COPIES`` at most of
    each with the weight of all its rows, so its input grows with the combinations and not with
    the rows. ``max_cases`` bounds them by a sample when given. Guesses are made once for each
    combination and joined back. A table without gaps comes back unchanged. Stage ``df`` when it
    is dear to compute.
    """
    known = F.col(target).isNotNull() & ~F.col(target).cast("string").isin(*MISSING_TEXTS)
    gaps = df.where(~known)
    if gaps.isEmpty():
        return df
    text = [f"_text_{i}" for i in range(len(features))]
    codes = [f"_code_{i}" for i in range(len(features))]

    def as_text(rows: DataFrame) -> DataFrame:
        filled = {
            t: F.coalesce(F.col(c).cast("string"), F.lit(FEATURE_FILL))
            for t, c in zip(text, features)
        }
        return rows.withColumns(filled)

    label = F.when(known, F.col(target).cast("string")).alias("_label")
    cases = as_text(df).groupBy(*text, label).agg(F.count("*").alias("_rows"))
    cases = stage(cases, "cases")
    dictionary = stage(ordered_codes(_by_class(cases, text)), "dictionary")
    counted = dictionary.groupBy("feature").count().collect()
    widths = {r["feature"]: r["count"] for r in counted}
    numbers = [x for t, c in zip(text, codes) for x in digits(F.col(c), widths[t], max_width)]
    bins = max(min(w, max_width) for w in widths.values()) + 1
    classes = cases.agg(F.count_distinct("_label")).first()[0]
    if classes > max_classes:
        raise ValueError(f"{target!r} has {classes} classes, over {max_classes}")

    def encode(rows: DataFrame) -> DataFrame:
        for t, c in zip(text, codes):
            entries = dictionary.where(F.col("feature") == t)
            rows = rows.join(entries.select(F.col("value").alias(t), F.col("code").alias(c)), t)
        parts = [f"_digit_{i}" for i in range(len(numbers))]
        rows = rows.withColumns(dict(zip(parts, numbers)))
        return VectorAssembler(inputCols=parts, outputCol="_features").transform(rows)

    copies = F.least("_rows", F.lit(COPIES))
    train = (
        encode(cases.where("_label is not null"))
        .withColumn("_weight", F.col("_rows") / copies)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .select("_features", "_label", "_weight")
    )
    if max_cases is not None:
        train = train.sample(min(1.0, max_cases / max(train.count(), 1)), seed)
    train = stage(train, "train")
    labels = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(
        train
    )
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_y", weightCol="_weight", predictionCol="_guess",
        numTrees=num_trees, maxDepth=max_depth, seed=seed, maxBins=max(32, bins),
    ).fit(labels.transform(train))
    # A model of two classes keeps the summary of its training, and with it the session, which
    # cannot be sent to the executors once the session has observed a query. A model that was
    # read has none.
    path = owned_path(df.sparkSession, "forest")
    forest.write().overwrite().save(path)
    forest = RandomForestClassificationModel.load(path)
    back = IndexToString(inputCol="_guess", outputCol="_value", labels=labels.labels)
    unknown = encode(cases.where("_label is null").select(*text))
    guesses = stage(back.transform(forest.transform(unknown)).select(*text, "_value"), "guesses")
    filled = as_text(gaps).join(guesses, text)
    return (
        df.where(known)
        .withColumn(target, F.col(target).cast("string"))
        .unionByName(filled.withColumn(target, F.col("_value")).select(*df.columns))
    )
