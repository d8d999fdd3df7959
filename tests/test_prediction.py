import pytest
from pyspark.sql import functions as F

from skyledger.operators.prediction import alphabetical_codes, digits, impute_predicted
from skyledger.sources.tables import stage_measured


def test_predicts_what_the_features_say(spark):
    base = spark.range(400).select(
        (F.col("id") % 4).alias("g"),
        F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("noise"),
        F.concat(F.lit("class"), (F.col("id") % 4).cast("string")).alias("truth"),
        "id",
    )
    holes = base.withColumn(
        "t", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, "nan").otherwise(F.col("truth"))
    )
    full = impute_predicted(holes, "t", ["g", "noise"], num_trees=10)
    assert full.columns == holes.columns and full.count() == 400
    assert full.where("t is null or t in ('nan', 'None', 'NaN')").isEmpty()
    assert full.where("t = truth").count() > 390


def test_wide_feature_and_nothing_missing(spark):
    df = spark.range(100).selectExpr("cast(id as string) as f", "if(id < 50, 'a', 'b') as t")
    assert impute_predicted(df, "t", ["f"]) is df
    holes = df.withColumn("t", F.expr("if(f = '7', null, t)")).withColumn("f", F.expr("if(f = '9', null, f)"))
    assert impute_predicted(holes, "t", ["f"], num_trees=5).where("t is null").isEmpty()


@pytest.mark.parametrize("width, classes", [(60, 60), (120, 2)])
def test_wide_features_are_told_apart(spark, width, classes):
    base = spark.range(3000).select("id", (F.col("id") * 7919 % width).cast("string").alias("f"))
    truth = base.withColumn(
        "truth", F.concat(F.lit("c"), F.pmod(F.xxhash64("f"), F.lit(classes)).cast("string"))
    )
    holes = truth.withColumn("t", F.when(F.col("id") % 11 != 0, F.col("truth")))
    filled = impute_predicted(holes, "t", ["f"], num_trees=40)
    assert filled.where("t <> truth or t is null").isEmpty()


@pytest.mark.parametrize("width, base", [(1, 10), (10, 10), (11, 10), (1000, 10), (1001, 10), (50_000, 1000)])
def test_digits_tell_all_codes_apart(spark, width, base):
    codes = spark.range(width).select(F.col("id").cast("double").alias("code"))
    parts = digits(F.col("code"), width, base)
    rows = codes.select("code", *[p.alias(f"d{i}") for i, p in enumerate(parts)]).orderBy("code").collect()
    found = [tuple(r)[1:] for r in rows]
    assert len(set(found)) == width and found == sorted(found)
    assert all(0 <= x < base and x == int(x) for r in found for x in r)


@pytest.mark.parametrize("width, most, classes", [(300, 20, 2), (300, 7, 5), (50_000, 1000, 3)])
def test_wider_than_the_histograms(spark, width, most, classes):
    """A feature in digits is answered as exactly as one that fits."""
    base = spark.range(4 * width).select("id", (F.col("id") * 7919 % width).cast("string").alias("f"))
    truth = base.withColumn(
        "truth", F.concat(F.lit("c"), F.pmod(F.xxhash64("f"), F.lit(classes)).cast("string"))
    )
    holes = truth.withColumn("t", F.when(F.col("id") % 11 != 0, F.col("truth")))
    filled = impute_predicted(holes, "t", ["f"], num_trees=10, max_width=most)
    assert filled.count() == 4 * width and filled.where("t <> truth or t is null").isEmpty()


def test_two_classes_after_an_observed_query(spark):
    stage_measured(spark.range(10), "seen", [F.count(F.lit(1)).alias("n")])
    df = spark.range(90).selectExpr("cast(id % 9 as string) f", "if(id < 9, null, id % 9 < 4) t")
    filled = impute_predicted(df, "t", ["f"], num_trees=5)
    assert filled.where("t is null or (t = 'true') <> (cast(f as int) < 4)").isEmpty()


def test_too_many_classes_are_refused_by_name(spark):
    df = spark.range(50).selectExpr(
        "cast(id as string) f", "if(id = 3, null, cast(id % 9 as string)) t"
    )
    with pytest.raises(ValueError, match="'t' has 9 classes"):
        impute_predicted(df, "t", ["f"], max_classes=8)


def test_codes_are_alphabetical_ranks(spark):
    df = spark.range(5000).selectExpr("cast(id % 997 as string) as a", "concat('v', id % 3) as b")
    found = alphabetical_codes(df, ["a", "b"]).collect()
    for c, values in (("a", [str(i) for i in range(997)]), ("b", ["v0", "v1", "v2"])):
        ranks = {r["value"]: r["code"] for r in found if r["feature"] == c}
        assert ranks == {v: float(i) for i, v in enumerate(sorted(values))}
