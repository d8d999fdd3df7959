from pyspark.sql import functions as F

from skyledger.functions.text import clean_numeric, symmetric_key
from skyledger.operators.cleaning import clean_numeric_columns, parse_date_parts
from skyledger.operators.kpis import add_total_delay


def test_row_level_operators_run_on_a_stream(spark, tmp_path):
    rows = [("JFK", "ATL", "Thirty Five", "2019-03-02", 1.0, 2.0), ("ATL", "JFK", "x", "soon", None, 2.0)]
    schema = (
        "ORIGIN string, DESTINATION string, DISTANCE string, FL_DATE string, "
        "AVG_DEP_DELAY_MINUTES double, AVG_ARR_DELAY_MINUTES double"
    )
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(path)
    stream = (
        spark.readStream.schema(schema).parquet(path)
        .withColumn("raw", clean_numeric(F.col("DISTANCE")))
        .transform(clean_numeric_columns, ["DISTANCE"])
        .transform(parse_date_parts)
        .transform(add_total_delay)
        .withColumn("ROUTE_KEY", symmetric_key(F.col("ORIGIN"), F.col("DESTINATION")))
    )
    query = stream.writeStream.format("memory").queryName("rows_seen").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    seen = {r["ORIGIN"]: r for r in spark.table("rows_seen").collect()}
    assert seen["JFK"]["DISTANCE"] == seen["JFK"]["raw"] == 35.0
    assert (seen["JFK"]["YEAR"], seen["ATL"]["YEAR"]) == (2019, None)
    assert {r["ROUTE_KEY"] for r in seen.values()} == {"ATL-JFK"}
