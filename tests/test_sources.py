import os

import pytest

from skyledger.sources import tables


def test_csv_round_trip(spark, tmp_path):
    rows = [("a, b", 'say "x"', " 12"), ("NA", "", None), ("nan", "Nan", "N/A")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    path = str(tmp_path / "t")
    tables.write_table(df, path, "csv")
    back = tables.read_raw_csv(spark, path, df.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(
        [("a, b", 'say "x"', " 12"), (None, None, None), (None, "Nan", None)], key=str
    )
    kept = tables.read_raw_csv(spark, path, df.columns, na_tokens=())
    assert kept.where("a = 'NA'").count() == 1


def test_multi_line_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n"two\nlines",1\n')
    path = str(tmp_path / "m.csv")
    row = tables.read_raw_csv(spark, path, ["a", "b"], multi_line=True).first()
    assert tuple(row) == ("two\nlines", "1")


def test_parquet_prunes_and_stage_keeps_types(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id * 0.5D as x", "cast(id as string) as t")
    path = str(tmp_path / "p")
    tables.write_table(df, path)
    tables.write_table(df, path)  # overwrites
    assert tables.read_clean(spark, path, ["x"]).schema.names == ["x"]
    staged = tables.stage(df)
    assert staged.schema.names == df.schema.names and staged.count() == 5
    with pytest.raises(ValueError):
        tables.write_table(df, path, "xml")


def test_read_clean_csv(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.range(3).selectExpr("id", "id * 0.5D as x", "timestamp'2019-03-02' as d")
    tables.write_table(df, path, "csv")
    back = tables.read_clean(spark, path, ["x", "d"], "csv", {"id": "long", "x": "double", "d": "timestamp"})
    assert back.dtypes == [("x", "double"), ("d", "timestamp")]
    assert sorted(r["x"] for r in back.collect()) == [0.0, 0.5, 1.0]
    assert back.where("d = timestamp'2019-03-02'").count() == 3
    with pytest.raises(ValueError):
        tables.read_clean(spark, path, ["x"], "xml")


def test_columns_go_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a,c\n1,2,3\n")
    one = tables.read_raw_csv(spark, str(tmp_path / "a.csv"), ["a", "b"])
    assert [r.asDict() for r in one.collect()] == [{"a": "2", "b": "1"}]
    (tmp_path / "b.csv").write_text("a,b,c\n2,1,3\n")
    both = tables.read_raw_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    with pytest.raises(Exception, match="header"):
        both.collect()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, "y"), (None, "z")], "x double, t string")
    assert [r["x"] for r in tables.nulls_for_nan(df).collect()] == [None, 1.0, None]


class Session:
    """A stand-in for a session with the folders it names."""

    def __init__(self, master, conf=None, explicit=None):
        self.master, self.conf, self.explicit = master, conf or {}, explicit
        self.sparkContext = self

    def getCheckpointDir(self):
        return self.explicit


@pytest.mark.parametrize("master", ["yarn", "local[8]", "local-cluster[2,1,1024]"])
def test_an_unset_folder_is_an_error_everywhere(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.staging_root(Session(master))


def test_the_explicit_folder_comes_first():
    conf = {"spark.checkpoint.dir": "hdfs://a/conf"}
    assert tables.staging_root(Session("yarn", conf)) == "hdfs://a/conf"
    assert tables.staging_root(Session("yarn", conf, "hdfs://a/own/")) == "hdfs://a/own"


def _folder(df):
    return df.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]


def test_staging_goes_there_and_its_owner_removes_it(spark):
    root = tables.staging_root(spark).removeprefix("file:")
    df = spark.range(5)
    with tables.staging(spark):
        outer = tables.stage(df, "outer")
        with tables.staging(spark):
            folder = _folder(tables.stage(df, "inner"))
            assert folder.startswith(f"{root}/inner-")
        assert not os.path.exists(folder)
        assert outer.count() == 5
    assert tables.stage(df, "kept").count() == 5


def test_nan_of_both_formats_is_missing_once_read(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0), (3, 4.0)], "id int, x double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        tables.write_table(df, path, fmt)
        back = tables.read_clean(spark, path, ["id", "x"], fmt, {"id": "int", "x": "double"})
        assert tuple(back.selectExpr("count(x)", "avg(x)").first()) == (2, 3.0)


def test_tables_without_nan_are_marked(spark, tmp_path):
    """Filters on floats then reach the scan by default; a table with NaN, or a new one, does not."""
    rows = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.5, None)], "x double, s string")
    nan = spark.createDataFrame([(float("nan"), "a")], "x double, s string")
    path = str(tmp_path / "t")

    def pushed():
        plan = tables.read_clean(spark, path, ["x"]).where("x > 2")
        return "GreaterThan(x,2.0)" in plan._jdf.queryExecution().toString()

    tables.write_table(rows, path, mark_nan=True)
    assert tables.is_nan_free(spark, path) and pushed()
    assert tables.read_clean(spark, path, ["x"]).where("x > 2").count() == 1
    tables.write_table(nan, path, mark_nan=True)
    assert not tables.is_nan_free(spark, path) and not pushed()
    assert tables.read_clean(spark, path, ["x"]).where("x is null").count() == 1
    tables.write_table(rows.select("s"), path, mark_nan=True)
    assert tables.is_nan_free(spark, path)
    tables.write_table(nan, path)
    assert not tables.is_nan_free(spark, path)
