"""Readers and shapes that no query of one table shows."""

import pytest
from pyspark.sql import types as T

from gridspark.sources import io


def test_tables_of_every_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    for kind in ("parquet", "orc", "json"):
        df.write.format(kind).save(str(tmp_path / f"t.{kind}"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "plain"))
    for name in ("t.parquet", "t.orc", "t.json", "t.csv", "plain"):
        got = io.read_table(spark, str(tmp_path / name), columns=["n"])
        assert got.columns == ["n"] and sorted(r.n for r in got.collect()) == [1, 2]
    many = io.read_many(spark, [str(tmp_path / "t.orc"), str(tmp_path / "plain")])
    assert many.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        io.read_table(spark, str(tmp_path / "none.parquet"))


def test_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(str(tmp_path / "t"))
    plan = io.read_table(spark, str(tmp_path / "t"), columns=["b"]).filter("b > 4")._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines()[::-1] if "ReadSchema" in line)
    assert "ReadSchema: struct<b:bigint>" in scan and "GreaterThan(b,4)" in scan


def test_what_does_not_fit_a_schema_is_null(spark):
    shape = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DateType()), T.StructField("z", T.StringType())])
    df = spark.createDataFrame([("1", "2024-01-02", 9), ("x", "soon", 8), (None, None, None)], "a string, b string, extra int")
    out = io.conform(df, shape)
    assert out.columns == ["a", "b", "z"] and [(r.a, str(r.b), r.z) for r in out.collect()] == [(1, "2024-01-02", None), (None, "None", None), (None, "None", None)]
    assert io.conform(df, shape, keep_extra=True).columns == ["a", "b", "z", "extra"]
    assert io.conform(df.limit(0), shape).count() == 0


def test_nested_names_and_broken_odds(spark):
    df = spark.createDataFrame([((1, ((2,),)), [1])], "`x.y` struct<a: int, b: struct<c: struct<d: int>>>, l array<int>")
    assert io.flatten(df).columns == ["x.y_a", "x.y_b_c_d", "l"]
    feed = spark.createDataFrame([('{"id": "1", "bookmakers": [{"key": "k", "markets": [{"key": "m", "outcomes": [{"name": "n", "price": 2.5}]}]}, {"key": "none"}]}',), ("{",), (None,)], "p string")
    assert [tuple(r) for r in io.flatten_odds(feed, "p").collect()] == [("1", None, None, "k", "m", "n", 2.5, None)]
