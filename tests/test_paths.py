"""Names, mip numbers and keys, on literal rows."""

from pyspark.sql import functions as F

from rastercat.functions import paths


def rows(spark, df):
    return [tuple(r) for r in df.collect()]


def test_parts(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b/x.tar.png", ".png", "d/.hidden", "plain", "d/end.", "x.PNG")], "rel_path string")
    got = rows(spark, paths.with_path_parts(df))
    assert got == [
        ("a/b/x.tar.png", "a/b", "x.tar.png", "x.tar", ".png"),
        (".png", "", ".png", ".png", ""),
        ("d/.hidden", "d", ".hidden", ".hidden", ""),
        ("plain", "", "plain", "plain", ""),
        ("d/end.", "d", "end.", "end.", ""),
        ("x.PNG", "", "x.PNG", "x", ".PNG"),
    ]


def test_eligible_names(spark):
    df = spark.createDataFrame([("foo-123-bar", True), ("abc-045-texture-mip0", True), ("singlepart", False), ("foo-123", False)], "stem string, want boolean")
    assert df.filter(paths.is_eligible(F.col("stem")) != F.col("want")).count() == 0


def test_last_mip_wins(spark):
    df = spark.createDataFrame([("a-mip1-b-MIP02c",), ("a-mip",), ("-mip3",), ("x-mip99999999999999999999",)], "stem string")
    s = F.col("stem")
    got = rows(spark, df.select(paths.is_mip(s), paths.mip_prefix(s), paths.mip_number(s), paths.mip_suffix(s)))
    assert got == [(True, "a-mip1-b", 2, "c"), (False, "", None, ""), (True, "", 3, ""), (True, "x", None, "")]


def test_id_key_may_be_empty(spark):
    df = spark.createDataFrame([("a--b",), ("a-7-b",), ("a",)], "stem string")
    assert rows(spark, df.select(paths.id_key(F.col("stem")))) == [("",), ("7",), (None,)]


def test_composite_name_is_cut(spark):
    df = spark.createDataFrame([("a", "b"), ("x" * 170, "y" * 40)], "l string, h string")
    short, long = (r[0] for r in rows(spark, df.select(paths.composite_name(F.col("l"), F.col("h")))))
    assert short == "a__VS__b.png" and len(long) == 184 and long.endswith(".png")


def test_error_lines(spark):
    df = spark.createDataFrame([("Decode FAILED",), ("not  found",), ("Access Denied ",), ("12.5%",)], "line string")
    assert [r[0] for r in df.select(paths.is_error_line(F.col("line"))).collect()] == [True, False, True, False]
