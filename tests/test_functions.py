import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import checks
from netloom.functions import scalars as S


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_codes(spark):
    got = one(spark, [("1",), (" 000001 ",), ("600519.0",), ("sh600519",), ("1234567",)], "c string", S.pad_code("c"), S.normalize_code("c"))
    assert got[0] == ("000001", "000001") and got[1] == ("000001", "000001")
    assert got[2][1] == "600519" and got[3][1] == "600519" and got[4][0] == "1234567"


def test_strict_bool(spark):
    assert [r[0] for r in one(spark, [("TRUE",), ("0",), ("False ",)], "c string", S.strict_bool("c"))] == [True, False, False]
    for bad in ("yes", None):
        with pytest.raises(Exception, match="not a boolean"):
            one(spark, [(bad,)], "c string", S.strict_bool("c"))


def test_ratio_variation_isclose(spark):
    got = one(spark, [(1.0, 0.0), (1.0, 2.0)], "a double, b double", S.ratio("a", "b"), S.variation("b", "a"), S.isclose("a", "b"))
    assert got == [(None, None, False), (0.5, 0.5, False)]
    assert S.geomspace(1.0, 100.0, 3) == pytest.approx([1, 10, 100])


def test_row_functions(spark):
    got = one(spark, [(1.0, 2.0, 6.0)], "a double, b double, c double", S.row_mean("a", "b", "c"), S.row_sd("a", "b", "c"), S.count_true(F.col("a") > 1, F.col("b") > 1))
    assert got[0] == pytest.approx((3.0, np.std([1, 2, 6]), 1))


def test_resolve_and_checks(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert S.resolve_column(df, ["a", "v"]) == "v"
    with pytest.raises(ValueError):
        S.resolve_column(df, ["a"])
    for bad in (lambda: checks.require_unique(df, ["k"]), lambda: checks.require_consistent(df, "k", ["v"]), lambda: checks.require_columns(df, ["z"]), lambda: checks.require_same_keys(df, df.limit(1), ["v"])):
        with pytest.raises(ValueError):
            bad()
    checks.require_unique(df, ["k", "v"])


def test_square_check(spark):
    good = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)], "row string, col string, value double")
    checks.require_square(good)
    with pytest.raises(ValueError, match="symmetric"):
        checks.require_square(good.withColumn("value", F.when(F.col("row") < F.col("col"), 0.4).otherwise(F.col("value"))))
    with pytest.raises(ValueError, match="square"):
        checks.require_square(good.limit(3))
