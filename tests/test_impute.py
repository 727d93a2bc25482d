import pytest

import tablewash as tw
from tablewash.operators.impute import allowed_strategies
from pyspark.sql import types as T


@pytest.fixture
def nulls(spark):
    data = [(1, 1.0, "b", None), (2, 2.0, "a", None), (None, None, None, None),
            (4, 4.0, "b", None), (3, 8.0, "a", None)]
    return spark.createDataFrame(data, "i int, d double, s string, n double")


def test_mean_into_integer_rounds_half_even(nulls):
    # mean of 1,2,4,3 = 2.5 -> 2
    out, log = tw.impute_with_log(nulls, [{"column_name": "i", "strategy": "mean"}])
    assert out.where("i IS NULL").count() == 0
    assert sorted(r[0] for r in out.select("i").collect()) == [1, 2, 2, 3, 4]
    assert log == ["Imputed NULLs in 'i' with mean: 2.5."]


def test_median_mode_custom(nulls):
    out = tw.impute(nulls, [{"column_name": "d", "strategy": "median"},
                            {"column_name": "s", "strategy": "mode"},
                            {"column_name": "n", "strategy": "custom", "value": 7}])
    row = out.where("i IS NULL").first()
    assert row["d"] == 3.0            # median of 1, 2, 4, 8
    assert row["s"] == "a"            # tie a/b -> smallest
    assert row["n"] == 7.0


def test_all_null_column_left_alone(nulls):
    out, log = tw.impute_with_log(nulls, [{"column_name": "n", "strategy": "mean"}])
    assert out.where("n IS NULL").count() == 5 and log == []


def test_first_entry_wins_and_checks(nulls):
    out = tw.impute(nulls, [{"column_name": "s", "strategy": "custom", "value": ""},
                            {"column_name": "s", "strategy": "mode"}])
    assert out.where("i IS NULL").first()["s"] == ""      # '' is a value
    with pytest.raises(ValueError, match="numeric"):
        tw.impute(nulls, [{"column_name": "s", "strategy": "mean"}])
    with pytest.raises(ValueError, match="unknown strategy"):
        tw.impute(nulls, [{"column_name": "d", "strategy": "max"}])
    with pytest.raises(ValueError):
        tw.impute(nulls, [{"column_name": "zz", "strategy": "mean"}])
    with pytest.raises(ValueError, match="custom"):
        tw.impute(nulls, [{"column_name": "i", "strategy": "custom", "value": "abc"}])


def test_suggest_imputations(nulls):
    got = dict(tw.suggest_imputations(nulls).collect())
    assert got == {"i": "mean", "d": "mean", "s": "mode", "n": "mean"}


def test_allowed():
    assert allowed_strategies(T.DoubleType()) == ("mean", "median", "mode", "custom")
    assert allowed_strategies(T.StringType()) == ("mode", "custom")


def test_no_nulls_after(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id * 1.5 END AS x")
    out = tw.impute(df, [("x", "median")])
    assert out.where("x IS NULL").count() == 0


def test_approximate_median(spark):
    df = spark.range(10001).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS x")
    exact = tw.imputation_values(df, [("x", "median")])["x"][1]
    approx = tw.imputation_values(df, [("x", "median")], exact=False)["x"][1]
    import numpy as np
    assert exact == float(np.median([i for i in range(10001) if i % 10]))
    assert abs(approx - exact) <= 2          # within the sketch's rank error here
    assert tw.impute(df, [("x", "median")], exact=False).where("x IS NULL").count() == 0


def test_custom_text_follows_the_conversion_rules(spark):
    df = spark.createDataFrame([(None, None, None, None)], "i int, d date, x double, t timestamp_ntz")
    fill = lambda c, v: tw.impute(df, [{"column_name": c, "strategy": "custom", "value": v}]).first()[c]
    assert fill("i", "2.5") == 3 and str(fill("d", "2020/01/02")) == "2020-01-02"
    assert str(fill("t", "2020/01/02 03:04:05")) == "2020-01-02 03:04:05"
    for column, value in (("x", "1d"), ("t", "2020"), ("i", "x")):
        with pytest.raises(ValueError):
            fill(column, value)
