import pytest

import tablewash as tw
from tablewash.operators.insights import correlation_insights


def _outlier_frame(spark, base, outliers, big):
    vals = [float(i) for i in range(1, base + 1)] + [big] * outliers
    return spark.createDataFrame([(v,) for v in vals], "v double")


@pytest.mark.parametrize("base,outliers,expected", [(95, 5, 0), (94, 6, 1), (594, 6, 0), (593, 7, 1)])
def test_outlier_rule(spark, base, outliers, expected):
    df = _outlier_frame(spark, base, outliers, 1e6)
    ins = tw.detect_insights(df).where("type = 'outlier'").collect()
    assert len(ins) == expected
    if expected:
        assert ins[0]["description"] == (f"Column 'v' has {outliers} values outside the typical "
                                         "1.5*IQR range. Review with a Box Plot.")
        assert ins[0]["affected_columns"] == ["v"]


@pytest.mark.parametrize("a_count,expected", [(90, 0), (91, 1)])
def test_imbalance_over_all_rows(spark, a_count, expected):
    vals = ["a"] * a_count + ["b"] * (95 - a_count) + [None] * 5
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    ins = tw.detect_insights(df).collect()
    assert len(ins) == expected
    if expected:
        assert ins[0]["severity"] == "info"
        assert "mode value ('a') making up 91% of the data" in ins[0]["description"]


def test_correlation_rule_uses_rounded_value(spark):
    pairs = spark.createDataFrame([("a", "b", 0.8), ("a", "c", -0.95), ("b", "c", 0.7999)],
                                  "col1 string, col2 string, correlation double")
    got = correlation_insights(pairs, ["a", "b", "c"]).orderBy("seq").collect()
    assert [tuple(r["affected_columns"]) for r in got] == [("a", "b"), ("a", "c")]
    assert got[0]["description"] == ("Columns 'a' and 'b' are highly correlated (0.8). "
                                     "Consider removing one for modeling.")


def test_order_correlation_outlier_distribution(spark):
    rows = [(float(i), float(i) * 2, "y") for i in range(1, 95)] + \
           [(1e6, 2e6 + 1, "y")] * 6 + [(1.0, 2.0, "x")] * 0
    df = spark.createDataFrame(rows, "p double, q double, f string")
    kinds = [r["type"] for r in tw.detect_insights(df).collect()]
    assert kinds[0] == "correlation" and "outlier" in kinds and kinds[-1] == "distribution"


def test_empty(spark):
    df = spark.createDataFrame([], "v double, s string")
    assert tw.detect_insights(df).count() == 0
