
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablewash as tw


def test_numeric_summary_matches_pandas_describe(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(10, 3, 500), "k": rng.integers(0, 50, 500)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in tw.numeric_summary(df).collect()}
    desc = pdf.describe(percentiles=[.25, .5, .75]).transpose()
    for col in ("x", "k"):
        d = desc.loc[col]
        r = got[col]
        assert r["count"] == int(d["count"])
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                             ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert r[ours] == pytest.approx(float(d[theirs]), rel=1e-9), (col, ours)
    approx = {r["column"]: r for r in tw.numeric_summary(df, exact=False).collect()}
    assert approx["k"]["count"] == got["k"]["count"]


def test_nan_inf(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,),
                                (1.0,), (2.0,)], "d double")
    r = tw.numeric_summary(df).first()
    assert r["count"] == 4                      # NaN and NULL are missing, infinities count
    assert r["mean"] is None and r["min"] is None and r["max"] is None
    prev = tw.preview(df, 5).collect()
    assert [p[0] for p in prev] == [None, None, None, None, 1.0]


def test_single_value_std_is_null(spark):
    r = tw.numeric_summary(spark.createDataFrame([(5.0,)], "d double")).first()
    assert r["std"] is None and r["p50"] == 5.0


def test_categorical_summary_and_topk(spark):
    vals = (["a"] * 5 + ["b"] * 5 + ["c"] * 4 + ["d"] * 3 + ["e"] * 2 + ["f"] * 2 + ["g"] * 1
            + [None] * 3)
    df = spark.createDataFrame([(v, 1) for v in vals], "s string, n int")
    cs = tw.categorical_summary(df).first()
    assert (cs["column"], cs["unique_count"], cs["mode"], cs["mode_count"]) == ("s", 7, "a", 5)
    top = [(r["rank"], r["value"], r["count"]) for r in
           tw.top_values(df, 5).orderBy("rank").collect()]
    assert top == [(1, "a", 5), (2, "b", 5), (3, "c", 4), (4, "d", 3), (5, "e", 2)]  # tie at 5 -> e
    text = tw.top_values_text(tw.top_values(df, 3)).first()["top_values"]
    assert text == "a (5); b (5); c (4)"
    approx = tw.categorical_summary(df, approx=True).first()
    assert approx["unique_count"] == 7


def test_topk_ties_at_50(spark):
    data = [(f"v{i:02d}",) for i in range(60) for _ in range(1 if i >= 45 else 2)]
    df = spark.createDataFrame(data, "s string")
    top = tw.top_values(df, 50).collect()
    assert len(top) == 50
    assert max(r["value"] for r in top) == "v49"


def test_categorical_empty_column_listed(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    r = tw.categorical_summary(df).first()
    assert (r["unique_count"], r["mode"]) == (0, None)


def test_correlation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    y = 0.5 * x + rng.normal(size=400)
    w = rng.normal(size=400) * 1e-3 + 1e6
    pdf = pd.DataFrame({"x": x, "y": y, "z": 3.0, "w": w})
    pdf.loc[::5, "x"] = np.nan
    pdf.loc[::7, "y"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {(r["col1"], r["col2"]): r["correlation"] for r in tw.correlation_pairs(df).collect()}
    corr = pdf[["x", "y", "z", "w"]].corr()
    assert ("x", "z") not in got and ("y", "z") not in got        # constant column dropped
    for (a, b), v in got.items():
        assert v == round(corr.loc[a, b], 4), (a, b)
    assert set(got) == {("x", "y"), ("x", "w"), ("y", "w")}


def test_correlation_matrix_and_bands(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", -0.3), ("b", "c", 0.1)],
                                  "col1 string, col2 string, correlation double")
    m = {r["column"]: r for r in tw.correlation_matrix(pairs).collect()}
    assert m["a"]["a"] == 1.0 and m["b"]["a"] == 0.9 and m["c"]["a"] == -0.3
    bands = {(r["row_col"], r["col_col"]): r["band"] for r in tw.correlation_long(pairs).collect()}
    assert bands[("a", "b")] == "very_strong" and bands[("a", "c")] == "moderate"
    assert bands[("b", "c")] == "weak"


def test_numeric_table(spark):
    df = spark.createDataFrame([(1.005,), (None,)], "d double")
    t = tw.numeric_table(tw.numeric_summary(df)).first()
    assert t["std_text"] == "N/A" and t["mean_text"] in ("1.00", "1.01")


def test_statistical_summary(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (3, "b", 7.0)],
                               "i int, s string, d double")
    s = tw.statistical_summary(df)
    assert (s.total_rows, s.total_columns) == (3, 3)
    assert s.numeric_summary.count() == 2 and s.categorical_summary.count() == 1
    assert s.correlation_pairs.count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "i int, s string, d double")
    assert tw.numeric_summary(df).first()["count"] == 0
    assert tw.categorical_summary(df).first()["unique_count"] == 0
    assert tw.correlation_pairs(df).count() == 0


def test_correlation_wide_block_matches_pandas(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 1))
    data = base + rng.normal(size=(300, 12)) * np.linspace(0.1, 3, 12)
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(12)])
    pdf["n"] = pdf["c0"] * 2 + rng.normal(size=300)
    pdf.loc[::4, "n"] = np.nan                      # one NULL-bearing column
    df = spark.createDataFrame(pdf)
    got = {(r["col1"], r["col2"]): r["correlation"] for r in tw.correlation_pairs(df).collect()}
    corr = pdf.corr()
    assert len(got) == 13 * 12 // 2
    for (a, b), v in got.items():
        assert v == pytest.approx(round(corr.loc[a, b], 4), abs=1e-4), (a, b)


def test_summary_to_dict(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (3, "b", 7.0)],
                               "i int, s string, d double")
    d = tw.statistical_summary(df).to_dict()
    assert d["numeric_summary"]["i"]["50%"] == 2.0 and d["numeric_summary"]["d"]["count"] == 3
    assert d["categorical_summary"]["s"] == {"unique_count": 2, "mode": "a",
                                             "top_5_frequencies": {"a": 2, "b": 1}}
    assert d["correlation_matrix"][0]["col1"] == "i" and (d["total_rows"], d["total_columns"]) == (3, 3)
    assert list(d["categorical_summary"]["s"]["top_5_frequencies"]) == ["a", "b"]
    ins = tw.insights_list(tw.detect_insights(df))
    assert [(i["type"], i["affected_columns"]) for i in ins] == [("correlation", ["i", "d"])]


def test_correlation_many_null_pairs(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(400, 1))
    data = base + rng.normal(size=(400, 9)) * np.linspace(0.2, 2, 9)
    pdf = pd.DataFrame(data, columns=[f"n{i}" for i in range(9)])
    for i in range(9):                       # NULLs (and NaN) in every column, different rows
        pdf.loc[(np.arange(400) % (i + 5)) == 0, f"n{i}"] = np.nan
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    df = df.withColumn("n0", F.when(F.col("n0") > 2.5, F.lit(float("nan"))).otherwise(F.col("n0")))
    got = {(r["col1"], r["col2"]): r["correlation"] for r in tw.correlation_pairs(df).collect()}
    ref = df.toPandas().astype(float).corr()
    assert len(got) == 36
    for (a, b), v in got.items():
        assert v == pytest.approx(round(ref.loc[a, b], 4), abs=1e-4), (a, b)


@pytest.mark.parametrize("tile", [64, 5])
def test_correlation_tiles(spark, monkeypatch, tile):
    from tablewash.operators import eda
    monkeypatch.setattr(eda, "TILE", tile)
    monkeypatch.setattr(eda, "CELLS", 100)
    rng = np.random.default_rng(8)
    data = rng.normal(size=(250, 1)) + rng.normal(size=(250, 17)) * np.linspace(0.1, 2, 17) + 1e6
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(17)])
    pdf.loc[3, "c4"] = np.nan                       # a stray missing value
    got = {(r["col1"], r["col2"]): r["correlation"]
           for r in tw.correlation_pairs(spark.createDataFrame(pdf)).collect()}
    assert len(got) == 17 * 16 // 2
    corr = pdf.corr()
    for (a, b), v in got.items():
        assert v == pytest.approx(round(corr.loc[a, b], 4), abs=1e-4)


def test_correlation_plan_does_not_depend_on_nulls(spark, monkeypatch):
    """The same jobs with and without a stray NULL, for few columns and for many."""
    from tablewash.operators import eda
    calls = []
    real = eda._comoments
    monkeypatch.setattr(eda, "_comoments", lambda *a: calls.append(1) or real(*a))
    for k in (2, 150):
        for stray in ("id", "IF(id = 5, NULL, id)"):
            df = spark.range(40).selectExpr(f"CAST({stray} AS DOUBLE) AS c0", *[f"(id * {i + 3}) % 7 AS c{i + 1}" for i in range(k - 1)])
            assert tw.correlation_pairs(df).where("col1 = 'c0'").count() == k - 1 - (k - 1 + 2) // 7
    assert len(calls) == 4


def test_correlation_constant_on_common_rows(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 3.0), (None, 4.0), (7.3, None)], "a double, b double")
    assert tw.correlation_pairs(df).count() == 0
