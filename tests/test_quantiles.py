import numpy as np
import pytest

from tablewash.operators import quantiles as Q


def _expect(vals, probs):
    arr = np.array([v for v in vals if v is not None and v == v], dtype=float)
    if arr.size == 0:
        return [None] * len(probs)
    return list(np.quantile(arr, probs, method="linear"))


@pytest.mark.parametrize("band", [10**6, 50])
def test_matches_numpy_with_ties_and_hot_value(spark, band):
    rng = np.random.default_rng(7)
    a = rng.normal(size=3000).round(2).tolist()
    b = [5.0] * 1500 + rng.integers(0, 10, 1500).astype(float).tolist()   # a third is one value
    c = [None] * 100 + [float("nan")] * 5 + rng.exponential(size=2000).tolist()
    rows = list(zip(a, b, c + [None] * (3000 - len(c))))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = Q.exact_quantiles(df, ["a", "b", "c"], probs, band_rows=band)
    for col, vals in (("a", a), ("b", b), ("c", c)):
        assert got[col] == pytest.approx(_expect(vals, probs), rel=1e-12, abs=1e-12), col


def test_integers_and_all_null(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None), (8, None)], "i int, n double")
    got = Q.exact_quantiles(df, ["i", "n"], [0.25, 0.5, 0.75])
    assert got["i"] == [1.75, 3.0, 5.0]
    assert got["n"] == [None, None, None]


def test_extra_aggs(spark):
    from pyspark.sql import functions as F
    df = spark.range(10).selectExpr("CAST(id AS DOUBLE) AS x")
    q, row = Q.exact_quantiles(df, ["x"], [0.5], extra_aggs=[F.max("x").alias("mx")])
    assert q["x"] == [4.5] and row["mx"] == 9.0


@pytest.mark.parametrize("bits,band", [(12, 50), (3, 1), (1, 7)])
def test_descent_stays_exact(spark, monkeypatch, bits, band):
    monkeypatch.setattr(Q, "BITS", bits)
    monkeypatch.setattr(Q, "CELLS", 1 << bits)
    rng = np.random.default_rng(3)
    a = rng.lognormal(size=5000).tolist()
    b = ([2.0] * 2000 + rng.integers(0, 50, 3000).astype(float).tolist())
    c = (rng.normal(size=4990) * 10.0 ** rng.integers(-300, 300, 4990)).tolist() + [0.0, -0.0, 5e-324, -5e-324, 1e308,
                                                                                  -1e308, 1.0, -1.0, 1.0, 1.0]
    df = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(df, ["a", "b", "c"], probs, band_rows=band)
    for name, vals in (("a", a), ("b", b), ("c", c)):
        assert got[name] == pytest.approx(_expect(vals, probs), rel=1e-12, abs=0), name


def test_keys_order_as_values():
    rng = np.random.default_rng(4)
    vals = sorted([*(rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)), 0.0, float("inf"), -float("inf"), 5e-324])
    keys = [Q._key(v) for v in vals]
    assert keys == sorted(keys) and [Q._value(k) for k in keys] == vals
    assert Q._key(-0.0) == Q._key(0.0)


def test_infinities(spark):
    vals = [float("inf")] * 3 + [-float("inf")] * 2 + [1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert Q.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], band_rows=1)["x"] == [-float("inf"), 2.0, float("inf")]


def test_passes_do_not_depend_on_layout_or_size(spark, monkeypatch):
    """The jobs of a search are bounded by the key width, whatever the values."""
    calls = []
    real = Q._cells
    monkeypatch.setattr(Q, "_cells", lambda *a: calls.append(1) or real(*a))
    rng = np.random.default_rng(6)
    vals = (rng.normal(size=20_000) * 10.0 ** rng.integers(-300, 300, 20_000)).tolist()
    for parts in (1, 7):
        calls.clear()
        got = Q.exact_quantiles(spark.createDataFrame([(v,) for v in vals], "x double").repartition(parts), ["x"], [0.3, 0.5], band_rows=0)
        assert got["x"] == pytest.approx(_expect(vals, [0.3, 0.5]), rel=1e-12) and len(calls) <= 6


def test_later_passes_read_only_the_values_in_range(spark, monkeypatch):
    monkeypatch.setattr(Q, "BITS", 5)
    monkeypatch.setattr(Q, "CELLS", 1 << 5)
    made = []
    real = Q._written
    monkeypatch.setattr(Q, "_written", lambda *a: made.append(real(*a)) or made[-1])
    vals = np.random.default_rng(5).normal(size=20_000).tolist()
    df = spark.createDataFrame([(v, 2 * v) for v in vals], "a double, b double")
    got = Q.exact_quantiles(df, ["a", "b"], [0.25, 0.5], band_rows=2)
    assert got["a"] == pytest.approx(_expect(vals, [0.25, 0.5]), rel=1e-12)
    assert got["b"] == pytest.approx(_expect([2 * v for v in vals], [0.25, 0.5]), rel=1e-12)
    assert len(made) == 1
    with pytest.raises(Exception):  # the table is gone again
        spark.read.parquet(made[0].path).count()
