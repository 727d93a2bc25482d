import pytest

import tablewash as tw


def test_bar_chart_top50_ties_by_value(spark):
    data = [(f"v{i:02d}",) for i in range(60) for _ in range(2 if i < 40 else 1)] + [(None,)] * 5
    df = spark.createDataFrame(data, "s string")
    got = tw.bar_chart_data(df, "s").collect()
    assert len(got) == 50
    assert got[0]["y"] == 2 and got[-1]["x"] == "v49"
    assert all(r["x"] is not None for r in got)
    assert tw.chart_data(df, "histogram", "s").count() == 50


@pytest.mark.parametrize("n,nulls,expected", [(1000, 0, 1000), (1001, 1, 1000), (1100, 0, 1000),
                                              (10, 3, 7)])
def test_scatter_sample_size(spark, n, nulls, expected):
    rows = [(float(i), None if i < nulls else float(i) * 2) for i in range(n)]
    df = spark.createDataFrame(rows, "x double, y double")
    out = tw.scatter_data(df, "x", "y")
    got = out.collect()
    assert len(got) == expected and all(r["y"] is not None for r in got)


def test_scatter_seed_stable(spark):
    df = spark.range(5000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id * 3 AS DOUBLE) AS y")
    a = sorted(tuple(r) for r in tw.scatter_data(df, "x", "y", n=100, seed=1).collect())
    b = sorted(tuple(r) for r in tw.scatter_data(df, "x", "y", n=100, seed=1).collect())
    c = sorted(tuple(r) for r in tw.scatter_data(df, "x", "y", n=100, seed=2).collect())
    assert a == b and a != c


def test_dispatch_and_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError):
        tw.chart_data(df, "pie", "x")
    with pytest.raises(ValueError):
        tw.chart_data(df, "bar_chart", "nope")
    assert tw.chart_data(df, "bar_chart", "nope", missing="empty").count() == 0
    assert tw.chart_data(df, "bar_chart", "x", y="nope", missing="empty").count() == 0
    with pytest.raises(ValueError):
        tw.chart_data(df, "scatter_plot", "x")


def test_suggest_charts(spark):
    rows = [(float(i), float(i) * 2 + (i % 3), ["a", "b", "c"][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    got = tw.suggest_charts(df).collect()
    assert 1 <= len(got) <= 5
    kinds = {r["chart_type"] for r in got}
    assert "scatter_plot" in kinds and "bar_chart" in kinds
    sc = [r for r in got if r["chart_type"] == "scatter_plot"][0]
    assert (sc["x_axis"], sc["y_axis"]) == ("x", "y")


def _smallest_keys(points, n, seed):
    """The definition: every copy's key, the n smallest."""
    import hashlib
    from collections import Counter

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    keyed = [(md5(md5(f"{seed}|{x}|{y}") + f":{k}"), (x, y)) for (x, y), m in Counter(points).items() for k in range(1, m + 1)]
    return sorted(p for _, p in sorted(keyed)[:n])


@pytest.mark.parametrize("n", [1, 300, 5000])
@pytest.mark.parametrize("copies", [1 << 16, 7])
def test_scatter_takes_the_smallest_keys_in_any_layout(spark, monkeypatch, n, copies):
    from tablewash.operators import charts
    monkeypatch.setattr(charts, "COPIES", copies)
    points = [(i % 1009, i % 7) for i in range(3000)] + [(5, 5)] * 2000 + [(6, 6)] * 2
    want = _smallest_keys(points, n, 5)
    df = spark.createDataFrame([(*p, None) for p in points] + [(1, None, 1)] * 9, "x int, y int, h int")
    for layout in (df, df.repartition(13, "y"), df.orderBy("x").coalesce(1)):
        assert sorted(tuple(r) for r in tw.scatter_data(layout, "x", "y", n=n, seed=5).collect()) == want


def test_scatter_share_of_a_hot_point(spark):
    df = spark.range(30000).selectExpr("IF(id % 3 = 0, 0, id) AS x", "IF(id % 3 = 0, 0.5D, id / 2D) AS y")
    got = tw.scatter_data(df, "x", "y", n=900, seed=3).collect()
    assert len(got) == 900 and 240 < sum(r["x"] == 0 for r in got) < 360
