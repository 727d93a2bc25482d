"""Cleaning plan (I12) and physical-plan checks."""

import pytest
from pyspark.sql import functions as F

import tablewash as tw


@pytest.fixture
def raw(spark):
    data = [(1, " Bob ", " 3.5 ", "M"), (1, " Bob ", " 3.5 ", "M"), (2, "ann", "N/A", "f"),
            (3, "Cy", "4", None), (4, "?", "bad", "m")]
    return spark.createDataFrame(data, "`User ID` int, Name string, Score string, Sex string")


def test_full_sequence(raw):
    out, log = tw.CleaningPlan(drop_columns=["sex"]).run(raw)
    assert out.columns == ["userid", "name", "score"]   # the space is removed, not joined
    assert out.count() == 4
    assert dict(out.dtypes)["score"] == "string"     # 'bad' keeps it under 95%
    steps = [s for s, _ in log]
    assert steps[0] == "auto_clean" and steps[-1] == "drop_columns"
    assert out.where("name IS NULL").count() == 0    # mode filled


def test_skip_everything(raw):
    out, log = tw.CleaningPlan(auto_clean="skip", remove_duplicates="skip", convert_types="skip",
                               impute_nulls="skip").run(raw)
    assert out.count() == 5 and all(m == "skip" for _, m in log)


def test_checkpointed_plan(raw):
    out, _ = tw.CleaningPlan(checkpoint=True, convert_types=[("score", "DOUBLE")]).run(raw)
    assert out.count() == 4 and dict(out.dtypes)["score"] == "double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udfs_anywhere(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for df in (tw.auto_clean(li), tw.value_counts(li), tw.top_values(li),
               tw.exact_duplicate_rows(li), tw.entity_duplicates(li, "l_orderkey"),
               tw.bar_chart_data(li, "l_returnflag"), tw.scatter_data(li, "l_tax", "l_discount"),
               tw.convert_types(li, [("l_returnflag", "DOUBLE")])):
        plan = _plan(df)
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_null_counts_single_scan_no_shuffle(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = _plan(tw.null_counts(li))
    assert plan.count("FileScan parquet") == 1
    assert "Exchange hashpartitioning" not in plan


def test_top_values_limits_before_shuffle(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = tw.top_values(ev, 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in plan
    # partial aggregation before the exchange of (column, value)
    assert "partial_count" in plan


def test_bar_chart_is_take_ordered(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = _plan(tw.bar_chart_data(o, "o_orderpriority"))
    assert "TakeOrderedAndProject" in plan
    o_plan = o.select("o_orderpriority")
    scan = [l for l in _plan(tw.bar_chart_data(o, "o_orderpriority")).splitlines() if "FileScan" in l][0]
    assert "ReadSchema: struct<o_orderpriority:string>" in scan
    assert "IsNotNull(o_orderpriority)" in scan


def test_materialize_modes(raw):
    plan = tw.CleaningPlan(materialize="persist")
    out, _ = plan.run(raw)
    assert out.count() == 4 and len(plan._held) == 1
    plan.release()
    assert plan._held == []
    out2, _ = tw.CleaningPlan(materialize=None).run(raw)
    assert sorted(map(tuple, out2.collect())) == sorted(map(tuple, out.collect()))
    with pytest.raises(ValueError):
        tw.CleaningPlan(materialize="disk").run(raw)


def test_modes_batched_by_type(spark):
    from tablewash.operators.impute import mode_values
    df = spark.createDataFrame([("a", "x", 1.0, 5), ("b", "x", 2.0, 5), ("b", "y", 2.0, 6),
                                ("a", None, float("nan"), None)], "s string, t string, d double, i int")
    assert mode_values(df, ["s", "t", "d", "i"]) == {"s": "a", "t": "x", "d": 2.0, "i": 5}


def test_fused_plan_equals_composed_operators(spark):
    rows = []
    for k in range(200):
        num_txt = None if k % 9 == 0 else ("NaN" if k % 50 == 0 else f" {k * 1.5} ")
        rows.append((k % 17 if k % 6 else None, num_txt,
                     None if k % 4 == 0 else ["a", "b", "c"][k % 3],
                     float("nan") if k % 23 == 0 else (None if k % 8 == 0 else k / 7.0)))
    rows += rows[:15]
    raw = spark.createDataFrame(rows, "K int, `Num Text` string, Cat string, d double")
    out, log = tw.CleaningPlan().run(raw)

    cleaned = tw.remove_duplicates(tw.auto_clean(raw))
    convs = tw.suggested_conversions(tw.suggest_types(cleaned))
    report = {r["column_name"]: r["conversion_failures"]
              for r in tw.conversion_report(cleaned, convs).collect()}
    conv = tw.convert_types(cleaned, convs)
    imps = [r.asDict() for r in tw.suggest_imputations(conv).collect()]
    want = tw.impute(conv, imps)

    assert out.columns == want.columns and out.dtypes == want.dtypes
    key = repr
    norm = lambda rows: sorted((tuple("nan" if x != x else x for x in r) for r in rows), key=key)
    assert norm(out.collect()) == norm(want.collect())
    conv_log = [m for s, m in log if s == "convert_types"]
    assert conv_log == [f"{c}: Success -> DOUBLE ({report[c]} failures)" for c, _ in
                        [(d["column_name"], d["new_type"]) for d in convs]]


def test_survey_rides_on_the_checkpoint(spark, monkeypatch):
    """With a checkpoint no pass of its own answers the survey; plan and log are the same."""
    from tablewash.plans import cleaning
    rows = [(k % 7, f" {k * 1.5} " if k % 5 else "oops" if k % 50 else None, None if k % 4 else "b", k / 4.0 if k % 6 else None)
            for k in range(120)]
    raw = spark.createDataFrame(rows + rows[:30], "k int, num string, cat string, d double")
    for plan in ({}, {"convert_types": [("num", "DOUBLE"), ("nope", "INTEGER")]}, {"impute_nulls": "skip"}):
        want, want_log = tw.CleaningPlan(materialize="persist", **plan).run(raw)
        asked = []
        real = cleaning._survey
        monkeypatch.setattr(cleaning, "_survey", lambda *a: asked.append(len(a)) or real(*a))
        out, log = tw.CleaningPlan(materialize="checkpoint", **plan).run(raw)
        monkeypatch.setattr(cleaning, "_survey", real)
        assert asked == [5] and log == want_log and out.dtypes == want.dtypes
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_eda_report_shares_one_summary(spark):
    rows = [(float(i), float(i) * 2 + (i % 3), "y" if i % 20 else "x") for i in range(200)]
    df = spark.createDataFrame(rows, "p double, q double, f string")
    rep = tw.eda_report(df)
    assert rep.summary.total_rows == 200
    kinds = [r["type"] for r in rep.insights.collect()]
    assert kinds == ["correlation", "distribution"]
    assert rep.chart_suggestions.count() >= 2
