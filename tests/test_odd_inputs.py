"""Every public operator on odd column names and on an empty frame."""

import pytest

import tablewash as tw

ODD = "`a.b` int, `c d` string, `e\"f` double, `g``h` string"
ROWS = [(1, "x", 1.5, "p"), (1, "x", 1.5, "p"), (2, "y", None, "q"), (3, None, 4.0, "q"),
        (2, "z", 2.5, None)]


def _operators():
    return [
        ("profile", lambda df: tw.profile(df).to_dict()),
        ("null_counts", lambda df: tw.null_counts(df).collect()),
        ("profile_columns", lambda df: tw.profile_columns(df).collect()),
        ("auto_clean", lambda df: tw.clean_values(df).collect()),
        ("suggest_types", lambda df: tw.suggest_types(df).collect()),
        ("convert", lambda df: tw.convert_types(df, [(df.columns[1], "DOUBLE")]).collect()),
        ("report", lambda df: tw.conversion_report(df, [(df.columns[1], "DOUBLE")]).collect()),
        ("dups", lambda df: tw.duplicates_count(df)),
        ("exact_rows", lambda df: tw.exact_duplicate_rows(df).collect()),
        ("remove", lambda df: tw.remove_duplicates(df).collect()),
        ("entity_keys", lambda df: tw.entity_duplicate_keys(df, df.columns[0]).collect()),
        ("entity_rows", lambda df: tw.entity_duplicates(df, df.columns[0]).collect()),
        ("find", lambda df: tw.find_duplicates(df, key=df.columns[0]).to_dict()),
        ("impute", lambda df: tw.impute(df, [(df.columns[2], "median"), (df.columns[1], "mode"),
                                             (df.columns[0], "mean")]).collect()),
        ("suggest_imp", lambda df: tw.suggest_imputations(df).collect()),
        ("drop", lambda df: tw.drop_columns(df, [df.columns[0]]).collect()),
        ("numeric", lambda df: tw.numeric_summary(df).collect()),
        ("numeric_approx", lambda df: tw.numeric_summary(df, exact=False).collect()),
        ("categorical", lambda df: tw.categorical_summary(df).collect()),
        ("top", lambda df: tw.top_values(df).collect()),
        ("corr", lambda df: tw.correlation_pairs(df).collect()),
        ("summary", lambda df: tw.statistical_summary(df).to_dict()),
        ("insights", lambda df: tw.detect_insights(df).collect()),
        ("bar", lambda df: tw.bar_chart_data(df, df.columns[1]).collect()),
        ("scatter", lambda df: tw.scatter_data(df, df.columns[0], df.columns[2]).collect()),
        ("charts", lambda df: tw.suggest_charts(df).collect()),
        ("plan", lambda df: tw.CleaningPlan(auto_clean={"on_collision": "suffix"}).run(df)[0]
         .collect()),
        ("describe", lambda df: tw.describe(df).collect()),
        ("preview", lambda df: tw.preview(df).collect()),
    ]


@pytest.mark.parametrize("name,op", _operators(), ids=[n for n, _ in _operators()])
@pytest.mark.parametrize("empty", [False, True], ids=["rows", "empty"])
def test_odd_names_and_empty(spark, name, op, empty):
    df = spark.createDataFrame([] if empty else ROWS, ODD)
    op(df)


def test_odd_names_values(spark):
    df = spark.createDataFrame(ROWS, ODD)
    assert tw.duplicates_count(df) == 1
    assert [r[0] for r in tw.entity_duplicate_keys(df, "a.b").collect()] == [2]
    assert tw.categorical_summary(df).where("column = 'g`h'").first()["mode"] == "p"   # tie p/q: smallest


@pytest.mark.parametrize("empty", [False, True], ids=["rows", "empty"])
def test_odd_names_in_duplicates(spark, empty):
    df = spark.createDataFrame([] if empty else ROWS, ODD)
    assert tw.duplicates_count(df) == (0 if empty else 1)
    assert tw.remove_duplicates(df).count() == (0 if empty else 4)
    assert tw.exact_duplicate_rows(df).count() == (0 if empty else 2)
    assert [r[0] for r in tw.entity_duplicate_keys(df, "c d").collect()] == ([] if empty else [])
    assert sorted(r[0] for r in tw.entity_duplicate_keys(df, "g`h").collect()) == \
        ([] if empty else ["q"])
    assert tw.profile(df).to_dict()["duplicates_count"] == (0 if empty else 1)
    tw.find_duplicates(df, key="a.b").to_dict()


def test_decimal_columns(spark):
    from decimal import Decimal
    rows = [(Decimal("1.10"), 1), (Decimal("2.20"), 2), (None, 3), (Decimal("2.20"), 4),
            (Decimal("9.90"), 5)]
    df = spark.createDataFrame(rows, "d decimal(10,2), i int")
    s = {r["column"]: r for r in tw.numeric_summary(df).collect()}
    assert s["d"]["count"] == 4 and s["d"]["p50"] == pytest.approx(2.2)
    assert tw.correlation_pairs(df).count() == 1
    for strategy, want in (("mean", Decimal("3.85")), ("median", Decimal("2.20")),
                           ("mode", Decimal("2.20")), ("custom", Decimal("0.50"))):
        imp = {"column_name": "d", "strategy": strategy, "value": "0.5"}
        out = tw.impute(df, [imp]).where("i = 3").first()["d"]
        assert out == want, strategy
    assert tw.convert_types(spark.createDataFrame([("1.235",)], "t string"),
                            [("t", "DECIMAL(10,2)")]).first()[0] == Decimal("1.24")


def test_date_timestamp_boolean_columns(spark):
    import datetime as dt
    d1, d2 = dt.date(2020, 1, 1), dt.date(2021, 6, 30)
    t1 = dt.datetime(2020, 1, 1, 12, 0)
    rows = [(d1, t1, True), (d1, t1, True), (d2, None, False), (None, t1, None), (d2, t1, True)]
    df = spark.createDataFrame(rows, "d date, t timestamp_ntz, b boolean")
    out = tw.impute(df, [("d", "mode"), ("t", "mode"), ("b", "custom", "false")])
    row = out.where("d IS NOT NULL").collect()
    assert {r["d"] for r in row} == {d1, d2} and all(r["t"] == t1 for r in row)
    assert out.where("b IS NULL").count() == 0
    assert tw.numeric_summary(df).count() == 0 and tw.categorical_summary(df).count() == 0
    assert tw.duplicates_count(df) == 1
    assert tw.remove_duplicates(df).count() == 4
    assert tw.bar_chart_data(df, "d").first()["y"] == 2
    assert sorted(r[0] for r in tw.entity_duplicate_keys(df, "d").collect()) == [d2]
