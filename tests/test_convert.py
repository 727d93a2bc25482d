import datetime as dt
import math

import pytest

import tablewash as tw

CASTABLE = ["1", "1.5", "2.5", "1e3", "1d", "2F", "1_000", "0x10", "NaN", "inf", "", None,
            " 7 ", "+5", "-1.5", ".5", "99999999999", "Infinity"]


@pytest.fixture
def castable(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(CASTABLE)], "i int, t string")


def _conv(df, typ):
    return {r["i"]: r["t"] for r in tw.convert_types(df, [("t", typ)]).collect()}


def test_to_double(castable):
    got = _conv(castable, "DOUBLE")
    v = dict(zip(CASTABLE, (got[i] for i in range(len(CASTABLE)))))
    assert v["1"] == 1.0 and v["1.5"] == 1.5 and v["1e3"] == 1000.0
    assert v["1d"] is None and v["2F"] is None          # Java suffix guard
    assert v["1_000"] is None and v["0x10"] is None
    assert math.isnan(v["NaN"]) and v["inf"] == float("inf") and v["Infinity"] == float("inf")
    assert v[""] is None and v[None] is None
    assert v[" 7 "] == 7.0 and v["+5"] == 5.0


def test_to_integer_rounds_half_away_from_zero(castable):
    got = _conv(castable, "INTEGER")
    v = dict(zip(CASTABLE, (got[i] for i in range(len(CASTABLE)))))
    assert v["1.5"] == 2 and v["2.5"] == 3 and v["-1.5"] == -2 and v[".5"] == 1
    assert v["1e3"] == 1000
    assert v["99999999999"] is None and v["inf"] is None and v["1d"] is None


def test_bigint_text_stays_exact(spark):
    df = spark.createDataFrame([("9007199254740993",)], "t string")
    assert tw.convert_types(df, [("t", "BIGINT")]).first()[0] == 9007199254740993


def test_double_to_integer_rounds_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "d double")
    assert [r[0] for r in tw.convert_types(df, [("d", "INTEGER")]).collect()] == [2, 4, -2]


def test_dates(spark):
    vals = ["2020-01-01", "2020-1-1", "2020/01/01", "2020", "2020-02-30", "01/02/2020",
            "1995-01-01 00:00:00"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    got = {r["i"]: r["t"] for r in tw.convert_types(df, [("t", "DATE")]).collect()}
    d = dt.date(2020, 1, 1)
    assert [got[i] for i in range(len(vals))] == [d, d, d, None, None, None, dt.date(1995, 1, 1)]


def test_keeps_position_and_report(castable, spark):
    df = castable.select("t", "i")
    out, report = tw.convert_with_report(df, [{"column_name": "t", "new_type": "DOUBLE"},
                                              {"column_name": "zz", "new_type": "DOUBLE"},
                                              {"column_name": "i", "new_type": "GEOMETRY"}])
    assert out.columns == ["t", "i"]
    rep = {r["column_name"]: r for r in report.collect()}
    assert rep["t"]["status"] == "Success"
    # present before, NULL after: 1d, 2F, 1_000, 0x10 and the empty string
    assert rep["t"]["conversion_failures"] == 5
    assert rep["zz"]["status"] == "Failed" and "not found" in rep["zz"]["error"]
    assert rep["i"]["status"] == "Failed" and "unsupported" in rep["i"]["error"]


def test_failures_plus_converted_equals_present(castable):
    rep = tw.conversion_report(castable, [("t", "INTEGER")]).first()
    present = castable.where("t IS NOT NULL").count()
    converted = tw.convert_types(castable, [("t", "INTEGER")]).where("t IS NOT NULL").count()
    assert rep["conversion_failures"] + converted == present


def test_duplicate_entry_rejected(castable):
    with pytest.raises(ValueError, match="twice"):
        tw.convert_types(castable, [("t", "DOUBLE"), ("t", "INTEGER")])


def test_suggest_threshold(spark):
    def frame(good):
        data = [(str(i),) for i in range(good)] + [("x",)] * (100 - good) + [("",), (None,)]
        return spark.createDataFrame(data, "t string")
    assert tw.suggest_types(frame(95)).count() == 0          # exactly 0.95: not suggested
    row = tw.suggest_types(frame(96)).first()
    assert (row["column_name"], row["current_type"], row["suggested_type"], row["confidence"]) == \
        ("t", "VARCHAR", "DOUBLE", 0.96)


def test_suggest_plan_round_trip(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "n string, s string")
    plan = tw.suggested_conversions(tw.suggest_types(df))
    assert plan == [{"column_name": "n", "new_type": "DOUBLE"}]
    assert dict(tw.convert_types(df, plan).dtypes)["n"] == "double"


def test_empty(spark):
    df = spark.createDataFrame([], "t string")
    assert tw.suggest_types(df).count() == 0
    assert tw.conversion_report(df, [("t", "DOUBLE")]).first()["conversion_failures"] == 0
