import pytest
from pyspark.sql import functions as F

import tablewash as tw
from tablewash.operators.clean import VALUES_MSG

DIRTY = [(1, "  male "), (2, "\tTab"), (3, "N/A"), (4, "NA"), (5, "null"), (6, "Null"),
         (7, "NULL"), (8, "?"), (9, ""), (10, "MiXed Case"), (11, None), (12, "   "),
         (13, " n/a ")]


@pytest.fixture
def dirty_text(spark):
    return spark.createDataFrame(DIRTY, "k int, t string")


def test_auto_clean_values(dirty_text):
    got = dict(tw.auto_clean(dirty_text).collect())
    assert got[1] == "MALE"
    assert got[2] == "\tTAB"          # trim strips spaces only
    for k in (3, 4, 5, 6, 8, 9, 11, 12):
        assert got[k] is None, k
    assert got[7] == "NULL"           # not in the list: kept, upper-cased
    assert got[10] == "MIXED CASE"
    assert got[13] == "N/A"           # case-sensitive list


def test_casing_options(dirty_text):
    low = dict(tw.clean_values(dirty_text, casing="lower").collect())
    assert low[10] == "mixed case"
    title = dict(tw.clean_values(dirty_text, casing="title").collect())
    assert title[10] == "Mixed Case"
    keep = dict(tw.clean_values(dirty_text, casing=None).collect())
    assert keep[10] == "MiXed Case"
    with pytest.raises(ValueError):
        tw.clean_values(dirty_text, casing="snake")


def test_extra_null_like(dirty_text):
    got = dict(tw.auto_clean(dirty_text, extra_null_like=("NULL",)).collect())
    assert got[7] is None


def test_auto_clean_names_and_log(spark):
    df = spark.createDataFrame([(1, " a ")], "`First Name` int, userID string")
    out, log = tw.auto_clean_with_log(df)
    assert out.columns == ["first_name", "user_id"]
    assert log[0] == "Renamed column 'First Name' to 'first_name'."
    assert log[-1] == VALUES_MSG
    assert out.collect()[0] == (1, "A")


def test_auto_clean_idempotent_except_recased_null_tokens(dirty_text):
    # NULL-like matching runs before upper-casing (the reference's order), so
    # ' n/a ' survives one pass as 'N/A' and only a second pass nulls it.
    once = dict(tw.auto_clean(dirty_text).collect())
    twice = dict(tw.auto_clean(tw.auto_clean(dirty_text)).collect())
    assert {k: v for k, v in once.items() if k != 13} == {k: v for k, v in twice.items() if k != 13}
    assert once[13] == "N/A" and twice[13] is None


def test_auto_clean_is_one_projection(dirty_text):
    plan = tw.auto_clean(dirty_text)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_odd_names(spark):
    df = spark.createDataFrame([(1, " x ", 2.0)], "`a.b` int, `c d` string, `e\"f` double")
    out = tw.auto_clean(df)
    assert out.columns == ["ab", "cd", "ef"]
    assert out.collect()[0] == (1, "X", 2.0)
    assert tw.clean_values(df).collect()[0] == (1, "X", 2.0)


def test_drop_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `c.d` int")
    assert tw.drop_columns(df, ["b", "c.d"]).columns == ["a"]
    assert tw.drop_columns(df, []).columns == df.columns
    with pytest.raises(ValueError, match="unknown"):
        tw.drop_columns(df, ["a", "zz"])
    assert tw.drop_columns_log([])["status"] == "skipped"


def test_not_null(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "a int, b int")
    assert tw.not_null(df, "a", "b").collect() == [(3, 4)]
    assert tw.not_null(df, "a").count() == 2


def test_empty(spark):
    df = spark.createDataFrame([], "k int, t string")
    assert tw.auto_clean(df).count() == 0


def test_streaming_clean(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "part1.csv").write_text("First Name,Age\n  bob ,  7 \nN/A,x\n")
    stream = tw.read_csv_stream(spark, str(d), ["First Name", "Age"])
    cleaned = tw.clean_stream(stream, conversions=[("age", "INTEGER")],
                              fill_values={"first_name": "UNKNOWN"})
    q = (cleaned.writeStream.format("memory").queryName("tw_stream_test")
         .outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(spark.sql("SELECT * FROM tw_stream_test").collect(), key=repr)
    assert [tuple(r) for r in got] == [("BOB", 7), ("UNKNOWN", None)]
    with pytest.raises(ValueError):
        tw.clean_stream(spark.range(1))


def test_sql_upper_single_character_rule(spark):
    from tablewash.functions.text import MULTI_UPPER, SQL_UPPER_OF, sql_upper
    df = spark.createDataFrame([("straße ﬁx ᾀ",), ("plain",), ("mit \U000F0001 ß",), (None,), ("",)],
                               "s string")
    got = [r[0] for r in df.select(sql_upper(F.col("s"))).collect()]
    assert got == ["STRAẞE ﬁX ᾈ", "PLAIN", "MIT \U000F0001 ẞ", None, ""]
    assert len(MULTI_UPPER) == len(SQL_UPPER_OF) == 102
    every = spark.createDataFrame([(MULTI_UPPER,)], "s string")
    assert every.select(sql_upper(F.col("s"))).first()[0] == SQL_UPPER_OF
