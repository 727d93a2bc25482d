import pytest

import tablewash as tw

DUPES = [(1, "x", 1.0), (1, "x", 1.0), (2, "y", None), (2, "y", None), (2, "y", None),
         (3, "z", 2.0), (1, "w", 3.0)]


@pytest.fixture
def dupes(spark):
    return spark.createDataFrame(DUPES, "a int, b string, c double")


def test_count(dupes):
    assert tw.duplicates_count(dupes) == 3
    assert tw.duplicates_count(dupes) == dupes.count() - dupes.distinct().count()


def test_exact_sample_stated_meaning(dupes):
    got = [tuple(r) for r in tw.exact_duplicate_rows(dupes, 10).collect()]
    assert got == [(1, "x", 1.0)] * 2 + [(2, "y", None)] * 3
    assert [tuple(r) for r in tw.exact_duplicate_rows(dupes, 2).collect()] == [(1, "x", 1.0)] * 2


def test_hot_row_is_capped_per_group_not_in_result(spark):
    df = spark.range(100000).selectExpr("1 AS k", "'same' AS v")
    assert tw.exact_duplicate_rows(df, 10).count() == 10
    assert tw.exact_duplicate_rows(df, None).count() == 100000


def test_remove(dupes):
    out = tw.remove_duplicates(dupes)
    assert out.count() == 4
    assert tw.duplicates_count(out) == 0
    with pytest.raises(ValueError, match="unknown strategy"):
        tw.remove_duplicates(dupes, "remove_all")


ENTITIES = [(1, "a", 1), (1, "a", 1), (2, "b", 1), (2, "b", 2), (None, "c", 1), (None, "d", 2),
            (3, "e", 1), (4, None, 1), (4, "f", 1)]


@pytest.fixture
def entities(spark):
    return spark.createDataFrame(ENTITIES, "customer_id int, name string, v int")


def test_entity_keys(entities):
    keys = sorted(r[0] for r in tw.entity_duplicate_keys(entities, "customer_id").collect())
    assert keys == [2, 4]        # same key + other row (incl. NULL vs value); NULL keys never match


def test_entity_sample(entities):
    got = [tuple(r) for r in tw.entity_duplicates(entities, "customer_id", 10).collect()]
    assert got == [(2, "b", 1), (2, "b", 2), (4, None, 1), (4, "f", 1)]


def test_entity_key_heuristic(spark, entities):
    assert tw.entity_key(entities) == "customer_id"
    assert tw.entity_key_df(entities).first()[0] == "customer_id"
    # substring rule: 'width' matches 'id'; unique width is skipped; name repeats
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "width int, name string, id int")
    assert tw.entity_key(df) == "name"
    # a unique column with one NULL counts as repeated (COUNT DISTINCT skips NULL)
    df2 = spark.createDataFrame([(1,), (None,)], "user_id int")
    assert tw.entity_key(df2) == "user_id"
    assert tw.entity_key(spark.createDataFrame([(1,)], "zzz int")) is None
    with pytest.raises(ValueError):
        tw.entity_key(entities, key="nope")


def test_find_duplicates_report(dupes, entities):
    rep = tw.find_duplicates(dupes).to_dict()
    assert rep["exact_duplicates"]["count"] == 3
    assert len(rep["exact_duplicates"]["sample"]) == 5
    rep2 = tw.find_duplicates(entities, key="customer_id")
    assert rep2.checked_column == "customer_id"
    assert [r["customer_id"] for r in rep2.entity_sample] == [2, 2, 4, 4]


def test_nan_and_arrays(spark):
    df = spark.createDataFrame([(1, float("nan"), [1.0]), (1, float("nan"), [1.0]),
                                (2, 1.0, [1.0]), (2, float("nan"), [1.0])],
                               "k int, d double, a array<double>")
    assert tw.duplicates_count(df) == 1
    assert [r[0] for r in tw.entity_duplicate_keys(df, "k").collect()] == [2]


def test_empty(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert tw.duplicates_count(df) == 0
    assert tw.exact_duplicate_rows(df).count() == 0
    assert tw.entity_duplicates(df, "a").count() == 0


def test_fixed_width_and_general_paths_agree(spark):
    rows = [(k % 37, (k * 7) % 3 if k % 5 else None, float(k % 2) if k % 11 else None)
            for k in range(400)]
    num = spark.createDataFrame(rows, "k int, a int, b double")
    txt = num.selectExpr("k", "CAST(a AS STRING) AS a", "b")     # forces the general path
    expect = (num.distinct().where("k IS NOT NULL").groupBy("k").count()
              .where("count > 1").select("k"))
    want = sorted(r[0] for r in expect.collect())
    assert sorted(r[0] for r in tw.entity_duplicate_keys(num, "k").collect()) == want
    assert sorted(r[0] for r in tw.entity_duplicate_keys(txt, "k").collect()) == want
    a = [tuple(r) for r in tw.entity_duplicates(num, "k", 7).collect()]
    full = sorted((tuple(r) for r in tw.entity_duplicates(num, "k", None).collect()),
                  key=lambda t: tuple((x is not None, x) for x in t))
    assert a == full[:7]


def _messy(spark):
    rows = []
    for k in range(300):
        a = None if k % 7 == 0 else k % 13
        b = None if k % 5 == 0 else float(k % 4)
        rows.append((a, b, f"s{k % 3}" if k % 11 else None))
    rows += [(None, 1.0, "x"), (1, None, "x"), (1, 1.0, None), (None, None, None)]
    return spark.createDataFrame(rows, "a int, b double, c string")


def _truth(df):
    return df.count() - df.distinct().count()


def test_null_positions_stay_apart(spark):
    df = _messy(spark)
    assert tw.duplicates_count(df) == _truth(df)
    assert sorted(map(tuple, tw.remove_duplicates(df).collect()), key=repr) == \
        sorted(map(tuple, df.distinct().collect()), key=repr)
    pair = spark.createDataFrame([(None, 1.0), (1.0, None)], "a double, b double")
    assert tw.duplicates_count(pair) == 0 and tw.remove_duplicates(pair).count() == 2


def test_one_row_repeated_very_often(spark):
    """No array holds a row's copies: 300 million of one row are counted."""
    df = spark.range(300_000_000).selectExpr("1 AS k")
    assert tw.exact_duplicate_rows(df, None).count() == 300_000_000
    assert tw.exact_duplicate_rows(df, 70_000).count() == 70_000


def test_entity_keys_exact_under_hash_collisions(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tablewash.operators import dedup
    rows = [(k % 23, f"v{(k * 5) % 3}" if k % 4 else None, k % 2) for k in range(300)]
    rows += [(99, "same", 1)] * 3
    df = spark.createDataFrame(rows, "k int, s string, b int")
    want = sorted(r[0] for r in df.distinct().groupBy("k").count().where("count > 1")
                  .select("k").collect())
    assert sorted(r[0] for r in tw.entity_duplicate_keys(df, "k").collect()) == want
    monkeypatch.setattr(dedup, "_keyed", lambda d: d.select(
        *d.columns, F.lit(7).cast("long").alias("__h1")))
    assert sorted(r[0] for r in tw.entity_duplicate_keys(df, "k").collect()) == want
    assert 99 not in want
