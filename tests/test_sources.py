import pytest

import tablewash as tw

RAW = ('ID,First Name,userID,Age,Signup Date\n'
       '1,"Smith, John",u1,30,2020-01-01\n'
       '2,"He said ""hi""",u2,,2020/01/02\n'
       '3,"",u3,"",\n'
       '4,"line one\nline two",u4,41,2020-01-04\n'
       'ID,First Name,userID,Age,Signup Date\n')


def test_load_csv_all_text_empty_is_null(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text(RAW)
    df = tw.load_csv(spark, str(p), multi_line=True)
    assert df.columns == ["ID", "First Name", "userID", "Age", "Signup Date"]
    assert all(t == "string" for _, t in df.dtypes)
    rows = {r["ID"]: r for r in df.collect()}
    assert rows["1"]["First Name"] == "Smith, John"
    assert rows["2"]["First Name"] == 'He said "hi"'
    assert rows["2"]["Age"] is None
    assert rows["3"]["First Name"] is None and rows["3"]["Age"] is None
    assert rows["4"]["First Name"] == "line one\nline two"
    assert "ID" in rows                 # a repeated header is data, as in the reference


def test_suffix_check(spark, tmp_path):
    with pytest.raises(ValueError, match="CSV"):
        tw.load_csv(spark, str(tmp_path / "data.txt"))


def test_load_dir(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError, match="no CSV"):
        tw.load_csv_dir(spark, str(empty))
    one = tmp_path / "one"
    one.mkdir()
    (one / "a.csv").write_text("x\n1\n")
    (one / "notes.txt").write_text("hello")
    r = tw.load_csv_dir(spark, str(one))
    assert r.chosen == "a.csv" and r.frame.collect()[0][0] == "1"
    many = tmp_path / "many"
    many.mkdir()
    (many / "a.csv").write_text("x\n1\n")
    (many / "b.csv").write_text("y\n2\n")
    r = tw.load_csv_dir(spark, str(many))
    assert r.frame is None and r.available == ["a.csv", "b.csv"]
    assert tw.load_csv_dir(spark, str(many), "b.csv").frame.columns == ["y"]
    with pytest.raises(ValueError, match="Available files: a.csv, b.csv"):
        tw.load_csv_dir(spark, str(many), "c.csv")


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "a,b"), (3, 'q"q', "  pad ")],
                               "i int, s string, t string")
    out = str(tmp_path / tw.export_name("data.csv"))
    assert out.endswith("cleaned_data.csv")
    tw.export_csv(df, out, single_file=True)
    back = {r["i"]: r for r in tw.load_csv(spark, out).collect()}
    assert back["1"]["s"] is None
    assert back["2"]["s"] is None          # '' is written as "" and read back as NULL (S1 rule)
    assert back["2"]["t"] == "a,b" and back["3"]["s"] == 'q"q' and back["3"]["t"] == "  pad "
    text = "".join(p.read_text() for p in (tmp_path / "cleaned_data.csv").glob("part-*.csv"))
    assert text.splitlines()[0] == "i,s,t" and '2,"",a' in text.replace('"a,b"', "a")


def test_catalog(spark):
    df = spark.createDataFrame([(1,)], "a int")
    df.createOrReplaceTempView("project_tmp1")
    df.createOrReplaceTempView("project_tmp2")
    df.createOrReplaceTempView("other_tmp")
    assert {"project_tmp1", "project_tmp2"} <= set(tw.list_tables(spark))
    assert tw.drop_tables_with_prefix(spark, "project_tmp") == 2
    assert "project_tmp1" not in tw.list_tables(spark)
    assert "other_tmp" in tw.list_tables(spark)
    with pytest.raises(ValueError):
        tw.drop_tables_with_prefix(spark, "")
    assert tw.project_table_name(7) == "project_7"


def test_describe_and_preview(spark):
    df = spark.createDataFrame([(i, float(i), f"s{i}") for i in range(10)],
                               "i int, d double, s string")
    assert [tuple(r) for r in tw.describe(df).collect()] == [
        ("i", "INTEGER", "YES"), ("d", "DOUBLE", "YES"), ("s", "VARCHAR", "YES")]
    assert len(tw.preview_rows(df)) == 5


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    p = tw.profile(df).to_dict()
    assert p["total_rows"] == 3 and p["total_columns"] == 2
    assert p["null_counts"] == {"b": 2} and p["duplicates_count"] == 1
    assert len(p["sample_preview"]) == 3
    assert p["schema"][0] == {"column_name": "a", "column_type": "INTEGER", "null": "YES",
                              "key": None, "default": None, "extra": None}
    e = tw.profile(spark.createDataFrame([], "a int")).to_dict()
    assert e["total_rows"] == 0 and e["duplicates_count"] == 0


def test_csv_extra_fields_are_no_silent_loss(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b,c\n1,2,3\n1,3,4,5,6\n7,8\n9,9,9,\n\"x,y\",2,3\n")
    with pytest.raises(Exception, match="more fields than the header"):
        tw.load_csv(spark, str(p)).select("b").collect()
    kept = tw.load_csv(spark, str(p), bad_rows="drop")
    assert sorted(map(tuple, kept.collect())) == [("1", "2", "3"), ("7", "8", None), ("x,y", "2", "3")]
    bad = tw.csv_bad_rows(spark, str(p)).collect()
    assert sorted(r["record"] for r in bad) == ["1,3,4,5,6", "9,9,9,"]


def test_csv_quoted_newlines(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n1,"two\nlines"\n2,"q ""x"" q"\n')
    want = [("1", "two\nlines"), ("2", 'q "x" q')]
    assert sorted(map(tuple, tw.load_csv(spark, str(p)).collect())) == want
    assert sorted(map(tuple, tw.load_csv(spark, str(p), multi_line=True).collect())) == want
    with pytest.raises(Exception, match="multi_line=True"):
        tw.load_csv(spark, str(p), multi_line=False).collect()
    plain = tmp_path / "y.csv"
    plain.write_text('a,b\n1,"x,y"\n2,\n')
    assert sorted(map(tuple, tw.load_csv(spark, str(plain), multi_line=False).collect())) == [("1", "x,y"), ("2", None)]


def test_csv_blank_header_names(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text(",a,,a\n0,1,2,3\n")
    df = tw.load_csv(spark, str(p))
    assert df.columns == ["Unnamed: 0", "a", "Unnamed: 2", "a.1"] and tuple(df.first()) == ("0", "1", "2", "3")


def test_drop_with_stored_view(spark):
    tw.save_table(spark.range(3), "vw_t")
    spark.sql("CREATE VIEW vw_v AS SELECT * FROM vw_t")
    spark.range(1).createOrReplaceTempView("vw_temp")
    assert tw.drop_tables_with_prefix(spark, "vw_") == 3
    assert not [t for t in tw.list_tables(spark) if t.startswith("vw_")]


def test_profile_columns_shuffles_no_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = tw.operators.profile_columns(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" not in plan


def test_save_list_and_drop_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "a int, b string")
    name = tw.save_table(df, tw.project_table_name("t1"))
    assert name == "project_t1" and "project_t1" in tw.list_tables(spark)
    assert sorted(map(tuple, spark.table("project_t1").collect())) == [(1, "a"), (2, "b")]
    tw.save_table(df.limit(1), "project_t1")                 # replaced, not appended
    assert spark.table("project_t1").count() == 1
    assert tw.drop_tables_with_prefix(spark, "project_t") == 1
    assert "project_t1" not in tw.list_tables(spark)


def test_failed_overwrite_leaves_the_old_table(spark):
    from pyspark.sql import functions as F
    tw.save_table(spark.range(5), "keep_t")
    bad = spark.range(1000).select(F.when(F.col("id") == 999, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken row"):
        tw.save_table(bad, "keep_t")
    assert spark.table("keep_t").count() == 5
    tw.save_table(spark.table("keep_t").where("id > 2"), "default.keep_t")  # reads what it replaces
    assert sorted(r[0] for r in spark.table("keep_t").collect()) == [3, 4]
    tw.save_table(spark.range(1), "keep_t", mode="append")
    assert spark.table("keep_t").count() == 3
    assert [t for t in tw.list_tables(spark) if t.startswith("keep_t")] == ["keep_t"]  # nothing left beside it
    assert tw.drop_tables_with_prefix(spark, "keep_t") == 1


def test_csv_odd_header_round_trip(spark, tmp_path):
    p = tmp_path / "odd.csv"
    p.write_text('a.b,c d,"e""f"\n1,,x\n2,y,\n')
    df = tw.load_csv(spark, str(p))
    assert df.columns == ["a.b", "c d", 'e"f']
    assert [tuple(r) for r in df.orderBy("`a.b`").collect()] == [("1", None, "x"), ("2", "y", None)]
    out = str(tmp_path / "out.csv")
    tw.export_csv(df, out, single_file=True)
    back = tw.load_csv(spark, out)
    assert back.columns == df.columns and back.count() == 2


def test_repeated_header_names_numbered(spark, tmp_path):
    import io

    import pandas as pd
    headers = ["id,x,x,x,x.1", "a,a,a", "a,a.1,a", "a,a,a.1,a.2,a", "b,a,b.1,b,a,b"]
    for i, h in enumerate(headers):
        p = tmp_path / f"dup{i}.csv"
        width = len(h.split(","))
        p.write_text(h + "\n" + ",".join(str(j) for j in range(width)) + "\n")
        want = list(pd.read_csv(io.StringIO(p.read_text()), dtype=str).columns)
        df = tw.load_csv(spark, str(p))
        assert df.columns == want, h
        assert tuple(df.first()) == tuple(str(j) for j in range(width))
    q = tmp_path / "plain.csv"
    q.write_text("a,b\n1,2\n")
    assert tw.load_csv(spark, str(q)).columns == ["a", "b"]


def test_blank_lines_and_short_rows(spark, tmp_path):
    p = tmp_path / "gaps.csv"
    p.write_text("a,b,c\n1,2,3\n\n4,5\n\n")
    rows = [tuple(r) for r in tw.load_csv(spark, str(p)).collect()]
    assert rows == [("1", "2", "3"), ("4", "5", None)]


# --- records across lines and splits ----------------------------------------

_FIELDS = ["a", "", "two words", 'x"y', '"', '""', ",", "line\nbreak", "\n", "a\r\nb", '"\n"', ' "lead', "é\n日", "\n\n\n", '5" pipe']


def _csv_field(rnd, value):
    if any(c in value for c in '",\n\r') or rnd.random() < 0.3:
        if value == '5" pipe' and rnd.random() < 0.5:
            return value  # a quote inside an unquoted field
        return '"' + value.replace('"', '""') + '"'
    return value


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["40", "333", "128m"])
def test_records_equal_the_one_task_reader(spark, tmp_path, end, split):
    import random

    rnd = random.Random(len(end))
    name = '"na\nme"' if end == "\n" else "name"  # Spark takes the first line end it sees for the file's
    for k in range(3):
        body = end.join(",".join(_csv_field(rnd, rnd.choice(_FIELDS)) for _ in range(3)) for _ in range(rnd.choice([0, 1, 60, 150])))
        (tmp_path / f"f{k}.csv").write_bytes((name + ",b,c" + end + body + rnd.choice(["", end])).encode())
    paths = [str(tmp_path / f"f{k}.csv") for k in range(3)]
    want = (spark.read.options(header="true", multiLine="true", escape='"').schema("a string, b string, c string").csv(paths)
            .collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for limit in (1_000_000, -1):
            from tablewash.sources import records
            old, records.BROADCAST_SPLITS = records.BROADCAST_SPLITS, limit
            try:
                got = tw.load_csv(spark, paths, multi_line=True, bad_rows="drop")
                assert got.columns == [name.strip('"'), "b", "c"]
                assert sorted(map(tuple, got.collect()), key=repr) == sorted(
                    (tuple(v or None for v in r) for r in want), key=repr)
            finally:
                records.BROADCAST_SPLITS = old
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    p = tmp_path / "big.csv"
    p.write_text("k,t\n" + "".join(f'{i},"row {i}\nsecond ""line"", {i}"\n' for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        from tablewash.sources.records import _lines
        assert _lines(spark, [str(p)], ",").rdd.getNumPartitions() > 8
        got = {r.k: r.t for r in tw.load_csv(spark, str(p)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {str(i): f'row {i}\nsecond "line", {i}' for i in range(4000)}


def test_record_that_is_never_closed(spark, tmp_path):
    p = tmp_path / "open.csv"
    p.write_text('a,b\n1,x\n2,"open\n' + "\n".join(f"line {i}" for i in range(50)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        want = [tuple(r) for r in spark.read.options(header="true", multiLine="true", escape='"').csv(str(p)).collect()]
        assert sorted(map(tuple, tw.load_csv(spark, str(p)).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
