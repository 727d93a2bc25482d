"""

Every query reads the driver's tables (whole tables, no id subsets) and runs
one of the library's operators. The test tables are clean, so cleaning
queries first make dirt with SQL expressions that mean the same in Spark and
DuckDB (``DIRT_*`` below); the Spark side applies them with ``selectExpr``
and the oracle side with the same text, so both start from identical input.
Computed doubles are rounded (4 places) on both sides for a stable compare.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablewash as tw
from tablewash.operators.eda import correlation_long
from tablewash.session import shared_scratch

SF_SMOKE = "/root/testdata/sf0.001"

# ---------------------------------------------------------------------------
# Made dirt, as SQL text shared by both sides: (expression, output name).

DIRT_LINEITEM = [
    ("l_orderkey", "l_orderkey"),
    ("CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_partkey END", "l_partkey"),
    ("l_suppkey", "l_suppkey"),
    ("l_linenumber", "l_linenumber"),
    ("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END", "l_quantity"),
    ("l_extendedprice", "l_extendedprice"),
    ("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END", "l_discount"),
    ("CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax END", "l_tax"),
    ("CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END", "l_returnflag"),
    ("CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN NULL ELSE l_linestatus END",
     "l_linestatus"),
]
DIRT_LINEITEM_SHIP = DIRT_LINEITEM + [("l_shipdate", "l_shipdate")]

DIRT_CUSTOMER = [
    ("c_custkey", "CustKey"),
    ("c_name", "Customer Name"),
    ("c_nationkey", "nationKey"),
    ("CASE WHEN c_custkey % 7 = 0 THEN 'N/A' WHEN c_custkey % 11 = 0 THEN '?' "
     "ELSE concat('  ', CAST(c_acctbal AS STRING), ' ') END", "Acct-Bal"),
    ("CASE WHEN c_custkey % 3 = 0 THEN concat('  ', lower(c_mktsegment), ' ') "
     "WHEN c_custkey % 13 = 0 THEN 'null' ELSE c_mktsegment END", "MktSegment"),
]
# Repeated rows are made by appending, to the whole table, its rows of one
# category (a content predicate, so every row is still read and kept).
DIRT_CUSTOMER_REPEAT = "c_mktsegment = 'BUILDING'"

DIRT_ORDERS_REPEAT = "o_orderpriority = '1-URGENT'"

TEXT_ORDERS = [
    ("CAST(o_orderkey AS STRING)", "o_orderkey"),
    ("CAST(o_custkey AS STRING)", "o_custkey"),
    ("o_orderstatus", "o_orderstatus"),
    ("CASE WHEN o_orderkey % 50 = 0 THEN 'bad' ELSE CAST(o_totalprice AS STRING) END",
     "o_totalprice"),
    ("CAST(CAST(o_orderdate AS DATE) AS STRING)", "o_orderdate"),
    ("o_orderpriority", "o_orderpriority"),
    ("CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_custkey % 1000 AS STRING) END",
     "o_shipcode"),
]
TEXT_ORDERS_CONVERSIONS = [("o_orderkey", "BIGINT"), ("o_custkey", "INTEGER"),
                           ("o_totalprice", "DOUBLE"), ("o_orderdate", "DATE"),
                           ("o_shipcode", "INTEGER")]

MADE_ORDERS = [
    ("o_orderkey", "o_orderkey"),
    ("o_custkey", "o_custkey"),
    ("o_totalprice", "o_totalprice"),
    ("CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice * 10 ELSE o_totalprice END",
     "price_spiky"),
    ("o_totalprice * 2 + CAST(o_custkey % 7 AS DOUBLE)", "price_linked"),
    ("CASE WHEN o_orderkey % 20 = 0 THEN 'x' ELSE 'y' END", "flag"),
    ("o_orderstatus", "o_orderstatus"),
    ("o_orderpriority", "o_orderpriority"),
]

WIDE_LINEITEM = [(c, c) for c in [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax"]] + [
    ("l_extendedprice * (1 - l_discount)", "disc_price"),
    ("l_extendedprice * (1 - l_discount) * (1 + l_tax)", "charge"),
    ("l_quantity * l_tax", "qty_tax"),
    ("CAST(l_orderkey % 97 AS DOUBLE) + l_discount", "mixed"),
    ("l_extendedprice / l_quantity", "unit_price"),
    ("l_tax - l_discount", "tax_less_disc"),
    ("CAST(l_partkey + l_suppkey AS DOUBLE)", "part_supp"),
    ("l_quantity * l_quantity", "qty_sq"),
]

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
MADE_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice", "price_spiky", "price_linked"]
NULL_LIKE_SQL = "('N/A', 'NA', 'null', 'Null', '?', '', ' ')"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _made(spark, d, table, exprs) -> DataFrame:
    return _read(spark, d, table).select(*[F.expr(e).alias(a) for e, a in exprs])


def _sql_select(exprs) -> str:
    return ", ".join(f'{e} AS "{a}"' for e, a in exprs)


def dirty_lineitem(spark, d, ship=False):
    return _made(spark, d, "lineitem", DIRT_LINEITEM_SHIP if ship else DIRT_LINEITEM)


def dirty_customer(spark, d):
    base = _made(spark, d, "customer", DIRT_CUSTOMER)
    again = (_read(spark, d, "customer").where(DIRT_CUSTOMER_REPEAT)
             .select(*[F.expr(e).alias(a) for e, a in DIRT_CUSTOMER]))
    return base.unionByName(again)


def dirty_orders(spark, d):
    o = _read(spark, d, "orders")
    return o.unionByName(o.where(DIRT_ORDERS_REPEAT))


def text_orders(spark, d):
    return _made(spark, d, "orders", TEXT_ORDERS)


def made_orders(spark, d):
    return _made(spark, d, "orders", MADE_ORDERS)


SQL_DIRTY_LINEITEM = f"(SELECT {_sql_select(DIRT_LINEITEM)} FROM lineitem)"
SQL_DIRTY_LINEITEM_SHIP = f"(SELECT {_sql_select(DIRT_LINEITEM_SHIP)} FROM lineitem)"
SQL_DIRTY_CUSTOMER = (f"(SELECT {_sql_select(DIRT_CUSTOMER)} FROM customer UNION ALL "
                      f"SELECT {_sql_select(DIRT_CUSTOMER)} FROM customer "
                      f"WHERE {DIRT_CUSTOMER_REPEAT})")
SQL_DIRTY_ORDERS = f"(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE {DIRT_ORDERS_REPEAT})"
SQL_TEXT_ORDERS = f"(SELECT {_sql_select(TEXT_ORDERS)} FROM orders)"
SQL_MADE_ORDERS = f"(SELECT {_sql_select(MADE_ORDERS)} FROM orders)"


def _r4(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to 4 places (stable compare)."""
    return df.select(*[F.round(F.col(c), 4).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ---------------------------------------------------------------------------
# Spark queries


def q_profile_nulls(spark, d):
    return tw.null_counts(dirty_lineitem(spark, d, ship=True))


def q_profile_columns(spark, d):
    return tw.profile_columns(dirty_lineitem(spark, d, ship=True))


def q_profile_summary(spark, d):
    df = dirty_orders(spark, d)
    return tw.profile_counts(df).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "duplicates_count")


def q_duplicates_count(spark, d):
    return tw.duplicates_count_df(dirty_orders(spark, d))


def q_remove_duplicates(spark, d):
    return tw.remove_duplicates(dirty_orders(spark, d))


def q_exact_duplicate_rows(spark, d):
    return tw.exact_duplicate_rows(dirty_orders(spark, d), 10)


def q_exact_duplicate_rows_all(spark, d):
    return tw.exact_duplicate_rows(dirty_orders(spark, d), None)


def q_entity_key(spark, d):
    return tw.entity_key_df(_read(spark, d, "conversations"))


def q_entity_duplicate_keys(spark, d):
    return tw.entity_duplicate_keys(_read(spark, d, "conversations"), "conv_id")


def q_entity_duplicates(spark, d):
    return tw.entity_duplicates(_read(spark, d, "lineitem"), "l_orderkey", 10)


def q_entity_duplicates_conversations(spark, d):
    conv = _read(spark, d, "conversations")
    return tw.entity_duplicates(conv, "conv_id", 10)


def q_auto_clean(spark, d):
    return tw.auto_clean(dirty_customer(spark, d))


def q_suggest_types(spark, d):
    return tw.suggest_types(text_orders(spark, d))


def q_convert_types(spark, d):
    return _r4(tw.convert_types(text_orders(spark, d), TEXT_ORDERS_CONVERSIONS), "o_totalprice")


def q_conversion_report(spark, d):
    return tw.conversion_report(text_orders(spark, d), TEXT_ORDERS_CONVERSIONS)


_IMPUTE_COLS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def q_impute_mean(spark, d):
    df = tw.impute(dirty_lineitem(spark, d),
                   [{"column_name": "l_quantity", "strategy": "mean"},
                    {"column_name": "l_partkey", "strategy": "mean"}])
    return _r4(df, *_IMPUTE_COLS)


def q_impute_median(spark, d):
    df = tw.impute(dirty_lineitem(spark, d),
                   [{"column_name": "l_discount", "strategy": "median"},
                    {"column_name": "l_tax", "strategy": "median"},
                    {"column_name": "l_partkey", "strategy": "median"}])
    return _r4(df, *_IMPUTE_COLS)


def q_impute_mode(spark, d):
    df = tw.impute(dirty_lineitem(spark, d),
                   [{"column_name": "l_returnflag", "strategy": "mode"},
                    {"column_name": "l_linestatus", "strategy": "mode"},
                    {"column_name": "l_quantity", "strategy": "mode"}])
    return _r4(df, *_IMPUTE_COLS)


def q_impute_custom(spark, d):
    df = tw.impute(dirty_lineitem(spark, d),
                   [{"column_name": "l_returnflag", "strategy": "custom", "value": "U"},
                    {"column_name": "l_quantity", "strategy": "custom", "value": 0}])
    return _r4(df, *_IMPUTE_COLS)


def q_suggest_imputations(spark, d):
    return tw.suggest_imputations(dirty_lineitem(spark, d, ship=True))


def q_drop_columns(spark, d):
    return tw.drop_columns(_read(spark, d, "part"), ["p_type", "p_size"])


_NUM_STATS = ("mean", "std", "min", "p25", "p50", "p75", "max")


def q_numeric_summary(spark, d):
    return _r4(tw.numeric_summary(_read(spark, d, "lineitem")), *_NUM_STATS)


def q_numeric_summary_nulls(spark, d):
    return _r4(tw.numeric_summary(dirty_lineitem(spark, d)), *_NUM_STATS)


def q_numeric_table(spark, d):
    return tw.numeric_table(tw.numeric_counts(dirty_lineitem(spark, d)))


def q_categorical_summary(spark, d):
    return tw.categorical_summary(_read(spark, d, "events"))


def q_categorical_summary_documents(spark, d):
    return tw.categorical_summary(_read(spark, d, "documents"))


def q_top_values(spark, d):
    return tw.top_values(_read(spark, d, "orders"), 5)


def q_top_values_text(spark, d):
    return tw.top_values_text(tw.top_values(_read(spark, d, "events"), 5))


def q_value_counts_documents(spark, d):
    return tw.value_counts(_read(spark, d, "documents"))


def q_correlation_pairs(spark, d):
    return tw.correlation_pairs(_read(spark, d, "lineitem"))


def q_correlation_matrix(spark, d):
    return correlation_long(tw.correlation_pairs(made_orders(spark, d)))


def q_outlier_counts(spark, d):
    df = made_orders(spark, d)
    return tw.outlier_counts(df, tw.numeric_summary(df))


def q_insights(spark, d):
    df = made_orders(spark, d)
    out = tw.detect_insights(df)
    return out.select("type", "severity", "title", "description",
                      F.array_join("affected_columns", ",").alias("affected"))


def q_bar_chart_data(spark, d):
    return tw.bar_chart_data(_read(spark, d, "orders"), "o_orderpriority")


def q_bar_chart_ties(spark, d):
    return tw.bar_chart_data(_read(spark, d, "orders"), "o_custkey")


def q_scatter_data(spark, d):
    return tw.scatter_data(_read(spark, d, "part"), "p_size", "p_retailprice")


def q_scatter_data_whole(spark, d):
    # fewer qualifying rows than the sample size: every point, no sampling
    return tw.scatter_data(_read(spark, d, "orders"), "o_totalprice", "o_custkey",
                           n=1 << 40)


def q_suggest_charts(spark, d):
    return tw.suggest_charts(made_orders(spark, d))


def q_preview(spark, d):
    return tw.preview(_read(spark, d, "nation"), 5)


def q_describe(spark, d):
    return tw.describe(_read(spark, d, "lineitem"))


def _round_trip(spark, d, table, cols, tag, **kw):
    src = _read(spark, d, table).select(*cols)
    path = shared_scratch(spark, f"csv-{tag}-{uuid.uuid4().hex}")
    tw.export_csv(src, path + "/" + tw.export_name(f"{table}.csv"))
    return tw.load_csv(spark, path + "/" + tw.export_name(f"{table}.csv"), **kw)


def q_csv_round_trip(spark, d):
    return _round_trip(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"], "nation")


def q_csv_round_trip_documents(spark, d):
    return _round_trip(spark, d, "documents", ["doc_id", "text", "lang", "source", "n_chars"],
                       "docs")


def q_csv_bad_rows(spark, d):
    """Orders as CSV, one field too many where the priority is urgent: the rows that
    load, and one row (order key -1) with the number of bad ones as its priority."""
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("too many"))
    path = shared_scratch(spark, f"csv-bad-{uuid.uuid4().hex}") + "/orders.csv"
    # whole lines as the only column, so that nothing is quoted and each part has the header
    (_read(spark, d, "orders").select(F.concat_ws(",", *cols, urgent).alias(",".join(cols)))
     .write.option("header", "true").option("sep", "\u0001").option("quote", "\u0000").csv(path))
    bad = tw.csv_bad_rows(spark, path)
    return tw.load_csv(spark, path, bad_rows="drop").unionByName(bad.agg(
        F.lit("-1").alias("o_orderkey"), F.lit("bad").alias("o_orderstatus"),
        F.count("record").cast("string").alias("o_orderpriority")))


def q_load_csv_dir(spark, d):
    """A folder of two CSVs: without a name it gives their names, with one its rows."""
    base = shared_scratch(spark, f"csv-dir-{uuid.uuid4().hex}")
    nation = _read(spark, d, "nation")
    for part in (nation.where("n_regionkey < 2"), nation.where("n_regionkey >= 2")):
        tw.export_csv(part, base, single_file=True, mode="append")
    first, second = tw.load_csv_dir(spark, base).available
    return (tw.load_csv_dir(spark, base, first).frame
            .unionByName(tw.load_csv_dir(spark, base, second).frame))


def q_profile_report(spark, d):
    """The whole profile as rows (item, value)."""
    p = tw.profile(dirty_orders(spark, d))
    rows = [("total_rows", p.total_rows), ("total_columns", p.total_columns),
            ("duplicates_count", p.duplicates_count), ("preview_rows", len(p.sample_preview))]
    rows += [(f"null:{c}", n) for c, n in p.null_counts.items()]
    rows += [(f"type:{r['column_type']}:{r['column_name']}", 1) for r in p.schema]
    return spark.createDataFrame(rows, "item string, value bigint")


def q_find_duplicates_report(spark, d):
    """Duplicate count, checked column and sample sizes of a table with repeated rows."""
    turns = _read(spark, d, "conversations")
    r = tw.find_duplicates(turns.unionByName(turns.where("role = 'user'")), n=10)
    return spark.createDataFrame([(r.count, r.checked_column, len(r.exact_sample), len(r.entity_sample))],
                                 "duplicates bigint, checked_column string, exact_rows bigint, entity_rows bigint")


def q_statistical_summary(spark, d):
    """The categorical part and the counts of the combined summary."""
    s = tw.statistical_summary(_read(spark, d, "events"))
    return s.categorical_summary.select(
        "column", "unique_count", "mode", "mode_count",
        F.lit(s.total_rows).cast("bigint").alias("total_rows"),
        F.lit(s.total_columns).cast("bigint").alias("total_columns"))


def q_statistical_summary_whole(spark, d):
    """Every part of the combined summary as rows."""
    return _r4(tw.summary_rows(tw.statistical_summary(_read(spark, d, "orders"))), "number")


def q_find_duplicates_rows(spark, d):
    """The samples of the duplicate report, row by row in their order."""
    turns = _read(spark, d, "conversations")
    r = tw.find_duplicates(turns.unionByName(turns.where("role = 'user'")), n=10)
    rows = [(part, i + 1, *(x[c] for c in _CONV)) for part, sample in (("exact", r.exact_sample), ("entity", r.entity_sample))
            for i, x in enumerate(sample)]
    return spark.createDataFrame(rows, "part string, place int, conv_id bigint, turn bigint, role string, text string")


def q_load_csv_dir_orders(spark, d):
    """A folder of two CSV files of orders, each loaded by its name."""
    base = shared_scratch(spark, f"csv-dir-{uuid.uuid4().hex}")
    src = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    for part in (src.where("o_orderstatus = 'F'"), src.where("o_orderstatus <> 'F'")):
        tw.export_csv(part, base, single_file=True, mode="append")
    first, second = tw.load_csv_dir(spark, base).available
    return (tw.load_csv_dir(spark, base, first).frame
            .unionByName(tw.load_csv_dir(spark, base, second).frame))


def q_catalog_tables(spark, d):
    """Tables saved, replaced by a frame that reads the old one, listed and dropped by prefix."""
    prefix = f"project_{uuid.uuid4().hex}_"
    orders = _read(spark, d, "orders")
    try:
        tw.save_table(orders, prefix + "a")
        tw.save_table(orders.where("o_orderstatus = 'F'"), prefix + "b")
        saved = [("saved", t, spark.table(prefix + t).count()) for t in "ab"]
        tw.save_table(spark.table(prefix + "a").where("o_orderpriority = '1-URGENT'"), prefix + "a")
        saved.append(("replaced", "a", spark.table(prefix + "a").count()))
        saved += [("listed", t[len(prefix):], 1) for t in tw.list_tables(spark) if t.startswith(prefix)]
    finally:
        dropped = tw.drop_tables_with_prefix(spark, prefix)
    left = sum(t.startswith(prefix) for t in tw.list_tables(spark))
    return spark.createDataFrame([*saved, ("dropped", "", dropped), ("left", "", left)], "step string, name string, n bigint")


def q_allowed_strategies(spark, d):
    """The imputation strategies that each column with missing values may take."""
    df = dirty_lineitem(spark, d)
    kinds = {f.name: ",".join(tw.allowed_strategies(f.dataType)) for f in df.schema.fields}
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return tw.suggest_imputations(df).select("column_name", F.element_at(names, F.col("column_name")).alias("allowed"))


def q_correlation_square(spark, d):
    """The heat map's square matrix."""
    m = tw.correlation_matrix(tw.correlation_pairs(_read(spark, d, "lineitem")))
    return m.select("column", *[F.round(c, 4).alias(c) for c in LINEITEM_NUMERIC])


def q_suggested_conversions(spark, d):
    found = tw.suggested_conversions(tw.suggest_types(_made(spark, d, "orders", TEXT_ORDERS)))
    return spark.createDataFrame([(c["column_name"], c["new_type"]) for c in found],
                                 "column_name string, new_type string")


def q_scatter_sample(spark, d):
    """How many points the sample has, and how many of them are not in the table."""
    src = _read(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    pts = tw.chart_data(_read(spark, d, "orders"), "scatter_plot", "o_totalprice", "o_custkey").persist()
    try:
        row = (pts.count(), pts.join(src.distinct(), ["x", "y"], "left_anti").count())
    finally:
        pts.unpersist()
    return spark.createDataFrame([row], "sampled bigint, not_in_source bigint")


def q_impute_custom_text(spark, d):
    """Custom fills given as text, as a form sends them."""
    df = dirty_lineitem(spark, d).select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    return tw.impute(df, [{"column_name": "l_partkey", "strategy": "custom", "value": "2.5"},
                          {"column_name": "l_discount", "strategy": "custom", "value": "0.25"}])


def q_entity_key_events(spark, d):
    # event_id repeats nothing, user_id does
    return tw.entity_key_df(_read(spark, d, "events"))


def q_cleaning_plan(spark, d):
    out, _ = tw.CleaningPlan(drop_columns=["nation_key"]).run(dirty_customer(spark, d))
    return _r4(out, "acct_bal")


def q_numeric_summary_embeddings(spark, d):
    # the array column is passed over, not summarised
    return _r4(tw.numeric_summary(_read(spark, d, "embeddings")), *_NUM_STATS)


def q_duplicates_count_embeddings(spark, d):
    return tw.duplicates_count_df(_read(spark, d, "embeddings"))


def q_profile_columns_pages(spark, d):
    return tw.profile_columns(_read(spark, d, "pages"))


def q_auto_clean_pages(spark, d):
    return tw.auto_clean(_read(spark, d, "pages"))


def q_categorical_summary_labels(spark, d):
    return tw.categorical_summary(_read(spark, d, "labels"), columns=["quality", "toxic"])


def q_exact_duplicate_texts(spark, d):
    return tw.exact_duplicate_rows(_read(spark, d, "documents").select("text"), None)


def q_entity_duplicate_texts(spark, d):
    docs = _read(spark, d, "documents").select("text", "lang", "source")
    return tw.entity_duplicate_keys(docs, "text")


def q_profile_summary_benchmark(spark, d):
    df = _read(spark, d, "benchmark")
    return tw.profile_counts(df).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        "duplicates_count")


def q_chart_data_histogram(spark, d):
    return tw.chart_data(_read(spark, d, "lineitem"), "histogram", "l_returnflag")


def q_stream_auto_clean(spark, d):
    """The row-local cleaning steps on a file stream of the customer table."""
    from tablewash.streaming import clean_stream, run_to_parquet
    stream = (spark.readStream.schema(_read(spark, d, "customer").schema)
              .option("pathGlobFilter", "customer.parquet").parquet(d)
              .select(*[F.expr(e).alias(a) for e, a in DIRT_CUSTOMER]))
    base = shared_scratch(spark, f"stream-{uuid.uuid4().hex}")
    run_to_parquet(clean_stream(stream), base + "/out", base + "/checkpoint")
    return spark.read.parquet(base + "/out")


def q_correlation_pairs_nulls(spark, d):
    # NULL-bearing columns: pairwise-complete sums in one masked-Gram pass
    return tw.correlation_pairs(dirty_lineitem(spark, d))


def q_correlation_pairs_wide(spark, d):
    # sixteen NULL-free columns: Spark ML's Gram matrix
    return tw.correlation_pairs(_made(spark, d, "lineitem", WIDE_LINEITEM))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "profile_nulls": q_profile_nulls,
    "profile_columns": q_profile_columns,
    "profile_summary": q_profile_summary,
    "duplicates_count": q_duplicates_count,
    "remove_duplicates": q_remove_duplicates,
    "exact_duplicate_rows": q_exact_duplicate_rows,
    "exact_duplicate_rows_all": q_exact_duplicate_rows_all,
    "entity_key": q_entity_key,
    "entity_duplicate_keys": q_entity_duplicate_keys,
    "entity_duplicates": q_entity_duplicates,
    "entity_duplicates_conversations": q_entity_duplicates_conversations,
    "auto_clean": q_auto_clean,
    "suggest_types": q_suggest_types,
    "convert_types": q_convert_types,
    "conversion_report": q_conversion_report,
    "impute_mean": q_impute_mean,
    "impute_median": q_impute_median,
    "impute_mode": q_impute_mode,
    "impute_custom": q_impute_custom,
    "suggest_imputations": q_suggest_imputations,
    "drop_columns": q_drop_columns,
    "numeric_summary": q_numeric_summary,
    "numeric_summary_nulls": q_numeric_summary_nulls,
    "numeric_table": q_numeric_table,
    "categorical_summary": q_categorical_summary,
    "categorical_summary_documents": q_categorical_summary_documents,
    "top_values": q_top_values,
    "top_values_text": q_top_values_text,
    "value_counts_documents": q_value_counts_documents,
    "correlation_pairs": q_correlation_pairs,
    "correlation_matrix": q_correlation_matrix,
    "outlier_counts": q_outlier_counts,
    "insights": q_insights,
    "bar_chart_data": q_bar_chart_data,
    "bar_chart_ties": q_bar_chart_ties,
    "scatter_data": q_scatter_data,
    "scatter_data_whole": q_scatter_data_whole,
    "suggest_charts": q_suggest_charts,
    "preview": q_preview,
    "describe": q_describe,
    "csv_round_trip": q_csv_round_trip,
    "csv_round_trip_documents": q_csv_round_trip_documents,
    "csv_bad_rows": q_csv_bad_rows,
    "load_csv_dir": q_load_csv_dir,
    "profile_report": q_profile_report,
    "find_duplicates_report": q_find_duplicates_report,
    "statistical_summary": q_statistical_summary,
    "statistical_summary_whole": q_statistical_summary_whole,
    "find_duplicates_rows": q_find_duplicates_rows,
    "load_csv_dir_orders": q_load_csv_dir_orders,
    "catalog_tables": q_catalog_tables,
    "allowed_strategies": q_allowed_strategies,
    "correlation_square": q_correlation_square,
    "suggested_conversions": q_suggested_conversions,
    "scatter_sample": q_scatter_sample,
    "impute_custom_text": q_impute_custom_text,
    "entity_key_events": q_entity_key_events,
    "cleaning_plan": q_cleaning_plan,
    "numeric_summary_embeddings": q_numeric_summary_embeddings,
    "duplicates_count_embeddings": q_duplicates_count_embeddings,
    "profile_columns_pages": q_profile_columns_pages,
    "auto_clean_pages": q_auto_clean_pages,
    "categorical_summary_labels": q_categorical_summary_labels,
    "exact_duplicate_texts": q_exact_duplicate_texts,
    "entity_duplicate_texts": q_entity_duplicate_texts,
    "profile_summary_benchmark": q_profile_summary_benchmark,
    "chart_data_histogram": q_chart_data_histogram,
    "stream_auto_clean": q_stream_auto_clean,
    "correlation_pairs_nulls": q_correlation_pairs_nulls,
    "correlation_pairs_wide": q_correlation_pairs_wide,
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the whole cleaning sequence on made-dirty customers (sf0.001)."""
    return q_cleaning_plan(spark, SF_SMOKE)


# The training-data operators and their pipeline are optional: without them
# everything else works.
try:
    from tablewash.llm.queries import ORACLE_SQL as _LLM_SQL
    from tablewash.llm.queries import QUERIES as _LLM_QUERIES
except ImportError:
    _LLM_QUERIES, _LLM_SQL = {}, {}
try:
    import corpus_pipeline

    _PIPELINE = {"pipeline": corpus_pipeline.run}
    _PIPELINE_SQL = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
except ImportError:
    _PIPELINE, _PIPELINE_SQL = {}, {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_LLM_QUERIES, **_PIPELINE}


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB)


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _cols_list(cols) -> str:
    return ", ".join(_q(c) for c in cols)


def _order_all(cols) -> str:
    return ", ".join(f"{_q(c)} ASC NULLS FIRST" for c in cols)


_LI_ALL = LINEITEM_NUMERIC + ["l_returnflag", "l_linestatus", "l_shipdate"]
_DL_COLS = [a for _, a in DIRT_LINEITEM]
_DLS_COLS = [a for _, a in DIRT_LINEITEM_SHIP]
_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
           "o_orderpriority"]
_CONV = ["conv_id", "turn", "role", "text"]


def _sql_null_counts(src: str, cols, positive=True, with_type=False) -> str:
    parts = []
    for c in cols:
        typ = f", min(typeof({_q(c)})) AS column_type" if with_type else ""
        parts.append(f"SELECT '{c}' AS column_name{typ}, count(*) - count({_q(c)}) AS null_count "
                     f"FROM {src}")
    body = " UNION ALL ".join(parts)
    return f"SELECT * FROM ({body})" + (" WHERE null_count > 0" if positive else "")


def _sql_impute(fills: dict[str, str]) -> str:
    cols = []
    for c in _DL_COLS:
        e = f"coalesce({c}, {fills[c]})" if c in fills else c
        if c in _IMPUTE_COLS:
            e = f"round({e}, 4)"
        cols.append(f"{e} AS {c}")
    return f"WITH d AS {SQL_DIRTY_LINEITEM} SELECT {', '.join(cols)} FROM d"


def _sql_mode(c: str, src: str = "d") -> str:
    return (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


def _sql_numeric(src: str, cols, digits=4, stats=True) -> str:
    parts = []
    for c in cols:
        x = f"CAST({_q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, "
            f"round(avg({x}), {digits}) AS mean, round(stddev_samp({x}), {digits}) AS std, "
            f"round(min({x}), {digits}) AS min, "
            f"round(quantile_cont({x}, 0.25), {digits}) AS p25, "
            f"round(quantile_cont({x}, 0.5), {digits}) AS p50, "
            f"round(quantile_cont({x}, 0.75), {digits}) AS p75, "
            f"round(max({x}), {digits}) AS max FROM {src}")
    return " UNION ALL ".join(parts)


def _sql_value_counts(src: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({_q(c)} AS VARCHAR) AS value, count(*) AS count "
        f"FROM {src} WHERE {_q(c)} IS NOT NULL GROUP BY 2" for c in cols)


def _sql_top(src: str, cols, k: int) -> str:
    return (f"SELECT \"column\", CAST(rank AS INTEGER) AS rank, value, count FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value ASC) "
            f"AS rank FROM ({_sql_value_counts(src, cols)})) WHERE rank <= {k}")


def _sql_categorical(src: str, cols) -> str:
    vc = _sql_value_counts(src, cols)
    names = " UNION ALL ".join(f"SELECT '{c}' AS \"column\"" for c in cols)
    return (f"WITH vc AS ({vc}), "
            f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" "
            f"ORDER BY count DESC, value ASC) AS rn FROM vc) WHERE rn = 1), "
            f"u AS (SELECT \"column\", count(*) AS unique_count FROM vc GROUP BY 1), "
            f"n AS ({names}) "
            f"SELECT n.\"column\", coalesce(u.unique_count, 0) AS unique_count, top.value AS mode, "
            f"top.count AS mode_count FROM n LEFT JOIN u ON n.\"column\" = u.\"column\" "
            f"LEFT JOIN top ON n.\"column\" = top.\"column\"")


def _sql_pairs(src: str, cols) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, corr(CAST({a} AS DOUBLE), "
                         f"CAST({b} AS DOUBLE)) AS r FROM {src}")
    return (f"SELECT col1, col2, round(r, 4) AS correlation FROM ({' UNION ALL '.join(parts)}) "
            f"WHERE r IS NOT NULL AND NOT isnan(r)")


def _sql_quartile_bounds(src: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, count({c}) AS n FROM {src}"
        for c in cols)


def _sql_outliers(src: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM {src} WHERE {c} IS NOT NULL AND "
            f"({c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1))) "
            f"AS outlier_count FROM b WHERE b.\"column\" = '{c}' AND b.n > 0")
    return f"WITH b AS ({_sql_quartile_bounds(src, cols)}) " + " UNION ALL ".join(parts)


def _sql_insights() -> str:
    src = "m"
    made_cols = [a for _, a in MADE_ORDERS]
    text_cols = ["flag", "o_orderstatus", "o_orderpriority"]
    corr = (f"SELECT 'correlation' AS type, 'warning' AS severity, 'High Feature Correlation' "
            f"AS title, printf('Columns ''%s'' and ''%s'' are highly correlated (%s). Consider "
            f"removing one for modeling.', col1, col2, CAST(correlation AS VARCHAR)) AS description, "
            f"col1 || ',' || col2 AS affected FROM ({_sql_pairs(src, MADE_NUMERIC)}) "
            f"WHERE abs(correlation) >= 0.8")
    outl = (f"SELECT 'outlier', 'warning', 'Potential Outliers Detected', printf('Column ''%s'' "
            f"has %d values outside the typical 1.5*IQR range. Review with a Box Plot.', \"column\", "
            f"outlier_count), \"column\" FROM ({_sql_outliers(src, MADE_NUMERIC)}) "
            f"WHERE outlier_count > 0.01 * (SELECT count(*) FROM {src}) AND outlier_count > 5")
    imb = (f"SELECT 'distribution', 'info', 'Highly Imbalanced Feature', printf('Categorical "
           f"column ''%s'' is highly skewed, with the mode value (''%s'') making up %d%% of the "
           f"data. This might impact model performance.', \"column\", value, "
           f"CAST(round_even(count / (SELECT count(*) FROM {src}) * 100, 0) AS INTEGER)), "
           f"\"column\" FROM ({_sql_top(src, text_cols, 1)}) "
           f"WHERE count / (SELECT count(*) FROM {src}) > 0.9")
    assert set(text_cols) <= set(made_cols)
    return f"WITH m AS {SQL_MADE_ORDERS} {corr} UNION ALL {outl} UNION ALL {imb}"


def _sql_correlation_long(src: str, cols) -> str:
    return (f"WITH p AS ({_sql_pairs(src, cols)}), "
            f"f AS (SELECT col1 AS row_col, col2 AS col_col, correlation FROM p UNION ALL "
            f"SELECT col2, col1, correlation FROM p UNION ALL "
            f"SELECT c, c, CAST(1.0 AS DOUBLE) FROM (SELECT col1 AS c FROM p UNION SELECT col2 FROM p)) "
            f"SELECT *, CASE WHEN abs(correlation) > 0.8 THEN 'very_strong' "
            f"WHEN abs(correlation) > 0.5 THEN 'strong' WHEN abs(correlation) > 0.2 THEN 'moderate' "
            f"ELSE 'weak' END AS band FROM f")


def _sql_suggest_charts() -> str:
    text_cols = ["flag", "o_orderstatus", "o_orderpriority"]
    return (f"WITH m AS {SQL_MADE_ORDERS}, "
            f"p AS ({_sql_pairs('m', MADE_NUMERIC)}), "
            f"sc AS (SELECT 'scatter_plot' AS chart_type, printf('%s vs %s', col2, col1) AS title, "
            f"printf('Relationship between %s and %s (correlation %s).', col1, col2, "
            f"CAST(correlation AS VARCHAR)) AS description, col1 AS x_axis, col2 AS y_axis, "
            f"2.0 + abs(correlation) AS score FROM p ORDER BY score DESC, x_axis, y_axis LIMIT 2), "
            f"cat AS ({_sql_categorical('m', text_cols)}), "
            f"bar AS (SELECT 'bar_chart', printf('Distribution of %s', \"column\"), "
            f"printf('Most frequent values of %s (%d distinct).', \"column\", unique_count), "
            f"\"column\", CAST(NULL AS VARCHAR), 1.0 + 1.0 / unique_count FROM cat "
            f"WHERE unique_count BETWEEN 2 AND 50), "
            f"num AS (SELECT 'histogram', printf('Value counts of %s', c), "
            f"printf('Frequency of each value of %s.', c), c, CAST(NULL AS VARCHAR), 0.5 FROM ("
            + " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS n FROM m" for c in MADE_NUMERIC)
            + ") WHERE n > 0) "
            f"SELECT * FROM (SELECT * FROM sc UNION ALL SELECT * FROM bar UNION ALL SELECT * FROM num) "
            f"ORDER BY score DESC, chart_type, x_axis LIMIT 5")


def _sql_cleaning_plan() -> str:
    def cl(c):
        return (f"upper(CASE WHEN trim({_q(c)}) IN {NULL_LIKE_SQL} THEN NULL "
                f"ELSE trim({_q(c)}) END)")
    return (f"WITH d AS {SQL_DIRTY_CUSTOMER}, "
            f"c AS (SELECT \"CustKey\" AS cust_key, {cl('Customer Name')} AS customer_name, "
            f"\"nationKey\" AS nation_key, {cl('Acct-Bal')} AS acct_bal, "
            f"{cl('MktSegment')} AS mkt_segment FROM d), "
            f"u AS (SELECT DISTINCT * FROM c), "
            f"v AS (SELECT cust_key, customer_name, nation_key, TRY_CAST(acct_bal AS DOUBLE) "
            f"AS acct_bal, mkt_segment FROM u) "
            f"SELECT cust_key, customer_name, "
            f"round(coalesce(acct_bal, (SELECT avg(acct_bal) FROM v)), 4) AS acct_bal, "
            f"coalesce(mkt_segment, {_sql_mode('mkt_segment', 'v')}) AS mkt_segment FROM v")


def _sql_square(src: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", " + ", ".join(
            f"{'CAST(1 AS DOUBLE)' if a == b else f'round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4)'} AS {b}"
            for b in cols) + f" FROM {src}" for a in cols)


def _sql_find_duplicates() -> str:
    src = "(SELECT * FROM conversations UNION ALL SELECT * FROM conversations WHERE role = 'user')"
    return (f"WITH t AS {src}, g AS (SELECT *, count(*) AS n FROM t GROUP BY ALL), "
            f"k AS (SELECT conv_id FROM g WHERE conv_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) "
            f"SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicates, 'conv_id' AS checked_column, "
            f"CAST(least(10, sum(n) FILTER (n > 1)) AS BIGINT) AS exact_rows, "
            f"least(10, (SELECT count(*) FROM t WHERE conv_id IN (SELECT * FROM k))) AS entity_rows FROM g")


def _sql_summary_whole(src: str, numeric, texts, columns: int) -> str:
    none = "CAST(NULL AS VARCHAR)"
    stats = (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"),
             ("max", "max"))
    num = " UNION ALL ".join(f"SELECT 'numeric' AS part, \"column\", '{key}' AS name, {none} AS text, "
                             f"CAST({_q(c)} AS DOUBLE) AS number FROM num" for c, key in stats)
    cat = " UNION ALL ".join(f"SELECT 'categorical', \"column\", '{c}', {'mode' if c == 'mode' else none}, "
                             f"CAST({'NULL' if c == 'mode' else c} AS DOUBLE) FROM cat" for c in ("unique_count", "mode", "mode_count"))
    return (f"WITH num AS ({_sql_numeric(src, numeric)}), cat AS ({_sql_categorical(src, texts)}), "
            f"top AS ({_sql_top(src, texts, 5)}), pairs AS ({_sql_pairs(src, numeric)}) "
            f"{num} UNION ALL {cat} "
            f"UNION ALL SELECT 'top_values', \"column\", CAST(rank AS VARCHAR), value, CAST(count AS DOUBLE) FROM top "
            f"UNION ALL SELECT 'correlation', col1, col2, {none}, correlation FROM pairs "
            f"UNION ALL SELECT 'table', {none}, 'total_rows', {none}, CAST(count(*) AS DOUBLE) FROM {src} "
            f"UNION ALL SELECT 'table', {none}, 'total_columns', {none}, CAST({columns} AS DOUBLE)")


def _sql_find_duplicates_rows() -> str:
    t = "(SELECT * FROM conversations UNION ALL SELECT * FROM conversations WHERE role = 'user')"
    order = _order_all(_CONV)
    return (f"WITH t AS {t}, g AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, role, text) AS n FROM t), "
            f"k AS (SELECT conv_id FROM (SELECT DISTINCT * FROM t) WHERE conv_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1), "
            f"e AS (SELECT * EXCLUDE n, row_number() OVER (ORDER BY {order}) AS place FROM g WHERE n > 1), "
            f"f AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM t WHERE conv_id IN (SELECT * FROM k)) "
            f"SELECT 'exact' AS part, CAST(place AS INTEGER) AS place, conv_id, turn, role, text FROM e WHERE place <= 10 "
            f"UNION ALL SELECT 'entity', CAST(place AS INTEGER), conv_id, turn, role, text FROM f WHERE place <= 10")


def oracle_sql() -> dict[str, str]:
    li_num = LINEITEM_NUMERIC
    dl = SQL_DIRTY_LINEITEM
    dls = SQL_DIRTY_LINEITEM_SHIP
    do = SQL_DIRTY_ORDERS
    to = SQL_TEXT_ORDERS
    cust_clean = {
        "CustKey": "cust_key", "Customer Name": "customer_name", "nationKey": "nation_key",
        "Acct-Bal": "acct_bal", "MktSegment": "mkt_segment"}
    auto_clean_cols = []
    for _, a in DIRT_CUSTOMER:
        if a in ("CustKey", "nationKey"):
            auto_clean_cols.append(f"{_q(a)} AS {cust_clean[a]}")
        else:
            auto_clean_cols.append(
                f"upper(CASE WHEN trim({_q(a)}) IN {NULL_LIKE_SQL} THEN NULL ELSE trim({_q(a)}) END) "
                f"AS {cust_clean[a]}")
    suggest_parts = " UNION ALL ".join(
        f"SELECT '{a}' AS column_name, count(TRY_CAST({a} AS DOUBLE)) AS ok, "
        f"count(*) FILTER (WHERE {a} IS NOT NULL AND {a} != '') AS ne FROM t"
        for _, a in TEXT_ORDERS)
    report_parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 'Success' AS status, '{t}' AS new_type, "
        f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL) "
        f"AS conversion_failures, CAST(NULL AS VARCHAR) AS error FROM t"
        for c, t in TEXT_ORDERS_CONVERSIONS)
    conv_map = dict(TEXT_ORDERS_CONVERSIONS)
    convert_cols = []
    for _, a in TEXT_ORDERS:
        e = f"TRY_CAST({a} AS {conv_map[a]})" if a in conv_map else a
        if a == "o_totalprice":
            e = f"round({e}, 4)"
        convert_cols.append(f"{e} AS {a}")
    entity_others = [c for c in _LI_ALL]
    return {
        **_LLM_SQL, **_PIPELINE_SQL,
        "profile_nulls": _sql_null_counts(dls, _DLS_COLS),
        "profile_columns": _sql_null_counts(dls, _DLS_COLS, positive=False, with_type=True),
        "profile_summary": (f"SELECT (SELECT count(*) FROM {do}) AS total_rows, "
                            f"CAST(6 AS BIGINT) AS total_columns, "
                            f"(SELECT count(*) FROM {do}) - (SELECT count(*) FROM "
                            f"(SELECT DISTINCT * FROM {do})) AS duplicates_count"),
        "duplicates_count": (f"SELECT (SELECT count(*) FROM {do}) - (SELECT count(*) FROM "
                             f"(SELECT DISTINCT * FROM {do})) AS duplicates_count"),
        "remove_duplicates": f"SELECT DISTINCT * FROM {do}",
        "exact_duplicate_rows": (
            f"SELECT {_cols_list(_ORDERS)} FROM (SELECT *, count(*) OVER (PARTITION BY "
            f"{_cols_list(_ORDERS)}) AS n FROM {do}) WHERE n > 1 ORDER BY {_order_all(_ORDERS)} "
            f"LIMIT 10"),
        "exact_duplicate_rows_all": (
            f"SELECT {_cols_list(_ORDERS)} FROM (SELECT *, count(*) OVER (PARTITION BY "
            f"{_cols_list(_ORDERS)}) AS n FROM {do}) WHERE n > 1"),
        "entity_key": ("SELECT CASE WHEN count(*) - count(DISTINCT conv_id) > 0 THEN 'conv_id' "
                       "END AS checked_column FROM conversations"),
        "entity_duplicate_keys": (
            "WITH p AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1) "
            "SELECT conv_id FROM (SELECT DISTINCT * FROM conversations WHERE conv_id IN "
            "(SELECT * FROM p)) GROUP BY conv_id HAVING count(*) > 1"),
        "entity_duplicates": (
            "WITH p AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1), "
            "f AS (SELECT l_orderkey FROM (SELECT DISTINCT * FROM lineitem WHERE l_orderkey IN "
            "(SELECT * FROM p)) GROUP BY l_orderkey HAVING count(*) > 1) "
            f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT * FROM f) "
            f"ORDER BY {_order_all(entity_others)} LIMIT 10"),
        "entity_duplicates_conversations": (
            "WITH p AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1), "
            "f AS (SELECT conv_id FROM (SELECT DISTINCT * FROM conversations WHERE conv_id IN "
            "(SELECT * FROM p)) GROUP BY conv_id HAVING count(*) > 1) "
            f"SELECT * FROM conversations WHERE conv_id IN (SELECT * FROM f) "
            f"ORDER BY {_order_all(_CONV)} LIMIT 10"),
        "auto_clean": f"SELECT {', '.join(auto_clean_cols)} FROM {SQL_DIRTY_CUSTOMER}",
        "suggest_types": (
            f"WITH t AS {to} SELECT column_name, 'VARCHAR' AS current_type, "
            f"'DOUBLE' AS suggested_type, round(ok / ne, 2) AS confidence FROM ({suggest_parts}) "
            f"WHERE ne > 0 AND ok / ne > 0.95"),
        "convert_types": f"WITH t AS {to} SELECT {', '.join(convert_cols)} FROM t",
        "conversion_report": f"WITH t AS {to} {report_parts}",
        "impute_mean": _sql_impute({
            "l_quantity": "(SELECT avg(l_quantity) FROM d)",
            "l_partkey": "CAST(round_even((SELECT avg(l_partkey) FROM d), 0) AS BIGINT)"}),
        "impute_median": _sql_impute({
            "l_discount": "(SELECT median(l_discount) FROM d)",
            "l_tax": "(SELECT median(l_tax) FROM d)",
            "l_partkey": "CAST(round_even((SELECT median(l_partkey) FROM d), 0) AS BIGINT)"}),
        "impute_mode": _sql_impute({
            "l_returnflag": _sql_mode("l_returnflag"),
            "l_linestatus": _sql_mode("l_linestatus"),
            "l_quantity": _sql_mode("l_quantity")}),
        "impute_custom": _sql_impute({"l_returnflag": "'U'", "l_quantity": "CAST(0 AS DOUBLE)"}),
        "suggest_imputations": (
            f"SELECT column_name, CASE WHEN column_type IN ('DOUBLE', 'INTEGER') THEN 'mean' "
            f"ELSE 'mode' END AS strategy FROM ({_sql_null_counts(dls, _DLS_COLS, True, True)})"),
        "csv_bad_rows": (
            "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders "
            "WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT '-1', 'bad', CAST(count(*) AS VARCHAR) "
            "FROM orders WHERE o_orderpriority = '1-URGENT'"),
        "load_csv_dir": ("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, "
                         "CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"),
        "profile_report": (
            f"WITH t AS {do} SELECT 'total_rows' AS item, count(*) AS value FROM t "
            f"UNION ALL SELECT 'total_columns', 6 UNION ALL SELECT 'duplicates_count', "
            f"(SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) "
            f"UNION ALL SELECT 'preview_rows', least(5, (SELECT count(*) FROM t)) "
            f"UNION ALL SELECT 'type:' || column_type || ':' || column_name, 1 FROM (DESCRIBE orders)"),
        "find_duplicates_report": _sql_find_duplicates(),
        "statistical_summary": (
            f"SELECT *, (SELECT count(*) FROM events) AS total_rows, CAST(6 AS BIGINT) AS total_columns "
            f"FROM ({_sql_categorical('events', ['event_type', 'props'])})"),
        "statistical_summary_whole": _sql_summary_whole(
            "orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"], 6),
        "find_duplicates_rows": _sql_find_duplicates_rows(),
        "load_csv_dir_orders": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders",
        "catalog_tables": (
            "SELECT 'saved' AS step, 'a' AS name, count(*) AS n FROM orders "
            "UNION ALL SELECT 'saved', 'b', count(*) FROM orders WHERE o_orderstatus = 'F' "
            "UNION ALL SELECT 'replaced', 'a', count(*) FROM orders WHERE o_orderpriority = '1-URGENT' "
            "UNION ALL SELECT 'listed', unnest(['a', 'b']), 1 UNION ALL SELECT 'dropped', '', 2 UNION ALL SELECT 'left', '', 0"),
        "allowed_strategies": (
            f"SELECT column_name, CASE WHEN column_type = 'VARCHAR' THEN 'mode,custom' ELSE 'mean,median,mode,custom' END AS allowed "
            f"FROM (VALUES ('l_partkey', 'BIGINT', (SELECT count(*) - count(l_partkey) FROM {dl})), "
            f"('l_quantity', 'DOUBLE', (SELECT count(*) - count(l_quantity) FROM {dl})), "
            f"('l_discount', 'DOUBLE', (SELECT count(*) - count(l_discount) FROM {dl})), "
            f"('l_tax', 'DOUBLE', (SELECT count(*) - count(l_tax) FROM {dl})), "
            f"('l_returnflag', 'VARCHAR', (SELECT count(*) - count(l_returnflag) FROM {dl})), "
            f"('l_linestatus', 'VARCHAR', (SELECT count(*) - count(l_linestatus) FROM {dl}))) AS v(column_name, column_type, missing) "
            f"WHERE missing > 0"),
        "correlation_square": _sql_square("lineitem", li_num),
        "suggested_conversions": (
            f"WITH t AS {to} SELECT column_name, 'DOUBLE' AS new_type FROM ({suggest_parts}) "
            f"WHERE ne > 0 AND ok / ne > 0.95"),
        "scatter_sample": "SELECT CAST(1000 AS BIGINT) AS sampled, CAST(0 AS BIGINT) AS not_in_source",
        "impute_custom_text": (
            f"WITH d AS {dl} SELECT l_orderkey, coalesce(l_partkey, 3) AS l_partkey, l_linenumber, "
            f"coalesce(l_discount, 0.25) AS l_discount FROM d"),
        "entity_key_events": (
            "SELECT CASE WHEN count(*) - count(DISTINCT event_id) > 0 THEN 'event_id' "
            "WHEN count(*) - count(DISTINCT user_id) > 0 THEN 'user_id' END AS checked_column FROM events"),
        "drop_columns": "SELECT * EXCLUDE (p_type, p_size) FROM part",
        "numeric_summary": _sql_numeric("lineitem", li_num),
        "numeric_summary_nulls": _sql_numeric(dl, li_num),
        "numeric_table": (
            f"SELECT \"column\", count, coalesce(printf('%.2f', round(mean, 2)), 'N/A') AS mean_text, "
            f"coalesce(printf('%.2f', round(std, 2)), 'N/A') AS std_text FROM ("
            + " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean, "
                f"stddev_samp(CAST({c} AS DOUBLE)) AS std FROM {dl}" for c in li_num) + ")"),
        "categorical_summary": _sql_categorical("events", ["event_type", "props"]),
        "categorical_summary_documents": _sql_categorical("documents", ["text", "lang", "source"]),
        "top_values": _sql_top("orders", ["o_orderstatus", "o_orderpriority"], 5),
        "top_values_text": (
            f"SELECT \"column\", string_agg(value || ' (' || CAST(count AS VARCHAR) || ')', '; ' "
            f"ORDER BY rank) AS top_values FROM ({_sql_top('events', ['event_type', 'props'], 5)}) "
            f"GROUP BY 1"),
        "value_counts_documents": _sql_value_counts("documents", ["text", "lang", "source"]),
        "correlation_pairs": _sql_pairs("lineitem", li_num),
        "correlation_matrix": (f"WITH m AS {SQL_MADE_ORDERS}, "
                               + _sql_correlation_long("m", MADE_NUMERIC)[len("WITH "):]),
        "outlier_counts": f"WITH m AS {SQL_MADE_ORDERS}, " + _sql_outliers("m", MADE_NUMERIC)[5:],
        "insights": _sql_insights(),
        "bar_chart_data": ("SELECT o_orderpriority AS x, count(*) AS y FROM orders WHERE "
                           "o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY y DESC, x ASC LIMIT 50"),
        "bar_chart_ties": ("SELECT o_custkey AS x, count(*) AS y FROM orders WHERE "
                           "o_custkey IS NOT NULL GROUP BY 1 ORDER BY y DESC, x ASC LIMIT 50"),
        "preview": "SELECT * FROM nation LIMIT 5",
        "describe": ('SELECT column_name, column_type, "null" AS nullable FROM '
                     '(DESCRIBE lineitem)'),
        "csv_round_trip": ("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, "
                           "CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"),
        "csv_round_trip_documents": ("SELECT CAST(doc_id AS VARCHAR) AS doc_id, "
                                     "CASE WHEN text = '' THEN NULL ELSE text END AS text, "
                                     "CASE WHEN lang = '' THEN NULL ELSE lang END AS lang, "
                                     "CASE WHEN source = '' THEN NULL ELSE source END AS source, "
                                     "CAST(n_chars AS VARCHAR) AS n_chars "
                                     "FROM documents"),
        "cleaning_plan": _sql_cleaning_plan(),
        "numeric_summary_embeddings": _sql_numeric("embeddings", ["vec_id", "label"]),
        "duplicates_count_embeddings": (
            "SELECT (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM "
            "(SELECT DISTINCT * FROM embeddings)) AS duplicates_count"),
        "profile_columns_pages": _sql_null_counts("pages", ["page_id", "url", "html"],
                                                  positive=False, with_type=True),
        "auto_clean_pages": (
            "SELECT page_id, " + ", ".join(
                f"upper(CASE WHEN trim({c}) IN {NULL_LIKE_SQL} THEN NULL ELSE trim({c}) END) AS {c}"
                for c in ("url", "html")) + " FROM pages"),
        "categorical_summary_labels": _sql_categorical("labels", ["quality", "toxic"]),
        "exact_duplicate_texts": ("SELECT text FROM (SELECT text, count(*) OVER (PARTITION BY text) "
                                  "AS n FROM documents) WHERE n > 1"),
        "entity_duplicate_texts": (
            "WITH d AS (SELECT text, lang, source FROM documents), "
            "p AS (SELECT text FROM d WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1) "
            "SELECT text FROM (SELECT DISTINCT * FROM d WHERE text IN (SELECT * FROM p)) "
            "GROUP BY text HAVING count(*) > 1"),
        "suggest_charts": _sql_suggest_charts(),
        # the sample's definition: the 1000 copies of points with the smallest keys
        "scatter_data": (
            "WITH c AS (SELECT p_size AS x, p_retailprice AS y, row_number() OVER (PARTITION BY p_size, p_retailprice) AS k "
            "FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL) "
            "SELECT x, y FROM c ORDER BY md5(md5('42|' || x || '|' || y) || ':' || k) LIMIT 1000"),
        "scatter_data_whole": ("SELECT o_totalprice AS x, o_custkey AS y FROM orders "
                               "WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL"),
        "chart_data_histogram": ("SELECT l_returnflag AS x, count(*) AS y FROM lineitem WHERE "
                                 "l_returnflag IS NOT NULL GROUP BY 1 ORDER BY y DESC, x ASC LIMIT 50"),
        "stream_auto_clean": (f"SELECT {', '.join(auto_clean_cols)} FROM "
                              f"(SELECT {_sql_select(DIRT_CUSTOMER)} FROM customer)"),
        "correlation_pairs_nulls": _sql_pairs(SQL_DIRTY_LINEITEM, LINEITEM_NUMERIC),
        "correlation_pairs_wide": (f"WITH w AS (SELECT {_sql_select(WIDE_LINEITEM)} FROM lineitem) "
                                   + _sql_pairs("w", [a for _, a in WIDE_LINEITEM])),
        "profile_summary_benchmark": (
            "SELECT (SELECT count(*) FROM benchmark) AS total_rows, CAST(2 AS BIGINT) AS total_columns, "
            "(SELECT count(*) FROM benchmark) - (SELECT count(*) FROM (SELECT DISTINCT * FROM "
            "benchmark)) AS duplicates_count"),
    }
