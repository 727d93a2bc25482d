"""Property tests (hypothesis) for the exact quantile search and the casts."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tablewash as tw
from tablewash.operators import quantiles as Q

values = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False)),
                  min_size=0, max_size=120)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_match_numpy(spark, vals, probs):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = Q.exact_quantiles(df, ["x"], probs, band_rows=3)["x"]  # few rows a band: passes over cells first
    present = np.array([v for v in vals if v is not None], dtype=float)
    if present.size == 0:
        assert got == [None] * len(probs)
    else:
        want = np.quantile(present, probs, method="linear")
        assert got == pytest.approx(list(want), rel=1e-9, abs=1e-9)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="0123456789.-+eE dfx", max_size=8)),
                max_size=40))
def test_conversion_counts_add_up(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rep = tw.conversion_report(df, [("t", "DOUBLE")]).first()
    converted = tw.convert_types(df, [("t", "DOUBLE")]).where("t IS NOT NULL").count()
    present = sum(t is not None for t in texts)
    assert rep["conversion_failures"] + converted == present


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, probs=st.lists(st.floats(0, 1), min_size=1, max_size=3),
       bits=st.sampled_from([2, 5, 12]))
def test_quantile_search_by_cells_matches_numpy(spark, vals, probs, bits):
    saved = (Q.BITS, Q.CELLS)
    Q.BITS, Q.CELLS = bits, 1 << bits
    try:
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        got = Q.exact_quantiles(df, ["x"], probs, band_rows=2)["x"]
    finally:
        Q.BITS, Q.CELLS = saved
    present = np.array([v for v in vals if v is not None], dtype=float)
    if present.size == 0:
        assert got == [None] * len(probs)
    else:
        assert got == pytest.approx(list(np.quantile(present, probs, method="linear")),
                                    rel=1e-9, abs=1e-9)


_cells = st.tuples(st.one_of(st.none(), st.integers(0, 3)),
                   st.one_of(st.none(), st.sampled_from(["a", "b", ""])),
                   st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.5, float("nan")])))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_cells, max_size=30))
def test_dedup_equals_counting(spark, data):
    def norm(rows):
        return sorted((tuple("nan" if isinstance(x, float) and x != x else x + 0.0 if isinstance(x, float) else x
                             for x in r) for r in rows), key=repr)

    df = spark.createDataFrame(data, "k int, s string, d double")
    rows = norm(map(tuple, data))
    counts = {r: rows.count(r) for r in rows}
    assert tw.duplicates_count(df) == len(rows) - len(counts)
    assert norm(tw.exact_duplicate_rows(df, None).collect()) == [r for r in rows if counts[r] > 1]
    assert norm(tw.remove_duplicates(df).collect()) == sorted(counts, key=repr)
    keys = sorted({r[1] for r in counts if r[1] is not None and sum(q[1] == r[1] for q in counts) > 1})
    assert sorted(r[0] for r in tw.entity_duplicate_keys(df, "s").collect()) == keys
