from __future__ import annotations

import datetime as dt
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.operators import ordering, sampling
from basketlens.operators.ordering import TotalOrder, exact_percentile, global_rank, in_first, kth_smallest

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@few
@given(values=st.lists(st.integers(-(2**50), 2**50), min_size=1, max_size=60), data=st.data())
def test_kth_of_longs(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    found = kth_smallest(spark.createDataFrame([(v,) for v in values], "v bigint"), "v", k, buckets=4)
    want = sorted(values)[k - 1]
    assert (found.value, found.below, found.equal) == (want, sum(v < want for v in values), values.count(want))


@few
@given(values=st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60), data=st.data())
def test_kth_of_doubles(spark, values, data):
    k = data.draw(st.integers(1, len(values)))
    found = kth_smallest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k, buckets=4)
    assert found.value == sorted(values)[k - 1]


@pytest.mark.parametrize("values", [[-1.7e308, 0.0, 1.7e308], [0.0, 5e-324, 1e-323], [1e16, 1e16 + 2, 1e16 + 4], [-0.0, 0.0, 0.0]])
def test_kth_of_extreme_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [kth_smallest(df, "v", k).value for k in (1, 2, 3)] == values


def test_kth_refuses_infinities(spark):
    with pytest.raises(ValueError):
        kth_smallest(spark.createDataFrame([(1.0,), (float("inf"),)], "v double"), "v", 1)


def test_kth_out_of_range(spark):
    with pytest.raises(ValueError):
        kth_smallest(spark.createDataFrame([(1,), (None,)], "v bigint"), "v", 2)


@few
@given(values=st.lists(st.integers(0, 10_000).map(lambda c: c / 100), min_size=1, max_size=40))
def test_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    assert exact_percentile(df, "v", 0.5) == pytest.approx(statistics.median(values), rel=1e-12)


def test_median_of_nothing(spark):
    assert exact_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None


@few
@given(starts=st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=1, max_size=30), data=st.data())
def test_first_rows(spark, starts, data):
    """Heavy ties and missing order values, against a plain sort."""
    n = data.draw(st.integers(0, len(starts) + 1))
    rows = [(s, None if i == 0 else f"k{i:02d}") for i, s in enumerate(starts)]
    df = spark.createDataFrame(rows, "start bigint, key string")
    order = TotalOrder(F.floor(F.col("start") / 2), F.col("start"), F.col("key"))
    found = df.where(in_first(df, n, order)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert {tuple(r) for r in found} == set(order[:n])


@few
@given(seconds=st.lists(st.one_of(st.none(), st.integers(-200_000, 200_000)), min_size=1, max_size=30), data=st.data())
def test_first_rows_by_time(spark, seconds, data):
    n = data.draw(st.integers(1, len(seconds)))
    epoch = dt.datetime(1970, 1, 1)
    rows = [(None if s is None else epoch + dt.timedelta(seconds=s, microseconds=i % 2), f"k{i:02d}") for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "session_start timestamp_ntz, user_session string")
    found = {tuple(r) for r in df.where(in_first(df, n, ordering.by_time())).collect()}
    assert found == set(sorted(rows, key=lambda r: (r[0] is None, r[0] or epoch, r[1]))[:n])


def test_first_rows_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_ROWS", 10)
    df = spark.range(500).select(F.lit(7).alias("start"), F.format_string("%04d", "id").alias("key"))
    order = TotalOrder(F.col("start"), F.col("start"), F.col("key"))
    found = df.where(in_first(df, 123, order)).orderBy("key").collect()
    assert [r.key for r in found] == [f"{i:04d}" for i in range(123)]


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    ranked = global_rank(df, [F.col("v").desc()])
    assert rows_of(ranked) == [(v, 1000 - v) for v in range(1000)]


def test_pages_cover_everything(spark, monkeypatch):
    df = spark.range(95).select((F.col("id") % 3).alias("start"), F.format_string("%03d", "id").alias("key"))
    by_start = TotalOrder(F.col("start") * 0, F.col("start"), F.col("key"))
    order = sorted((tuple(r) for r in df.collect()))
    for top in (1000, 5):
        monkeypatch.setattr(ordering, "TOP_ROWS", top)
        pages = [ordering.page(df, by_start, o, 20).collect() for o in range(0, 100, 20)]
        assert [[tuple(r) for r in p] for p in pages] == [order[o : o + 20] for o in range(0, 100, 20)]
    numbered = ordering.numbered_pages(df, [F.col("start"), F.col("key")], 20)
    assert rows_of(numbered.groupBy("page").count()) == [(0, 20), (1, 20), (2, 20), (3, 20), (4, 15)]


def test_long_heads_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_ROWS", 5)
    df = spark.range(100).repartition(4)
    assert [r.id for r in ordering.head_rows(df, 40, [F.desc("id")]).collect()] == list(range(99, 59, -1))
    assert ordering.head_rows(df, 3).count() == 3
    assert ordering.head_rows(df, 40).distinct().count() == 40
    assert ordering.head_rows(df, 400).count() == 100


def test_pages_on_both_sides_of_the_limit(spark):
    df = spark.range(3000).select(F.floor(F.col("id") * 7919 % 3000 / 7).alias("start"), F.format_string("%04d", "id").alias("key")).repartition(6)
    order = TotalOrder(F.floor(F.col("start") / 50), F.col("start"), F.col("key"))
    want = sorted(tuple(r) for r in df.collect())
    for offset in (0, 400, 990, 1000, 1700, 2990):
        assert [tuple(r) for r in ordering.page(df, order, offset, 500).collect()] == want[offset : offset + 500]


@pytest.fixture(scope="module")
def session_rows(spark):
    return spark.range(1000).select(
        F.timestamp_seconds(F.floor(F.col("id") / 50)).cast("timestamp_ntz").alias("session_start"),
        F.format_string("s%04d", F.col("id") * 37 % 1000).alias("user_session"),
    )


def test_time_split(session_rows):
    train, test = sampling.time_split(session_rows, 0.81)
    keys = ["session_start", "user_session"]
    order = sorted(tuple(r) for r in session_rows.select(keys).collect())
    assert rows_of(train.select(keys)) == order[:810]
    assert rows_of(test.select(keys)) == order[810:]


def test_splits_and_samples_ignore_the_layout(session_rows):
    other = session_rows.repartition(7).orderBy(F.desc("user_session"))
    for f in (
        lambda df: sampling.sample_n(df, 100, "user_session"),
        lambda df: sampling.sample_fraction(df, 0.3, key="user_session"),
        lambda df: sampling.random_split(df, 0.8, "user_session")[0],
        lambda df: sampling.time_split(df)[1],
    ):
        assert rows_of(f(session_rows)) == rows_of(f(other))


def test_sample_sizes(session_rows):
    assert sampling.sample_n(session_rows, 100, "user_session").count() == 100
    assert sampling.sample_n(session_rows, 5000, "user_session").count() == 1000
    first = sampling.sample_n(session_rows, 100, "user_session", seed=1)
    assert rows_of(first) != rows_of(sampling.sample_n(session_rows, 100, "user_session", seed=2))
    train, test = sampling.random_split(session_rows, 0.8, "user_session")
    assert train.count() + test.count() == 1000
    assert 740 < train.count() < 860
    assert train.join(test, "user_session", "left_semi").count() == 0


def test_unions(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "a int, b string")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "b string, a int")
    assert rows_of(sampling.union_all([a, b])) == [(1, "x"), (1, "x"), (1, "x"), (2, "y")]
    assert rows_of(sampling.union_distinct([a, b])) == [(1, "x"), (2, "y")]
