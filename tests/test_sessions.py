from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens import runtime, schema
from basketlens.operators import categories, sessions
from basketlens.sources.tables import click_events, retail_events

EVENT = "event_time timestamp_ntz, event_type string, product_id bigint, category_id bigint, price double, user_session string"


def at(hour, minute=0):
    return dt.datetime(2019, 10, 1, hour, minute)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [
            (at(1), "view", 1, 10, 5.25, "a"),
            (at(2), "view", 1, 10, None, "a"),
            (at(3), "purchase", 2, 10, 7.5, "a"),
            (at(4), "purchase", 3, 11, None, "b"),
            (at(4), "cart", None, 11, 1.0, "b"),
            (at(5), "view", 4, 11, 2.0, None),
            (at(6), None, 5, None, 3.0, None),
            (None, "view", 6, 12, float("nan"), "c"),
        ],
        EVENT,
    )


def test_hand_made_sessions(events):
    result = {r.user_session: r for r in sessions.session_aggregate(events).collect()}
    assert set(result) == {"a", "b", "c", None}
    a = result["a"]
    assert (a.session_start, a.session_end, a.session_duration) == (at(1), at(3), 7200.0)
    assert (a.total_events, a.n_views, a.n_add_to_cart, a.n_purchases) == (3, 2, 0, 1)
    assert (a.total_spent, a.avg_price_viewed, a.max_price_viewed, a.unique_products) == (7.5, 5.25, 5.25, 2)
    b = result["b"]
    assert (b.total_spent, b.avg_price_viewed, b.max_price_viewed, b.unique_products) == (0.0, None, None, 1)
    assert result[None].total_events == 2
    c = result["c"]
    assert (c.session_duration, c.avg_price_viewed, c.max_price_viewed) == (None, None, None)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(
            st.integers(0, 5), st.sampled_from(["view", "cart", "purchase", "error", None]), st.one_of(st.none(), st.integers(1, 3)),
            st.one_of(st.none(), st.integers(0, 99_999)), st.sampled_from(["a", "b", None]),
        ),
        max_size=40,
    )
)
def test_against_plain_python(spark, rows):
    df = spark.createDataFrame(
        [(at(h), kind, product, 1, None if c is None else c / 100, key) for h, kind, product, c, key in rows], EVENT
    ).repartition(4)
    want = {}
    for key in {r[4] for r in rows}:
        mine = [r for r in rows if r[4] == key]
        views = [r[3] for r in mine if r[1] == "view" and r[3] is not None]
        spent = [r[3] for r in mine if r[1] == "purchase" and r[3] is not None]
        want[key] = (
            at(min(r[0] for r in mine)), at(max(r[0] for r in mine)), len(mine),
            *[sum(r[1] == t for r in mine) for t in ("view", "cart", "purchase")],
            sum(spent) / 100, sum(views) / 100 / len(views) if views else None, max(views) / 100 if views else None,
            len({r[2] for r in mine} - {None}),
        )
    found = {r.user_session: tuple(r)[1:3] + tuple(r)[4:] for r in sessions.session_aggregate(df).collect()}
    assert found == want


def test_schema(events):
    found = sessions.session_aggregate(events).schema
    assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in schema.SESSIONS]


def test_null_sessions_can_be_dropped(events):
    kept = sessions.session_aggregate(events, drop_null_keys=True)
    assert kept.where("user_session IS NULL").count() == 0
    compact = sessions.session_aggregate_compact(events)
    assert compact.where("user_session IS NULL").count() == 0


def test_compact_counts_typed_events_only(spark):
    events = spark.createDataFrame([(at(1), None, 1, 1, 1.0, "a"), (at(1), "view", 1, 1, 1.0, "a")], EVENT)
    assert sessions.session_aggregate_compact(events).first().total_events == 1
    assert sessions.session_aggregate(events).first().total_events == 2


def test_empty_and_single(spark):
    assert sessions.session_aggregate(spark.createDataFrame([], EVENT)).count() == 0
    one = sessions.session_aggregate(spark.createDataFrame([(at(1), "view", 1, 1, 1.0, "a")], EVENT)).first()
    assert one.session_duration == 0.0 and one.unique_products == 1


def test_labels(events):
    renamed = events.withColumn("event_type", F.when(F.col("event_type") == "cart", "add_to_cart").otherwise(F.col("event_type")))
    given = schema.EventLabels(cart="add_to_cart")
    assert rows_of(sessions.session_aggregate(renamed, given)) == rows_of(sessions.session_aggregate(events))


@pytest.mark.parametrize("chunks", [1, 3, 7])
def test_fragments_merge_to_the_whole(spark, sf_dir, chunks):
    events = click_events(spark, sf_dir).withColumn("chunk", F.pmod(F.xxhash64("event_time"), F.lit(chunks)))
    merged = sessions.merge_session_fragments(sessions.session_fragments(events, ["chunk"]))
    assert rows_of(merged) == rows_of(sessions.session_aggregate(events))


def test_layout_does_not_matter(spark, sf_dir):
    events = click_events(spark, sf_dir)
    expected = rows_of(sessions.session_aggregate(events))
    assert rows_of(sessions.session_aggregate(events.repartition(13))) == expected
    assert rows_of(sessions.session_aggregate(events.orderBy(F.desc("price")))) == expected


def test_hot_session(spark):
    """A third of the events in one session."""
    base = spark.range(9_000).select(
        F.lit(at(1)).cast("timestamp_ntz").alias("event_time"),
        F.lit("view").alias("event_type"),
        (F.col("id") % 1000).alias("product_id"),
        F.lit(1).cast("bigint").alias("category_id"),
        F.lit(0.1).alias("price"),
        F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("user_session"),
    )
    hot = sessions.session_aggregate(base).where("user_session = 'hot'").first()
    assert (hot.total_events, hot.unique_products, hot.avg_price_viewed) == (3000, 1000, 0.1)


def test_spanning(events):
    spans = sessions.spanning_sessions(events, F.hour("event_time").cast("string"))
    assert rows_of(spans) == [("a", 3, 3), (None, 2, 2)]


def test_category_totals(events):
    totals = {(r.category_id, r.event_type): r for r in categories.category_aggregate(events).collect()}
    views = totals[10, "view"]
    # The missing price counts as 0.
    assert (views.total_sales, views.avg_price, views.num_events, views.unique_products) == (5.25, 2.625, 2, 1)
    assert totals[None, None].num_events == 0
    dropped = categories.category_aggregate(events, drop_null_keys=True)
    assert dropped.where("category_id IS NULL OR event_type IS NULL").count() == 0


def test_exact_merge_equals_one_aggregate(spark, sf_dir):
    events = retail_events(spark, sf_dir, ["category_id", "event_type", "product_id", "price", "month"])
    partials = categories.category_partials(events, ["month"])
    assert rows_of(categories.merge_category_partials(partials, ["month"])) == rows_of(categories.category_aggregate(events))
    monthly = categories.merge_category_partials(partials, ["month"], by=["month"])
    assert rows_of(monthly) == rows_of(categories.monthly_category_aggregate(events))


def test_unweighted_merge_by_hand(spark):
    events = spark.createDataFrame(
        [("view", 1, 10, 2.0, 0), ("view", 1, 10, 4.0, 0), ("view", 1, 10, 9.0, 1)],
        "event_type string, product_id bigint, category_id bigint, price double, chunk int",
    )
    partials = categories.category_partials(events, ["chunk"])
    merged = categories.merge_category_partials(partials, ["chunk"], merge="unweighted").first()
    assert (merged.total_sales, merged.avg_price, merged.num_events, merged.unique_products) == (15.0, 6.0, 3, 2)
    with pytest.raises(ValueError):
        categories.merge_category_partials(partials, ["chunk"], merge="other")


def test_month_tags(spark):
    tags = spark.createDataFrame([("2019-Oct",), ("2019-11",), ("optimized",), (None,)], "month string")
    found = [r.month_str for r in categories.with_month_str(tags).collect()]
    assert found == ["2019-10", "2019-11", None, None]


def test_sales_by_any_number_of_months(spark):
    """The pivot names its limit; cells in a map have none and hold the same sums."""
    rows = [(c, f"m{k:03}", float(c * k)) for c in range(1, 5) for k in range(40) if (c + k) % 3]
    totals = spark.createDataFrame([*rows, (9, None, 1.0), (None, "m001", 1.0)], "category_id long, month_str string, total_sales double")
    cells = {r.category_id: r.cells for r in categories.sales_cells(totals).collect()}
    assert cells == {c: {m: v for x, m, v in rows if x == c} for c in range(1, 5)}
    wide = categories.sales_pivot(totals)
    assert wide.columns == ["category_id"] + sorted({m for _, m, _ in rows})
    for r in wide.collect():
        assert {m: r[m] for m in wide.columns[1:] if m in cells[r.category_id]} == cells[r.category_id]
        assert all(r[m] == 0 for m in wide.columns[1:] if m not in cells[r.category_id])
    spark.conf.set("spark.sql.pivotMaxValues", "10")
    try:
        with pytest.raises(ValueError, match="sales_cells"):
            categories.sales_pivot(totals)
        assert len(categories.sales_cells(totals).collect()) == 4
        assert categories.sales_pivot(totals, ["m001", "m002"]).columns == ["category_id", "m001", "m002"]
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_merged_fragments_keep_a_session_together(spark):
    """rows of a session lie in one partition, so they are combined before the shuffle by session; those of a huge session are spread."""
    day = dt.datetime(2019, 10, 1)
    small = [(day, "view", product, 1.5, f"s{k:03}") for k in range(400) for product in range(3)]
    huge = [(day, "purchase", product, 2.0, "t") for product in range(1200)]
    events = spark.createDataFrame([*small, *huge, (day, "view", None, 1.0, None), (day, "cart", 1, None, None)], "event_time timestamp_ntz, event_type string, product_id bigint, price double, user_session string")
    fragments = sessions.session_fragments(events, [])
    several = fragments.unionAll(fragments.where("product_id % 2 = 0"))
    with runtime.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        merged = sessions.sum_session_fragments(several)
        parts = merged.withColumn("part", F.spark_partition_id()).select("user_session", "part").distinct().groupBy("user_session").agg(F.count(F.lit(1)).alias("n")).collect()
    count = {r.user_session: r.n for r in parts}
    assert sum(n for s, n in count.items() if s != "t") <= 401 + 8 and count["t"] > 2
    expected = sessions.merge_session_fragments(several)
    assert sorted(map(repr, sessions.merge_session_fragments(merged, summed=True).collect())) == sorted(map(repr, expected.collect()))
