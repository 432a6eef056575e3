"""What the plans must look like to hold on large tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketlens.operators import categories, ordering, sampling, sessions, summaries
from basketlens.operators.dictionary import build_dictionary, encode
from basketlens.runtime import stage
from basketlens.sources.tables import click_events, retail_events

SESSION_COLUMNS = ["event_time", "event_type", "product_id", "price", "user_session"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_read_their_columns_and_join_nothing(spark, sf_dir):
    text = plan(sessions.session_aggregate(retail_events(spark, sf_dir, SESSION_COLUMNS)))
    assert "Join" not in text
    assert "l_comment" not in text and "l_tax" not in text and "l_suppkey" not in text


def test_sessions_are_spread_over_products_before_the_session_shuffle(spark, sf_dir):
    text = plan(sessions.session_aggregate(click_events(spark, sf_dir)))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2
    assert "product_id" in exchanges[1] and "product_id" not in exchanges[0]
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_counts_combine_before_the_shuffle(spark, sf_dir):
    text = plan(summaries.top_values(retail_events(spark, sf_dir, ["brand"]), "brand"))
    assert "TakeOrderedAndProject" in text
    assert text.index("functions=[count(1)]") < text.index("Exchange") < text.index("partial_count(1)")


def test_time_filters_reach_the_scan(spark, sf_dir):
    late = retail_events(spark, sf_dir, ["event_time", "price"]).where(F.col("event_time") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    assert "GreaterThanOrEqual(l_shipdate" in plan(late)


def test_time_split_moves_no_rows(spark, sf_dir):
    table = stage(sessions.session_aggregate(click_events(spark, sf_dir)), "split-plan")
    train, test = sampling.time_split(table)
    for part in (train, test, sampling.sample_n(table, 100, "user_session")):
        assert "Exchange" not in plan(part) and "Window" not in plan(part)


def test_rank_gathers_partition_sizes_only(spark, sf_dir):
    table = retail_events(spark, sf_dir, ["user_session"]).distinct()
    ranked = ordering.global_rank(table, [F.col("user_session")])
    text = plan(ranked)
    single = text.index("SinglePartition")
    below = text[single:]
    # Under the one-partition window lies the aggregate of sizes, over positions alone.
    assert "HashAggregate" in below and "user_session" not in below
    assert "BroadcastHashJoin" in text


def test_encoding_checks_the_size_before_it_broadcasts(spark, sf_dir):
    events = retail_events(spark, sf_dir, ["event_type", "price"])
    codes = build_dictionary([events], ["event_type"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # Without Spark's own broadcasts, only ours are left.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        small = plan(encode(events, codes, ["event_type"]))
        large = plan(encode(events, codes, ["event_type"], broadcast_bytes=0))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in small
    assert "SortMergeJoin" in large


def test_a_hot_value_is_split_when_encoding_by_shuffle(spark):
    """A third of the rows share one brand and a third have none."""
    events = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("b"), F.col("id").cast("string"))).alias("brand"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    events = stage(events, "hot-events")
    codes = build_dictionary([events], ["brand"])
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        encoded = encode(events, codes, ["brand"], broadcast_bytes=0)
        assert encoded.groupBy().agg(F.count("brand_code"), F.count(F.lit(1))).first()[:] == (200_000, 300_000)
        encoded.write.format("noop").mode("overwrite").save()
        counted = encoded.select("brand_code", "payload")
        counted.collect()
        assert "skew=true" in plan(counted)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_partitioned_writes_are_rebalanced(spark, sf_dir):
    events = retail_events(spark, sf_dir, ["month", "price"])
    assert "RebalancePartitions [month" in events.hint("rebalance", "month")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("build", [categories.category_aggregate, categories.monthly_category_aggregate])
def test_categories_are_spread_over_products(spark, sf_dir, build):
    events = retail_events(spark, sf_dir, ["category_id", "event_type", "product_id", "price", "month"])
    exchanges = [line for line in plan(build(events)).splitlines() if "Exchange hashpartitioning" in line]
    assert "product_id" in exchanges[1] or "l_partkey" in exchanges[1]


def test_no_plan_has_a_cartesian_product(spark, sf_dir):
    from basketlens.catalog import QUERIES

    for name in ("agg_08_monthly_category_aggregate", "prf_02_distinct", "typ_08_encode", "srt_04_numbered_pages", "rm_02_confusion_matrix"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
