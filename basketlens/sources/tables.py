"""The two event views over the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_of
from ..schema import EVENT_COLUMNS

CLICK_COLUMNS = ["event_time", "event_type", "product_id", "price", "user_id", "user_session"]


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clickstream view of ``events``; a session is one user on one day."""
    day = F.regexp_replace(F.col("ts").cast("date").cast("string"), "-", "")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type")).alias("event_type"),
        # ``props`` is one flat key; a pattern reads it several times faster than a JSON parser.
        F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).try_cast("long").alias("product_id"),
        F.col("value").alias("price"),
        "user_id",
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("user_session"),
    )


def retail_events(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = EVENT_COLUMNS
) -> DataFrame:
    """Retail view: ``lineitem`` rows are the events, ``part`` and ``orders`` describe them.

    A table is joined only if one of its columns is asked for, so a query over sessions
    or prices never shuffles ``lineitem`` against ``orders``. The joins are left joins on
    primary keys: they add columns and neither lose nor repeat an event. Spark broadcasts
    a side below its size threshold and otherwise splits skewed keys (AQE).
    """
    wanted = set(columns)
    flag = F.col("l_returnflag")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # The join that adds the least comes first: its columns take part in the shuffle of the next.
    if "user_id" in wanted:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey, "left")
    if wanted & {"category_id", "category_code", "brand"}:
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        rows = rows.join(part, rows.l_partkey == part.p_partkey, "left")
    expressions = {
        "event_time": lambda: F.col("l_shipdate"),
        "event_type": lambda: F.when(flag == "N", "view").when(flag == "R", "cart").when(flag == "A", "purchase"),
        "product_id": lambda: F.col("l_partkey"),
        "category_id": lambda: F.col("p_size").cast("long"),
        "category_code": lambda: F.when(F.col("p_type") != "PROMO", F.col("p_type")),
        "brand": lambda: F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")),
        "price": lambda: F.col("l_extendedprice"),
        "user_id": lambda: F.col("o_custkey"),
        "user_session": lambda: F.col("l_orderkey").cast("string"),
        "month": lambda: month_of("l_shipdate"),
    }
    return rows.select(*[expressions[c]().alias(c) for c in columns])
