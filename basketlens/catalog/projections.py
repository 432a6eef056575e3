"""Scalar expressions, session features and model inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as fn
from ..functions import features
from ..sources.tables import click_events, retail_events
from . import sql
from .registry import query, stored_sessions

_IDS = ["user_session", "product_id"]


@query("prj_01_null_price", sql.retail("SELECT user_session, product_id, CASE WHEN brand IS NULL THEN 0 ELSE price END AS price FROM r"))
def _(spark, d):
    events = retail_events(spark, d, [*_IDS, "brand", "price"])
    # Prices of unbranded goods are taken away first.
    missing = F.when(F.col("brand").isNotNull(), F.col("price"))
    return events.select(*_IDS, fn.null_to_zero(missing).alias("price"))


@query(
    "prj_02_conditional_value",
    sql.click(
        """SELECT user_session, product_id, CASE WHEN event_type = 'purchase' THEN price ELSE 0 END AS spent,
        CASE WHEN event_type = 'view' THEN price ELSE NULL END AS viewed_price, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS is_view FROM c"""
    ),
)
def _(spark, d):
    kind = F.col("event_type")
    return click_events(spark, d).select(
        *_IDS,
        fn.value_if(kind == "purchase", "price", 0.0).alias("spent"),
        fn.value_if(kind == "view", "price").alias("viewed_price"),
        fn.flag(kind == "view").alias("is_view"),
    )


@query("prj_03_drop_nulls", sql.retail("SELECT DISTINCT brand FROM r WHERE brand IS NOT NULL"))
def _(spark, d):
    return retail_events(spark, d, ["brand"]).where(F.col("brand").isNotNull()).distinct()


@query("prj_04_clean_sessions", sql.with_sessions("c", "SELECT * FROM s"))
def _(spark, d):
    sessions = stored_sessions(spark, d, "click")
    # Zeros are made missing, so that cleaning has to bring them back.
    holes = {c: F.nullif(F.col(c), F.lit(0)) for c in ("n_views", "n_add_to_cart", "n_purchases", "total_spent", "session_duration")}
    return features.clean_sessions(sessions.withColumns(holes))


@query(
    "prj_05_duration",
    sql.with_sessions("c", f"SELECT user_session, COALESCE({sql.seconds('session_start', 'session_end')}, 0) AS session_duration FROM s"),
)
def _(spark, d):
    return features.with_duration(stored_sessions(spark, d, "click")).select("user_session", "session_duration")


@query(
    "prj_06_capped_minutes",
    sql.with_sessions(
        "r", "SELECT user_session, LEAST(session_duration / 60.0::DOUBLE, 1440.0::DOUBLE) AS session_duration_min FROM s"
    ),
)
def _(spark, d):
    minutes = fn.minutes_capped("session_duration").alias("session_duration_min")
    return stored_sessions(spark, d, "retail").select("user_session", minutes)


@query(
    "prj_07_views_per_product",
    sql.with_sessions(
        "c", "SELECT user_session, CAST(n_views AS DOUBLE) / CASE WHEN unique_products = 0 THEN 1 ELSE unique_products END AS views_per_product FROM s"
    ),
)
def _(spark, d):
    return stored_sessions(spark, d, "click").select("user_session", fn.ratio("n_views", "unique_products").alias("views_per_product"))


@query(
    "prj_08_cart_rate",
    sql.with_sessions(
        "c", "SELECT user_session, CAST(n_add_to_cart AS DOUBLE) / CASE WHEN n_views = 0 THEN 1 ELSE n_views END AS cart_rate FROM s"
    ),
)
def _(spark, d):
    return stored_sessions(spark, d, "click").select("user_session", fn.ratio("n_add_to_cart", "n_views").alias("cart_rate"))


@query("prj_09_purchase_label", sql.with_sessions("c", "SELECT user_session, CASE WHEN n_purchases > 0 THEN 1 ELSE 0 END AS label_purchase FROM s"))
def _(spark, d):
    return features.with_label(stored_sessions(spark, d, "click")).select("user_session", "label_purchase")


@query(
    "prj_10_viewed_prices",
    sql.with_sessions("c", "SELECT user_session, COALESCE(avg_price_viewed, 0) AS avg_price_viewed, COALESCE(max_price_viewed, 0) AS max_price_viewed FROM s"),
)
def _(spark, d):
    filled = features.fill_viewed_prices(stored_sessions(spark, d, "click"))
    return filled.select("user_session", "avg_price_viewed", "max_price_viewed")


@query(
    "prj_11_select_features",
    sql.with_sessions("c", "SELECT total_events, n_views, n_add_to_cart, unique_products, avg_price_viewed, max_price_viewed, total_spent FROM s"),
)
def _(spark, d):
    return features.select_features(stored_sessions(spark, d, "click"), schema.SPEND_FEATURES, schema.SPEND_TARGET)


@query(
    "prj_12_drop_leakage",
    sql.with_sessions(
        "c", "SELECT session_duration, total_events, n_views, n_add_to_cart, avg_price_viewed, max_price_viewed, unique_products FROM s"
    ),
)
def _(spark, d):
    return features.drop_leakage(stored_sessions(spark, d, "click"))


_FLOATS = ", ".join(f"CAST(COALESCE({c}, 0) AS FLOAT) AS {c}" for c in schema.PURCHASE_FEATURES)
_LABEL = "CAST(CASE WHEN n_purchases > 0 THEN 1 ELSE 0 END AS TINYINT) AS label_purchase"


@query("prj_13_fill_and_cast", sql.with_sessions("r", f"SELECT user_session, {_FLOATS}, {_LABEL} FROM s"))
def _(spark, d):
    return features.prepare(stored_sessions(spark, d, "retail"), "user_session")


@query(
    "prj_14_log_target",
    sql.with_sessions(
        "c", f"SELECT user_session, {sql.rounded('ln(1 + total_spent)', 9)} AS target, {sql.rounded('total_spent', 6)} AS total_spent FROM s"
    ),
)
def _(spark, d):
    logged = stored_sessions(spark, d, "click").withColumn("target", fn.log_target("total_spent"))
    return logged.select(
        "user_session",
        F.round("target", 9).alias("target"),
        F.round(fn.unlog_target("target"), 6).alias("total_spent"),
    )


@query(
    "prj_15_month_tag",
    sql.retail("SELECT user_session, product_id, CASE WHEN category_code IS NOT NULL THEN month END AS month_str FROM r"),
)
def _(spark, d):
    events = retail_events(spark, d, [*_IDS, "event_time", "category_code"])
    tag = F.when(F.col("category_code").isNull(), "optimized").otherwise(F.date_format("event_time", "yyyy-MMM"))
    return events.select(*_IDS, fn.parse_month_tag(tag).alias("month_str"))


@query("prj_16_day", sql.click("SELECT user_session, product_id, CAST(date_trunc('day', event_time) AS TIMESTAMP) AS day FROM c"))
def _(spark, d):
    return click_events(spark, d).select(*_IDS, fn.day_of("event_time").alias("day"))


FEATURE_SQL = """SELECT user_session, session_start, session_end, session_duration, total_events, n_views, n_add_to_cart, n_purchases,
  total_spent, COALESCE(avg_price_viewed, 0) AS avg_price_viewed, COALESCE(max_price_viewed, 0) AS max_price_viewed, unique_products,
  LEAST(session_duration / 60.0::DOUBLE, 1440.0::DOUBLE) AS session_duration_min,
  CAST(n_views AS DOUBLE) / CASE WHEN unique_products = 0 THEN 1 ELSE unique_products END AS views_per_product,
  CAST(n_add_to_cart AS DOUBLE) / CASE WHEN n_views = 0 THEN 1 ELSE n_views END AS cart_rate,
  CASE WHEN n_purchases > 0 THEN 1 ELSE 0 END AS purchase_flag FROM s"""


@query("prj_17_featurize", sql.with_sessions("r", FEATURE_SQL))
def _(spark, d):
    return features.featurize(stored_sessions(spark, d, "retail"))


@query("prj_18_prepare", sql.with_sessions("c", f"SELECT user_session, {_FLOATS}, {_LABEL} FROM s"))
def _(spark, d):
    return features.prepare(stored_sessions(spark, d, "click"), "user_session")


@query(
    "rm_05_frequency_features",
    sql.with_sessions(
        "c",
        """SELECT user_session, CAST(n_views AS DOUBLE) / total_events AS view_share,
        CAST(n_add_to_cart AS DOUBLE) / total_events AS cart_share, CAST(n_purchases AS DOUBLE) / total_events AS purchase_share,
        total_events / GREATEST(session_duration / 60.0::DOUBLE, 1.0::DOUBLE) AS events_per_minute FROM s""",
    ),
)
def _(spark, d):
    added = features.frequency_features(stored_sessions(spark, d, "click"))
    return added.select("user_session", "view_share", "cart_share", "purchase_share", "events_per_minute")


@query(
    "rm_06_time_features",
    sql.with_sessions(
        "c",
        """SELECT user_session, CAST(hour(session_start) AS INTEGER) AS start_hour, CAST(dayofweek(session_start) + 1 AS INTEGER) AS start_weekday,
        CASE WHEN dayofweek(session_start) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend FROM s""",
    ),
)
def _(spark, d):
    added = features.time_features(stored_sessions(spark, d, "click"))
    return added.select("user_session", "start_hour", "start_weekday", "is_weekend")
