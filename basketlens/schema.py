"""Schemas and label sets shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The event file layout, in file order.
EVENT_COLUMNS = [
    "event_time",
    "event_type",
    "product_id",
    "category_id",
    "category_code",
    "brand",
    "price",
    "user_id",
    "user_session",
]

# Event times are UTC wall-clock values, so they are kept without a zone and no
# result depends on the session time zone.
EVENTS = T.StructType(
    [
        T.StructField("event_time", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)

# As found in the text files: the time is still a string.
RAW_EVENTS = T.StructType(
    [T.StructField("event_time", T.StringType())] + EVENTS.fields[1:]
)

# The session table.
SESSIONS = T.StructType(
    [
        T.StructField("user_session", T.StringType()),
        T.StructField("session_start", T.TimestampNTZType()),
        T.StructField("session_end", T.TimestampNTZType()),
        T.StructField("session_duration", T.DoubleType()),
        T.StructField("total_events", T.LongType()),
        T.StructField("n_views", T.LongType()),
        T.StructField("n_add_to_cart", T.LongType()),
        T.StructField("n_purchases", T.LongType()),
        T.StructField("total_spent", T.DoubleType()),
        T.StructField("avg_price_viewed", T.DoubleType()),
        T.StructField("max_price_viewed", T.DoubleType()),
        T.StructField("unique_products", T.LongType()),
    ]
)

# The category table.
CATEGORY_TOTALS = T.StructType(
    [
        T.StructField("category_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("total_sales", T.DoubleType()),
        T.StructField("avg_price", T.DoubleType()),
        T.StructField("num_events", T.LongType()),
        T.StructField("unique_products", T.LongType()),
        T.StructField("month", T.StringType()),
    ]
)

# Model inputs, in model order.
PURCHASE_FEATURES = [
    "total_events",
    "n_views",
    "n_add_to_cart",
    "avg_price_viewed",
    "max_price_viewed",
    "unique_products",
    "session_duration",
]
PURCHASE_LABEL = "label_purchase"

SPEND_FEATURES = [
    "total_events",
    "session_duration_min",
    "n_views",
    "n_add_to_cart",
    "unique_products",
    "views_per_product",
    "cart_rate",
    "avg_price_viewed",
    "max_price_viewed",
]
SPEND_TARGET = "total_spent"

# Columns that identify a session or give its purchase away.
IDENTIFIERS = ["user_session", "session_start", "session_end"]
LEAKS = ["n_purchases", "total_spent"]

# Columns that share dictionaries.
DICTIONARY_COLUMNS = ["event_type", "category_code", "brand"]


@dataclass(frozen=True)
class EventLabels:
    """Values of ``event_type`` that the session columns count.

    The cart label differs between data sets (``cart`` or ``add_to_cart``); the
    output column is ``n_add_to_cart`` in either case.
    """

    view: str = "view"
    cart: str = "cart"
    purchase: str = "purchase"


DEFAULT_LABELS = EventLabels()
