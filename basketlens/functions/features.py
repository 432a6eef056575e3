"""Session rows to model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .columns import flag, minutes_capped, ratio, seconds_between

_COUNTS = ["n_views", "n_add_to_cart", "n_purchases", "unique_products"]
_AMOUNTS = ["session_duration", "total_spent"]
_VIEWED = ["avg_price_viewed", "max_price_viewed"]


def clean_sessions(sessions: DataFrame) -> DataFrame:
    """Missing counts and amounts become 0 and get their stored types; the viewed prices
    stay null for a session without views."""
    fixed = {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in _COUNTS}
    fixed |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _AMOUNTS}
    return sessions.withColumns({c: e for c, e in fixed.items() if c in sessions.columns})


def fill_viewed_prices(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in _VIEWED})


def with_duration(sessions: DataFrame) -> DataFrame:
    """``session_duration`` in seconds from the two times, 0 if either is missing."""
    seconds = F.coalesce(seconds_between("session_start", "session_end"), F.lit(0.0))
    return sessions.withColumn("session_duration", seconds)


def with_label(sessions: DataFrame, dtype: str = "int") -> DataFrame:
    """``label_purchase``: 1 if the session bought anything."""
    return sessions.withColumn(schema.PURCHASE_LABEL, flag(F.col("n_purchases") > 0, dtype))


def select_features(df: DataFrame, names: Sequence[str], *others: str) -> DataFrame:
    """The listed features that exist, in their order, and ``others``."""
    return df.select(*[c for c in names if c in df.columns], *others)


def drop_leakage(df: DataFrame) -> DataFrame:
    """Without the columns that identify a session or reveal its purchase."""
    return df.drop(*schema.IDENTIFIERS, *schema.LEAKS)


def featurize(sessions: DataFrame) -> DataFrame:
    """Session rows with the spend model's derived columns added."""
    clean = fill_viewed_prices(clean_sessions(sessions))
    return clean.withColumns(
        {
            "session_duration_min": minutes_capped("session_duration"),
            "views_per_product": ratio("n_views", "unique_products"),
            "cart_rate": ratio("n_add_to_cart", "n_views"),
            "purchase_flag": flag(F.col("n_purchases") > 0),
        }
    )


def prepare(sessions: DataFrame, *keep: str) -> DataFrame:
    """The purchase model's inputs as floats and its label as a byte.

    ``keep`` passes other columns through (a key to sort by, say); they are not features.
    """
    labelled = with_label(with_duration(sessions), "tinyint")
    features = [c for c in schema.PURCHASE_FEATURES if c in labelled.columns]
    return labelled.select(
        *keep,
        *[F.coalesce(F.col(c).cast("float"), F.lit(0).cast("float")).alias(c) for c in features],
        schema.PURCHASE_LABEL,
    )


def frequency_features(sessions: DataFrame) -> DataFrame:
    """Share of each event type and events per minute, added.

    A session shorter than a minute counts as one minute long.
    """
    minutes = F.greatest(F.col("session_duration") / 60.0, F.lit(1.0))
    return sessions.withColumns(
        {
            "view_share": ratio("n_views", "total_events"),
            "cart_share": ratio("n_add_to_cart", "total_events"),
            "purchase_share": ratio("n_purchases", "total_events"),
            "events_per_minute": F.col("total_events") / minutes,
        }
    )


def time_features(sessions: DataFrame) -> DataFrame:
    """Hour, weekday (1 = Sunday) and weekend flag of the session start, added."""
    start = F.col("session_start")
    weekday = F.dayofweek(start.cast("date"))
    return sessions.withColumns(
        {
            "start_hour": F.hour(start),
            "start_weekday": weekday,
            "is_weekend": flag(weekday.isin(1, 7)),
        }
    )
