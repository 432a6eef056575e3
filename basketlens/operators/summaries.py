"""Whole-table summaries: counts, histograms, price statistics, top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, day_of, known, money
from .ordering import percentile_of_counts, value_counts

#: Size of a price sketch: the rank error falls with it.
SKETCH_SIZE = 500


def row_counts(df: DataFrame, source: str | None = None) -> DataFrame:
    """``n_rows``, per value of ``source`` if named."""
    grouped = df.groupBy(source) if source else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"))


def event_type_counts(events: DataFrame) -> DataFrame:
    """Events per type, most frequent first."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), F.col("event_type").asc_nulls_last())


def price_summary(events: DataFrame, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """``min_price, avg_price, max_price, median_price``; NaN and infinite prices do not count.

    The median is a bounded-size sketch by default. ``exact=True`` counts each distinct price in
    one scan and finds everything, the interpolated median too, on those counts.
    """
    price = known("price")
    if exact:
        counts = value_counts(events, price)
        median = F.lit(percentile_of_counts(counts, 0.5)).cast("double")
        price, weight = F.col("v"), F.col("n")
        total, n = F.sum(amount(price) * weight.cast("decimal(20,0)")), F.sum(F.when(price.isNotNull(), weight))
        events = counts
    else:
        median = F.percentile_approx(price, 0.5, accuracy)
        total, n = F.sum(amount(price)), F.count(price)
    return events.agg(
        F.min(price).alias("min_price"),
        (money(total) / F.nullif(n, F.lit(0))).alias("avg_price"),
        F.max(price).alias("max_price"),
        median.alias("median_price"),
    )


def price_sketches(events: DataFrame, by: Sequence[str], k: int = SKETCH_SIZE) -> DataFrame:
    """``by, n, total, low, high, sketch`` per source, batch or month: partial price summaries that merge.

    The sketch (KLL) holds a bounded number of prices; partials of any parts can be stored and
    united later by :func:`merge_price_sketches`.
    """
    price = known("price")
    return events.groupBy(*by).agg(
        F.count(price).alias("n"),
        F.sum(amount(price)).alias("total"),
        F.min(price).alias("low"),
        F.max(price).alias("high"),
        F.kll_sketch_agg_double(price.cast("double"), k).alias("sketch"),
    )


def merge_price_sketches(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and the columns of :func:`price_summary` over all parts.

    All but the median are exact. Its rank differs from the middle by 0.5 % at most, with 99 % confidence, at the default size; a
    part without prices adds nothing.
    """
    some = partials.where("n > 0")
    merged = some.groupBy(*by).agg(
        F.min("low").alias("min_price"),
        (money(F.sum("total")) / F.sum("n")).alias("avg_price"),
        F.max("high").alias("max_price"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    # A sketch of nothing has no quantiles.
    median = F.when(F.col("min_price").isNotNull(), F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5)))
    return merged.select(*by, "min_price", "avg_price", "max_price", median.alias("median_price"))


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values (null is a value); ties go to the smaller value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    return counts.orderBy(F.desc("freq"), F.col(column).asc_nulls_last()).limit(n)


def events_per_day(events: DataFrame) -> DataFrame:
    """Events per day, earliest first."""
    days = events.groupBy(day_of("event_time").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return days.orderBy("day")
