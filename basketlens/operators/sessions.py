"""Events to one row per session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, known, money, null_to_zero, seconds_between
from ..schema import DEFAULT_LABELS, EventLabels

SESSION = "user_session"

_MEASURES = {
    "first_time": F.min,
    "last_time": F.max,
    "total_events": F.sum,
    "n_views": F.sum,
    "n_add_to_cart": F.sum,
    "n_purchases": F.sum,
    "spent": F.sum,
    "viewed_sum": F.sum,
    "n_viewed_prices": F.sum,
    "max_price_viewed": F.max,
}


def session_measures(labels: EventLabels = DEFAULT_LABELS, count_null_types: bool = True) -> dict[str, Column]:
    """The aggregates of a session, but for its distinct products."""
    kind = F.col("event_type")
    viewed = known(F.when(kind == labels.view, F.col("price")))
    counted = F.lit(1) if count_null_types else kind
    return {
        "first_time": F.min("event_time"),
        "last_time": F.max("event_time"),
        "total_events": F.count(counted),
        "n_views": F.count_if(kind == labels.view),
        "n_add_to_cart": F.count_if(kind == labels.cart),
        "n_purchases": F.count_if(kind == labels.purchase),
        "spent": F.sum(F.when(kind == labels.purchase, amount("price"))),
        "viewed_sum": F.sum(amount(viewed)),
        "n_viewed_prices": F.count(viewed),
        "max_price_viewed": F.max(viewed),
    }


def session_columns(extra: Sequence[str] = (), duration: bool = True) -> list[Column]:
    """The session table's columns from ``session_measures`` and ``unique_products``."""
    columns = [F.col(c) for c in extra]
    columns += [
        F.col(SESSION),
        F.col("first_time").alias("session_start"),
        F.col("last_time").alias("session_end"),
    ]
    if duration:
        columns.append(seconds_between("first_time", "last_time").alias("session_duration"))
    columns += [F.col(c) for c in ("total_events", "n_views", "n_add_to_cart", "n_purchases")]
    columns += [
        money(null_to_zero("spent")).alias("total_spent"),
        (money(F.col("viewed_sum")) / F.nullif(F.col("n_viewed_prices"), F.lit(0))).alias("avg_price_viewed"),
        F.col("max_price_viewed"),
        F.col("unique_products"),
    ]
    return columns


def session_aggregate(
    events: DataFrame,
    labels: EventLabels = DEFAULT_LABELS,
    *,
    by: Sequence[str] = (),
    drop_null_keys: bool = False,
) -> DataFrame:
    """One row per session over all events; ``by`` adds group keys such as the source.

    Prices that are NaN or infinite count as missing.

    The distinct product count makes Spark aggregate by (session, product) first and by
    session second, combining before both shuffles, so a session that holds a large part
    of all rows is spread over its products and no task sees it whole.
    """
    if drop_null_keys:
        events = events.where(F.col(SESSION).isNotNull())
    measures = session_measures(labels, count_null_types=True)
    sessions = events.groupBy(*by, SESSION).agg(
        *[m.alias(name) for name, m in measures.items()],
        F.count_distinct("product_id").alias("unique_products"),
    )
    return sessions.select(*session_columns(by))


def session_aggregate_compact(events: DataFrame, labels: EventLabels = DEFAULT_LABELS) -> DataFrame:
    """The variant for narrowed files: float prices, only events with a type counted,
    events without a session left out, no duration column."""
    events = events.where(F.col(SESSION).isNotNull()).withColumn("price", F.col("price").cast("float"))
    measures = session_measures(labels, count_null_types=False)
    sessions = events.groupBy(SESSION).agg(
        *[m.alias(name) for name, m in measures.items()],
        F.count_distinct("product_id").alias("unique_products"),
    )
    return sessions.select(*session_columns(duration=False))


def session_fragments(
    events: DataFrame, by: Sequence[str], labels: EventLabels = DEFAULT_LABELS
) -> DataFrame:
    """Partial session rows per source, batch or month, which merge without loss.

    The grain is (``by``, session, product). Keeping the product as a key instead of a
    set per session bounds every row, however long the session.
    """
    measures = session_measures(labels, count_null_types=True)
    return events.groupBy(*by, SESSION, "product_id").agg(
        *[m.alias(name) for name, m in measures.items()]
    )


def sum_session_fragments(fragments: DataFrame) -> DataFrame:
    """Fragments of many batches as fragments of one: a row per session and product.

    They are dealt out by ranges of session and product, which is one shuffle as any other. A session's rows then lie together in a file, or in
    a few if they are many, and :func:`merge_session_fragments` combines them before its shuffle. A batch has a row per session
    and product, so no pair has more rows than there are batches.
    """
    combined = [combine(name).cast(fragments.schema[name].dataType).alias(name) for name, combine in _MEASURES.items()]
    return fragments.repartitionByRange(SESSION, "product_id").groupBy(SESSION, "product_id").agg(*combined)


def merge_session_fragments(fragments: DataFrame, summed: bool = False) -> DataFrame:
    """Fragments of any number of sources to the table :func:`session_aggregate` gives.

    ``summed`` says that there is one row per session and product, as of one source or from :func:`sum_session_fragments`: then
    products are counted where they are, without a shuffle by product.
    """
    products = F.count("product_id") if summed else F.count_distinct("product_id")
    sessions = fragments.groupBy(SESSION).agg(
        *[combine(name).alias(name) for name, combine in _MEASURES.items()],
        products.alias("unique_products"),
    )
    return sessions.select(*session_columns())


def spanning_sessions(events: DataFrame, period: Column | str) -> DataFrame:
    """Sessions with events in more than one period: ``user_session, n_periods, n_events``."""
    period = F.col(period) if isinstance(period, str) else period
    return (
        events.select(SESSION, period.alias("period"))
        .groupBy(SESSION, "period")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(SESSION)
        .agg(F.count("period").alias("n_periods"), F.sum("n").alias("n_events"))
        .where(F.col("n_periods") > 1)
    )
