"""Category by event type totals, their merge, and the reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, money, null_to_zero, parse_month_tag
from ..runtime import stage

KEYS = ["category_id", "event_type"]

# Means of means are summed in whole millionths, so that the order of rows cannot show.
MEAN_UNITS = 1_000_000.0


def _not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def category_aggregate(
    events: DataFrame, by: Sequence[str] = (), drop_null_keys: bool = False
) -> DataFrame:
    """Per category and event type: total_sales, avg_price, num_events, unique_products.

    A missing price counts as 0 in the total and in the mean, and ``num_events`` counts
    every event of the type. ``by`` adds group keys, ``month`` for instance. The distinct
    product count spreads a hot category over its products before the final merge.
    """
    if drop_null_keys:
        events = _not_null(events, KEYS)
    grouped = events.groupBy(*by, *KEYS).agg(
        F.sum(null_to_zero(amount("price"))).alias("sales"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("event_type").alias("num_events"),
        F.count_distinct("product_id").alias("unique_products"),
    )
    return grouped.select(
        *KEYS,
        money(F.col("sales")).alias("total_sales"),
        (money(F.col("sales")) / F.col("n_rows")).alias("avg_price"),
        "num_events",
        "unique_products",
        *by,
    )


def monthly_category_aggregate(events: DataFrame, month: str = "month", **options) -> DataFrame:
    """:func:`category_aggregate` for every month at once, the month a column."""
    totals = category_aggregate(events, by=[month], **options)
    return totals.withColumnRenamed(month, "month")


def category_partials(events: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """Mergeable partial sums per chunk, at (chunk, category, event type, product) grain."""
    return events.groupBy(*chunk, *KEYS, "product_id").agg(
        F.sum(null_to_zero(amount("price"))).alias("sales"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("event_type").alias("num_events"),
    )


def sum_category_partials(partials: DataFrame) -> DataFrame:
    """Partials of many chunks as partials of one: a row per category, event type and product."""
    sums = [F.sum(c).cast(partials.schema[c].dataType).alias(c) for c in ("sales", "n_rows", "num_events")]
    return partials.groupBy(*KEYS, "product_id").agg(*sums)


def merge_category_partials(
    partials: DataFrame,
    chunk: Sequence[str],
    merge: str = "exact",
    by: Sequence[str] = (),
) -> DataFrame:
    """Chunk partials to one row per category and event type.

    ``exact`` gives what one aggregate over all events gives. ``unweighted`` gives what
    merging finished chunk results gives: the mean of the chunk means and the sum of the
    chunk distinct counts.
    """
    if merge == "exact":
        totals = partials.groupBy(*by, *KEYS).agg(
            F.sum("sales").alias("sales"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("num_events").alias("num_events"),
            F.count_distinct("product_id").alias("unique_products"),
        )
        average = money(F.col("sales")) / F.col("n_rows")
    elif merge == "unweighted":
        per_chunk = partials.groupBy(*chunk, *KEYS).agg(
            F.sum("sales").alias("sales"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("num_events").alias("num_events"),
            F.count("product_id").alias("unique_products"),
        )
        mean = money(F.col("sales")) / F.col("n_rows")
        totals = per_chunk.groupBy(*by, *KEYS).agg(
            F.sum("sales").alias("sales"),
            (F.sum(F.rint(mean * MEAN_UNITS).cast("long")) / F.lit(MEAN_UNITS) / F.count(mean)).alias("mean_of_means"),
            F.sum("num_events").alias("num_events"),
            F.sum("unique_products").alias("unique_products"),
        )
        average = F.col("mean_of_means")
    else:
        raise ValueError(f"unknown merge {merge!r}")
    return totals.select(
        *KEYS,
        money(F.col("sales")).alias("total_sales"),
        average.alias("avg_price"),
        "num_events",
        "unique_products",
        *by,
    )


def _sum_money(column: str) -> Column:
    return money(F.sum(amount(column)))


def with_month_str(totals: DataFrame) -> DataFrame:
    """Add ``month_str`` (``yyyy-MM``) from the month tag; unreadable tags give null."""
    return totals.withColumn("month_str", parse_month_tag("month"))


def top_categories(totals: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` categories with the largest summed sales."""
    sums = _not_null(totals, ["category_id"]).groupBy("category_id").agg(_sum_money("total_sales").alias("total_sales"))
    return sums.orderBy(F.desc("total_sales"), "category_id").limit(n)


def events_pivot(totals: DataFrame, event_types: Sequence[str] | None = None) -> DataFrame:
    """Month by event type, summed ``num_events``, 0 where nothing happened.

    The columns are the types that occur (Spark stops above ``spark.sql.pivotMaxValues`` of
    them), or those listed. Events without a type are left out.
    """
    kept = _not_null(totals, ["month_str", "event_type"])
    types = None if event_types is None else list(event_types)
    return kept.groupBy("month_str").pivot("event_type", types).agg(F.sum("num_events")).na.fill(0)


def sales_pivot(totals: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Category by month, summed ``total_sales``, 0 where nothing was sold.

    The columns are the months that occur, up to ``spark.sql.pivotMaxValues``, or those listed. The cells are
    summed once and stored, and the months listed from them. :func:`sales_cells` has no bound on the months.
    """
    cells = sales_long(totals)
    if months is None:
        cells = stage(cells, "sales-cells")
        most = int(totals.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        months = sorted(r[0] for r in cells.select("month_str").distinct().limit(most + 1).collect())
        if len(months) > most:
            raise ValueError(f"more than {most} months: list those wanted, or use sales_cells")
    return cells.groupBy("category_id").pivot("month_str", list(months)).agg(F.first("total_sales")).na.fill(0)


def sales_cells(totals: DataFrame) -> DataFrame:
    """One row per category with its sales by month in a map, for any number of months: ``category_id, cells``."""
    cells = sales_long(totals).groupBy("category_id").agg(F.sort_array(F.collect_list(F.struct("month_str", "total_sales"))).alias("cells"))
    return cells.select("category_id", F.map_from_entries("cells").alias("cells"))


def sales_long(totals: DataFrame) -> DataFrame:
    """The cells of :func:`sales_pivot` that hold sales, one row each."""
    kept = _not_null(totals, ["category_id", "month_str"])
    return kept.groupBy("category_id", "month_str").agg(_sum_money("total_sales").alias("total_sales"))


def sales_by_month(totals: DataFrame) -> DataFrame:
    """Summed sales per month in order of month."""
    kept = _not_null(totals, ["month_str"])
    return kept.groupBy("month_str").agg(_sum_money("total_sales").alias("total_sales")).orderBy("month_str")
