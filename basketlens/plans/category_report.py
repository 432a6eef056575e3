"""Monthly event files to the category reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.categories import (
    events_pivot,
    monthly_category_aggregate,
    sales_by_month,
    sales_long,
    sales_pivot,
    top_categories,
    with_month_str,
)
from ..sinks import write_csv
from ..sources.events import read_category_csv, read_events_csv, with_source_tag


@dataclass(frozen=True)
class CategoryReport:
    totals: DataFrame
    by_month: DataFrame
    top: DataFrame
    volumes: DataFrame
    heat: DataFrame
    heat_cells: DataFrame


def aggregate_files(spark: SparkSession, source: str, target: str, pattern: str, on_bad: str = "drop", unreadable: str = "fail") -> None:
    """Category totals of every event CSV below ``source``, tagged by month, as CSV.

    ``unreadable="skip"`` goes on with the other files where one cannot be read.
    """
    events = read_events_csv(spark, source, on_bad=on_bad, unreadable=unreadable, glob="*.csv")
    tagged = with_source_tag(events, pattern)
    write_csv(monthly_category_aggregate(tagged, drop_null_keys=True), target)


def report(spark: SparkSession, totals_path: str) -> CategoryReport:
    """The reports over a stored category table.

    The pivots have a column per month or event type that occurs, up to ``spark.sql.pivotMaxValues``.
    ``heat_cells`` has no such bound.
    """
    totals = with_month_str(read_category_csv(spark, totals_path))
    return CategoryReport(
        totals=totals,
        by_month=sales_by_month(totals),
        top=top_categories(totals),
        volumes=events_pivot(totals),
        heat=sales_pivot(totals),
        heat_cells=sales_long(totals),
    )
