"""Names to queries, names to SQL, and inputs several queries share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.sessions import session_aggregate
from ..runtime import SHUFFLES_FREED, configure, path_exists, settings, shared_root
from ..schema import EVENT_COLUMNS
from ..sinks import write_events_csv
from ..sources.tables import click_events, retail_events

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def shared_copy(spark: SparkSession, sf_dir: str, label: str, write: Callable[[str], None]) -> str:
    """The path of a table derived from ``sf_dir``, written on first use in this application."""
    digest = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    path = f"{shared_root(spark)}/{label}-{digest}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        with settings(spark, SHUFFLES_FREED):
            write(path)
    return path


def retail_csv(spark: SparkSession, sf_dir: str) -> str:
    """The retail view as event CSV."""
    return shared_copy(spark, sf_dir, "retail-csv", lambda p: write_events_csv(retail_events(spark, sf_dir), p, mode="overwrite"))


def retail_monthly_csv(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """The retail view as event CSV, a folder per month."""

    def write(path: str) -> None:
        events = retail_events(spark, sf_dir, [*EVENT_COLUMNS, "month"])
        write_events_csv(events, path, partition_by=["month"], mode="overwrite", compression=compression)

    label = "retail-monthly-csv" if compression == "none" else f"retail-monthly-csv-{compression}"
    return shared_copy(spark, sf_dir, label, write)


def stored_sessions(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """The session table of a view (``click`` or ``retail``), stored."""

    def write(path: str) -> None:
        if view == "click":
            events = click_events(spark, sf_dir)
        else:
            events = retail_events(spark, sf_dir, ["event_time", "event_type", "product_id", "price", "user_session"])
        session_aggregate(events).write.mode("overwrite").parquet(path)

    return spark.read.parquet(shared_copy(spark, sf_dir, f"{view}-sessions", write))
