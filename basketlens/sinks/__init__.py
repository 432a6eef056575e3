"""Writing events and results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import format_event_time
from ..operators.typing import NARROW_EVENTS, fitting_types, narrow
from ..runtime import matching_paths, move_path, path_exists, stage
from ..sources.events import read_events_csv, with_source_tag


#: A file's name without its ending, in its path.
FILE_NAME = r"([^/]+?)(?:\.[^/.]+)?$"


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    compression: str = "snappy",
    mode: str = "error",
) -> None:
    """Compressed Parquet.

    With ``partition_by`` rows are first rebalanced by those columns, so a folder gets few
    files of even size; AQE splits a value that holds a large part of the rows.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error", delimiter: str = ",", compression: str = "none") -> None:
    """CSV with a header and without row numbers; null is the empty string."""
    df.write.mode(mode).option("header", True).option("sep", delimiter).option("compression", compression).csv(path)


def write_events_csv(
    events: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error", delimiter: str = ",", compression: str = "none"
) -> None:
    """Events in their text form (``2019-10-01 00:00:00 UTC``)."""
    text = events.withColumn("event_time", format_event_time("event_time"))
    if partition_by:
        text = text.hint("rebalance", *partition_by)
        text.write.mode(mode).option("header", True).option("sep", delimiter).option("compression", compression).partitionBy(*partition_by).csv(path)
    else:
        write_csv(text, path, mode, delimiter, compression)


def convert_csv(
    spark: SparkSession,
    source: str,
    target: str,
    types: Mapping[str, str] = NARROW_EVENTS,
    month_pattern: str | None = None,
    per_file: bool = False,
    **options,
) -> None:
    """Event CSV files to one typed Parquet table under one schema.

    With ``per_file`` every input file gets its own folder, ``file=<its name without the ending>``, in the same table.

    ``types`` are narrower types wished for; a column with a value that does not fit keeps
    its type, so no id is lost. The files are parsed once, to a table that is read for the widths.
    ``month_pattern`` takes the month out of each file's path and gives each its folder.
    """
    events = read_events_csv(spark, source, **options)
    tags = {}
    if per_file:
        tags["file"] = FILE_NAME
    if month_pattern is not None:
        tags["month"] = month_pattern
    for name, pattern in tags.items():
        events = with_source_tag(events, pattern, name)
    events = stage(events, "parsed-csv")
    events = narrow(events, fitting_types(events, types))
    write_parquet(events, target, partition_by=list(tags))


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written only if it is not there.

    It is written next to ``path`` and moved there when complete, so whatever is found at
    ``path`` is whole or somebody else's: a folder that has files but was not completed by
    Spark is left alone and an error raised.
    """
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        if matching_paths(spark, f"{path}/*"):
            raise RuntimeError(f"{path} holds files but no complete table")
        aside = f"{path}.building-{uuid.uuid4().hex}"
        build().write.parquet(aside)
        move_path(spark, aside, path)
    return spark.read.parquet(path)
