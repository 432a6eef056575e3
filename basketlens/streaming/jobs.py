"""Keeping the tables up to date with Structured Streaming.

Every job takes what is there and stops (``availableNow``); run it again, or with a
processing-time trigger, for new files. Progress is in the checkpoint folder.

Sessions and categories are kept as partial results per micro-batch, in
``<target>/batches=<first>-<last>/attempt=<k>``. A batch that is run again after a failure writes a
further attempt; readers take the last complete attempt of every batch, so they see a batch whole,
old or new. ``compact_sessions`` and ``compact_categories`` merge all complete batches into one such
folder, which then stands for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.columns import amount, money, null_to_zero
from ..learning.models import score
from ..operators.categories import KEYS, category_partials, merge_category_partials, sum_category_partials
from ..operators.sessions import SESSION, merge_session_fragments, session_columns, session_fragments, session_measures, sum_session_fragments
from ..operators.typing import narrow
from ..runtime import SHUFFLES_FREED, delete_path, matching_paths, settings
from ..schema import DEFAULT_LABELS, RAW_EVENTS, EventLabels
from ..sources.events import csv_options, judged

# Types that a stream can narrow to without losing an id.
NARROW_STREAM = {"price": "float"}

# State that grows with what is open. In Spark's default store it fills the heap, two versions of it.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def stream_events_csv(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    glob: str = "*.csv",
    on_bad: str = "fail",
    delimiter: str = ",",
    multiline: bool = True,
) -> DataFrame:
    """New event CSV files below ``path`` as a stream with typed times.

    ``max_files`` bounds a micro-batch; without it the first one takes everything there is.
    ``on_bad`` as in a batch read: with ``fail`` a bad row stops the stream until it is mended.
    ``multiline=False`` lets a large file be split, if no quoted field holds a line end.
    """

    def scan(wanted: StructType) -> DataFrame:
        reader = spark.readStream.schema(wanted).options(**csv_options(delimiter, multiline, on_bad))
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.csv(path)

    return judged(scan, RAW_EVENTS, delimiter, on_bad, ["event_time"])


def stream_convert(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    types: Mapping[str, str] = NARROW_STREAM,
    max_files: int | None = None,
    on_bad: str = "fail",
) -> StreamingQuery:
    """New CSV files to typed Parquet, each exactly once.

    A stream cannot look ahead, so ids keep their width unless ``types`` says otherwise; then a value
    that does not fit becomes null.
    """
    events = narrow(stream_events_csv(spark, source, max_files, on_bad=on_bad), types)
    return (
        events.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )


def _attempts(spark: SparkSession, target: str) -> dict[tuple[int, int], list[tuple[int, str]]]:
    """The attempts of every range of batches, complete or not, with a name per folder."""
    found: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for path in matching_paths(spark, f"{target}/batches=*/attempt=*"):
        first, last, attempt = map(int, re.search(r"batches=(\d+)-(\d+)/attempt=(\d+)$", path).groups())
        found.setdefault((first, last), []).append((attempt, path))
    return found


def complete_batches(spark: SparkSession, target: str) -> dict[tuple[int, int], str]:
    """The folder to read for each range of batches: the last complete attempt of the widest ranges."""
    done = set()
    for marker in matching_paths(spark, f"{target}/batches=*/attempt=*/_SUCCESS"):
        done.add(marker.rsplit("/", 1)[0])
    complete = {span: max((a, p) for a, p in attempts if p in done)[1] for span, attempts in _attempts(spark, target).items() if any(p in done for _, p in attempts)}
    inside = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1]
    return {span: path for span, path in complete.items() if not any(inside(span, other) for other in complete)}


def _store(partials: DataFrame, target: str, first: int, last: int) -> None:
    spark = partials.sparkSession
    attempt = 1 + max((a for a, _ in _attempts(spark, target).get((first, last), [])), default=0)
    partials.write.parquet(f"{target}/batches={first}-{last}/attempt={attempt}")


def _write_partials(
    events: DataFrame, target: str, checkpoint: str, partials: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        _store(partials(batch), target, batch_id, batch_id)

    with settings(events.sparkSession, SHUFFLES_FREED):
        return (
            events.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def _complete_folders(spark: SparkSession, target: str) -> list[str]:
    paths = sorted(complete_batches(spark, target).values())
    if not paths:
        raise FileNotFoundError(f"{target} has no complete batch yet")
    return paths


def _read_partials(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(*_complete_folders(spark, target))


def _compact(spark: SparkSession, target: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Merge all complete batches into one folder.

    Folders that an earlier merge already stood for are deleted; those just merged stay for readers
    that have begun with them.
    """
    before = complete_batches(spark, target)
    kept = set(before.values())
    for path in matching_paths(spark, f"{target}/batches=*/attempt=*/_SUCCESS"):
        if (folder := path.rsplit("/", 1)[0]) not in kept:
            delete_path(spark, folder)
    spans = sorted(before)
    gaps = [a for a, b in zip(spans, spans[1:]) if a[1] + 1 != b[0]]
    if len(spans) > 1 and not gaps:
        with settings(spark, SHUFFLES_FREED):
            _store(merge(spark.read.parquet(*kept)), target, spans[0][0], spans[-1][1])


def stream_sessions(events: DataFrame, target: str, checkpoint: str, labels: EventLabels = DEFAULT_LABELS) -> StreamingQuery:
    """Each micro-batch's session fragments to ``target``; a session may go on in any
    later batch. :func:`current_sessions` merges them."""
    return _write_partials(events, target, checkpoint, lambda batch: session_fragments(batch, [], labels))


def current_sessions(spark: SparkSession, target: str) -> DataFrame:
    """The session table over all complete batches."""
    folders = _complete_folders(spark, target)
    # Each folder has one row per session and product.
    return merge_session_fragments(spark.read.parquet(*folders), summed=len(folders) == 1)


def compact_sessions(spark: SparkSession, target: str) -> None:
    """One fragment per session and product instead of one per batch, session and product."""
    _compact(spark, target, sum_session_fragments)


def stream_closed_sessions(
    events: DataFrame,
    target: str,
    checkpoint: str,
    gap: str = "30 minutes",
    late: str = "10 minutes",
    labels: EventLabels = DEFAULT_LABELS,
) -> StreamingQuery:
    """Sessions to ``target`` as Parquet, each once, when it is closed.

    Events of one session key form a session while they are less than ``gap`` apart; it is closed when the watermark,
    ``late`` behind the latest event seen, has passed its last event by ``gap``. Its state is dropped then, and so are
    events that arrive behind the watermark, so state holds the open sessions only. The columns are those of the session
    table; the products of an open session are a set in its state. A session is one row of state in one task: for keys that hold a large part of all
    events :func:`stream_sessions` spreads them. State lies in RocksDB, in a bounded part of the memory: a first batch over all of history opens every
    session before the watermark closes any.
    """
    timed = events.withColumn("_ts", F.col("event_time").cast("timestamp")).withWatermark("_ts", late)
    sessions = timed.groupBy(SESSION, F.session_window("_ts", gap).alias("_window")).agg(
        *[m.alias(name) for name, m in session_measures(labels).items()],
        F.size(F.collect_set("product_id")).cast("bigint").alias("unique_products"),
    )
    with settings(events.sparkSession, STATE_ON_DISK):
        return (
            sessions.select(*session_columns())
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(target)
        )


def stream_category_partials(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's category partials to ``target``, exact distinct counts included."""
    return _write_partials(events, target, checkpoint, lambda batch: category_partials(batch, []))


def current_categories(spark: SparkSession, target: str) -> DataFrame:
    """Category totals over all complete batches."""
    return merge_category_partials(_read_partials(spark, target), [])


def compact_categories(spark: SparkSession, target: str) -> None:
    """One partial per category, event type and product instead of one per batch and those."""
    _compact(spark, target, sum_category_partials)


def stream_category_totals(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Exact category totals after each micro-batch to ``target``; :func:`current_category_totals` reads the last.

    Two levels: the state has a row per category, event type and product, spread over the products, so distinct
    products are counted exactly and no row grows; each batch sums it up. Only the totals before the last stay on disk.
    """
    products = category_partials(events, [])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = set(complete_batches(spark, target).values())
        _store(merge_category_partials(batch, []), target, 0, batch_id)
        # Readers may have begun with the totals before.
        for path in matching_paths(spark, f"{target}/batches=*/attempt=*/_SUCCESS"):
            folder = path.rsplit("/", 1)[0]
            if folder not in before and folder not in complete_batches(spark, target).values():
                delete_path(spark, folder)

    return (
        products.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_category_totals(spark: SparkSession, target: str) -> DataFrame:
    """The totals of the last complete batch of :func:`stream_category_totals`."""
    return _read_partials(spark, target)


def stream_category_aggregate(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Category totals as a stateful streaming aggregate, for update or complete mode.

    State is one row per group with a bounded sketch for the distinct products, so their
    count is approximate; :func:`stream_category_totals` counts exactly.
    """
    grouped = events.groupBy(*by, *KEYS).agg(
        F.sum(null_to_zero(amount("price"))).alias("sales"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("event_type").alias("num_events"),
        F.approx_count_distinct("product_id").alias("unique_products"),
    )
    return grouped.select(
        *KEYS,
        money(F.col("sales")).alias("total_sales"),
        (money(F.col("sales")) / F.col("n_rows")).alias("avg_price"),
        "num_events",
        "unique_products",
        *by,
    )


def stream_scores(model: PipelineModel, sessions: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Predictions for arriving sessions to Parquet."""
    return (
        score(model, sessions)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
