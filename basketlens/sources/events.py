"""Reading event files and the tables derived from them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.columns import parse_event_time
from ..runtime import matching_paths

CORRUPT = "_corrupt_record"

# What to do with a bad row.
POLICIES = ("fail", "drop", "quarantine", "lenient", "trust")


def _paths(spark: SparkSession, paths, missing: str) -> list[str]:
    paths = [paths] if isinstance(paths, str) else list(paths)
    if missing == "skip":
        paths = [p for p in paths if matching_paths(spark, p)]
    return paths


def _files_with_quoted_lines(spark: SparkSession, paths: list[str], glob: str | None, options: Mapping[str, bool]) -> list[str]:
    """The files in which some line holds an odd number of quotes: a record may go on in the next line. One row per such file."""
    reader = spark.read.options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    quotes = lambda text: F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    line = F.col("value")
    # Counted with and without those behind a backslash.
    odd = (quotes(line) % 2 == 1) | (quotes(F.replace(line, F.lit('\\"'), F.lit(""))) % 2 == 1)
    return [r[0] for r in reader.text(paths).where(odd).select(F.col("_metadata.file_path")).distinct().collect()]


def _typed(file_schema: T.StructType, times: Sequence[str]) -> T.StructType:
    """What the CSV source reads: times as text, and the text of rows that it cannot read."""
    fields = [T.StructField(f.name, T.StringType() if f.name in times else f.dataType) for f in file_schema.fields]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def csv_options(delimiter: str, multiline: bool, on_bad: str) -> dict[str, str]:
    """Settings of Spark's CSV source for :func:`judged`; fields are counted unless nothing is judged."""
    flags = {"header": True, "multiLine": multiline, "columnPruning": on_bad == "trust"}
    return {**{k: str(v).lower() for k, v in flags.items()}, **_record_options(delimiter)}


def _record_options(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def judged(scan: Callable[[T.StructType], DataFrame], file_schema: T.StructType, delimiter: str, on_bad: str, times: Sequence[str]) -> DataFrame:
    """Typed rows of a batch or streaming CSV scan under a policy; see :func:`read_raw_csv`.

    ``scan`` reads under the schema it is given. The source itself counts fields and reads numbers; it drops columns that no
    one asks for only where the policy does not look at them.
    """
    if on_bad not in POLICIES:
        raise ValueError(f"unknown policy {on_bad!r}")
    names, corrupt = file_schema.names, F.col(CORRUPT)
    rows = scan(_typed(file_schema, times))
    # The source reads no column that is not named, and not the texts of bad rows alone.
    named = lambda wanted: F.xxhash64(*(F.col(f"`{n}`") for n in wanted)).bitwiseAND(F.lit(0)) == 0
    value = lambda n: parse_event_time(F.col(f"`{n}`")) if n in times else F.col(f"`{n}`")
    columns = [value(n).alias(n) for n in names]
    if on_bad == "trust":
        return rows.select(*columns)
    if on_bad == "lenient":
        # Only rows the source marked are looked at again: too few fields, too many, or unreadable ones.
        texts = ", ".join(f"`{n}` string" for n in names)
        again = lambda more: F.from_csv(corrupt, f"{texts}{more}, {CORRUPT} string", _record_options(delimiter))
        exact, wider = again(""), again(", _surplus string")
        surplus = wider[CORRUPT].isNull() | wider["_surplus"].isNotNull() | (exact[CORRUPT].isNotNull() & exact[names[-1]].isNotNull())
        return rows.where(F.when(corrupt.isNull(), named(names[:1])).otherwise(~surplus)).select(*columns)
    late = reduce(or_, [F.col(f"`{n}`").isNotNull() & value(n).isNull() for n in times], F.lit(False))
    # Whichever columns are wanted, the verdict is the same.
    bad = corrupt.isNotNull() | late | ~named(names)
    if on_bad == "drop":
        return rows.where(~bad).select(*columns)
    if on_bad == "fail":
        shown = F.coalesce(corrupt, F.concat_ws(delimiter, *(F.col(f"`{n}`").cast("string") for n in names)))
        stop = F.raise_error(F.concat(F.lit("MALFORMED row: "), shown)).cast("boolean")
        return rows.where(F.when(bad, stop).otherwise(F.lit(True))).select(*columns)
    if not times:
        return rows.where(named(names)).select(*columns, CORRUPT)
    # A row of which only a time is wrong has been read, so its text is gone. Under a schema one column too wide the source marks
    # it, with its text; only those rows are taken from that second scan.
    wide = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_surplus", T.StringType()), T.StructField(CORRUPT, T.StringType())])
    texts = scan(wide)
    read = {f.name: value(f.name) if f.name in times else F.col(f"`{f.name}`").try_cast(f.dataType) for f in file_schema.fields}
    readable = reduce(and_, [F.col(f"`{n}`").isNull() | read[n].isNotNull() for n in names if n not in times], F.lit(True))
    # Fields are counted in one line; line ends in quotes are no matter for that.
    fields = ", ".join(f"`{n}` string" for n in names)
    counted = F.from_csv(F.translate(corrupt, "\r\n", "  "), f"{fields}, {CORRUPT} string", _record_options(delimiter))
    texts = texts.where(late & readable & corrupt.isNotNull() & counted[CORRUPT].isNull())
    good = rows.where(~(late & corrupt.isNull()) & named(names))
    return good.select(*columns, CORRUPT).unionByName(texts.select(*(read[n].alias(n) for n in names), CORRUPT))


def read_raw_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    file_schema: T.StructType = schema.RAW_EVENTS,
    delimiter: str = ",",
    on_bad: str = "fail",
    glob: str | None = None,
    missing: str = "fail",
    times: Sequence[str] = (),
    multiline: bool | None = None,
    unreadable: str = "fail",
) -> DataFrame:
    """Delimited text with a header line per file under a fixed schema.

    ``on_bad`` says what a row with the wrong number of fields or an unreadable value does:
    ``fail`` stops the job, ``drop`` leaves the row out, ``quarantine`` keeps it with its text as
    it was in ``_corrupt_record``. These judge a row by all its fields, whichever columns are wanted, so all are read.
    ``lenient`` keeps rows with too few fields, the missing ones
    null, makes unreadable values null, and leaves out rows with too many fields. ``trust`` judges nothing:
    only the columns wanted are parsed, unreadable values are null, surplus fields ignored. Bytes that
    are not UTF-8 become U+FFFD. ``missing="skip"`` passes over paths and patterns that match nothing.

    ``unreadable="skip"`` passes over files that cannot be read to their end (a broken archive, a file that has gone): what was read
    of them up to there is kept. Rows that can be read but are wrong are ``on_bad``'s matter.

    ``multiline`` says whether quoted fields may hold line ends. Such a file is read by one task; without, files are
    split. By default a pass over the lines looks for files that need it.
    """
    if on_bad not in POLICIES:
        raise ValueError(f"unknown policy {on_bad!r}")
    found = _paths(spark, paths, missing)
    if not found:
        empty = lambda wanted: spark.createDataFrame([], wanted)
        return judged(empty, file_schema, delimiter, on_bad, times)
    if unreadable not in ("fail", "skip"):
        raise ValueError(f"unknown choice {unreadable!r}")
    skip = {"ignoreCorruptFiles": unreadable == "skip", "ignoreMissingFiles": unreadable == "skip"}
    whole = _files_with_quoted_lines(spark, found, glob, skip) if multiline is None else []

    def scan(wanted: T.StructType) -> DataFrame:
        reader = spark.read.schema(wanted).options(**skip)
        if glob:
            reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        plain = reader.options(**csv_options(delimiter, bool(multiline), on_bad)).csv(found)
        if not whole:
            return plain
        own = F.col("_metadata.file_path")
        quoted = spark.read.schema(wanted).options(**skip).options(**csv_options(delimiter, True, on_bad)).csv([unquote(p) for p in whole])
        return plain.where(~own.isin(whole)).unionByName(quoted)

    return judged(scan, file_schema, delimiter, on_bad, times)


def read_events_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    columns: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Event CSV with typed times. Under ``lenient`` and ``trust`` the scan reads no other column than ``columns``."""
    events = read_raw_csv(spark, paths, times=["event_time"], **options)
    return events.select(*columns) if columns else events


def split_quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their text and what could be read) of a ``quarantine`` read."""
    good = events.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, events.where(F.col(CORRUPT).isNotNull())


def read_events_parquet(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    columns: Sequence[str] | None = None,
    missing: str = "fail",
    glob: str | None = None,
) -> DataFrame:
    """Event Parquet files; ``columns`` is a projection the scan honours."""
    found = _paths(spark, paths, missing)
    if not found:
        events = spark.createDataFrame([], schema.EVENTS)
    else:
        reader = spark.read
        if glob:
            reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
        events = reader.parquet(*found)
    return events.select(*columns) if columns else events


def read_category_csv(spark: SparkSession, path: str) -> DataFrame:
    """The category totals written by :func:`basketlens.sinks.write_csv`."""
    return spark.read.schema(schema.CATEGORY_TOTALS).option("header", True).csv(path)


def with_source_tag(df: DataFrame, pattern: str, name: str = "month", group: int = 1) -> DataFrame:
    """Tag each row with the part of its file's path that ``pattern`` captures; null without a match."""
    try:
        path = df.select("_metadata.file_path") and F.col("_metadata.file_path")
    except AnalysisException:  # rows of several scans
        path = F.input_file_name()
    return df.withColumn(name, F.when(path.rlike(pattern), F.regexp_extract(path, pattern, group)))


def infer_types(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", glob: str | None = None) -> T.StructType:
    """Column types that fit every row of the files, to be used for the whole read.

    One distributed pass; what reaches the driver is a type per column.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("inferSchema", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.csv(path if isinstance(path, str) else list(path)).schema
