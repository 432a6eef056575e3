"""Scans, files and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import format_event_time
from ..operators import categories, profile, sessions
from ..operators.ordering import head_rows
from ..operators.sampling import union_all
from ..operators.summaries import event_type_counts, row_counts
from ..operators.typing import describe
from ..runtime import scratch_path
from ..schema import CATEGORY_TOTALS, EVENT_COLUMNS, EVENTS
from ..sinks import convert_csv, materialize, write_csv, write_parquet
from ..sources import files
from ..sources.events import (
    infer_types,
    read_category_csv,
    read_events_csv,
    read_events_parquet,
    split_quarantine,
    with_source_tag,
)
from ..sources.tables import click_events, retail_events
from . import sql
from .aggregates import CATEGORY_COLUMNS, SESSION_COLUMNS
from .registry import query, retail_csv, retail_monthly_csv

ALL_EVENTS = sql.retail(f"SELECT {sql.EVENT_LIST} FROM r")
MONTH_FOLDER = r"month=(\d{4}-\d{2})/"


@query("src_01_events_csv", ALL_EVENTS)
def _(spark, d):
    return read_events_csv(spark, retail_csv(spark, d))


@query("src_02_projected_scan", sql.retail("SELECT category_id, event_type, product_id, price FROM r"))
def _(spark, d):
    return read_events_csv(spark, retail_csv(spark, d), columns=CATEGORY_COLUMNS, on_bad="trust")


def _dirty_csv(spark, d):
    """The retail events with cart rows of no brand given a field too many and purchase
    rows of no category an unreadable product."""
    events = retail_events(spark, d)
    unreadable = (F.col("event_type") == "purchase") & F.col("category_code").isNull()
    surplus = (F.col("event_type") == "cart") & F.col("brand").isNull()
    product = F.col("product_id").cast("string")
    dirty = events.withColumns(
        {
            "event_time": format_event_time("event_time"),
            "product_id": F.when(unreadable, F.concat(F.lit("x"), product)).otherwise(product),
            "user_session": F.when(surplus, F.concat("user_session", F.lit(",surplus"))).otherwise(F.col("user_session")),
        }
    )
    path = scratch_path(spark, "dirty-csv")
    # An empty quote character leaves the surplus comma bare.
    dirty.write.option("header", True).option("quote", "").csv(path)
    return path


_BAD = "((event_type = 'cart' AND brand IS NULL) OR (event_type = 'purchase' AND category_code IS NULL))"


@query(
    "src_03_lenient_rows",
    sql.retail(
        f"""SELECT event_time, event_type, CASE WHEN NOT {{bad}} THEN product_id END AS product_id, user_session
        FROM r WHERE NOT (event_type = 'cart' AND brand IS NULL)""".format(bad="(event_type = 'purchase' AND category_code IS NULL)")
    ),
)
def _(spark, d):
    return read_events_csv(spark, _dirty_csv(spark, d), on_bad="lenient", columns=["event_time", "event_type", "product_id", "user_session"])


@query("src_03_drop_bad_rows", sql.retail(f"SELECT {sql.EVENT_LIST} FROM r WHERE NOT {_BAD}"))
def _(spark, d):
    return read_events_csv(spark, _dirty_csv(spark, d), on_bad="drop")


@query(
    "src_03_quarantine_bad_rows",
    sql.retail(
        f"""SELECT event_type, COUNT(*) FILTER (WHERE NOT {_BAD}) AS n_good, COUNT(*) FILTER (WHERE {_BAD}) AS n_bad
        FROM r GROUP BY event_type"""
    ),
)
def _(spark, d):
    good, bad = split_quarantine(read_events_csv(spark, _dirty_csv(spark, d), on_bad="quarantine"))
    both = good.select("event_type", F.lit(1).alias("good")).unionByName(bad.select("event_type", F.lit(0).alias("good")))
    return both.groupBy("event_type").agg(F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad"))


@query("src_04_directory_scan", sql.retail("SELECT event_type, COUNT(*) AS cnt FROM r GROUP BY event_type"))
def _(spark, d):
    folder = retail_monthly_csv(spark, d)
    events = read_events_csv(spark, [folder, f"{folder}-absent"], glob="*.csv", missing="skip")
    return event_type_counts(events)


@query("src_05_source_tag", sql.retail("SELECT month, COUNT(*) AS n_rows FROM r GROUP BY month"))
def _(spark, d):
    events = read_events_csv(spark, retail_monthly_csv(spark, d), glob="*.csv")
    return row_counts(with_source_tag(events, MONTH_FOLDER), "month")


@query("src_06_events_parquet", ALL_EVENTS)
def _(spark, d):
    path = scratch_path(spark, "events-parquet")
    write_parquet(retail_events(spark, d), path)
    return read_events_parquet(spark, path, columns=EVENT_COLUMNS)


@query(
    "src_07_head",
    sql.retail(f"SELECT {sql.EVENT_LIST} FROM r ORDER BY event_time, user_session, product_id, price, event_type LIMIT 300"),
)
def _(spark, d):
    return head_rows(retail_events(spark, d), 300, ["event_time", "user_session", "product_id", "price", "event_type"])


@query("src_08_line_count", "SELECT COUNT(*) AS n_data_lines FROM lineitem")
def _(spark, d):
    # Every file has one header line.
    counts = files.count_lines(spark, retail_csv(spark, d), glob="*.csv")
    return counts.agg(F.sum(F.col("n_lines") - 1).alias("n_data_lines"))


TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(
    "src_09_file_inventory",
    " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n_rows, true AS has_bytes FROM {t}" for t in TABLES),
)
def _(spark, d):
    # A table is a file, or a folder of files, by its name.
    found = files.list_files(spark, d, glob="*.parquet").withColumn("name", F.regexp_extract("path", r"/(\w+)\.parquet", 1))
    found = found.groupBy("name").agg(F.sum("bytes").alias("bytes"))
    counts = [spark.read.parquet(f"{d}/{t}.parquet").agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n_rows")) for t in TABLES]
    return found.join(union_all(counts), "name").select("name", "n_rows", (F.col("bytes") > 0).alias("has_bytes"))


@query("src_10_delimiter", "SELECT '|' AS delimiter, 9 AS n_fields, CAST(1 AS DOUBLE) AS share")
def _(spark, d):
    path = scratch_path(spark, "piped-csv")
    write_csv(retail_events(spark, d).withColumn("event_time", format_event_time("event_time")), path, delimiter="|")
    return files.detect_delimiter(spark, path)


@query(
    "src_11_category_csv",
    sql.retail(f"SELECT *, 'all' AS month FROM ({sql.category_totals()})"),
)
def _(spark, d):
    path = scratch_path(spark, "category-csv")
    totals = categories.category_aggregate(retail_events(spark, d, CATEGORY_COLUMNS))
    write_csv(totals.withColumn("month", F.lit("all")).select(CATEGORY_TOTALS.names), path)
    return read_category_csv(spark, path)


@query("snk_01_partitioned_parquet", sql.retail(f"SELECT {sql.EVENT_LIST}, month FROM r"))
def _(spark, d):
    path = scratch_path(spark, "monthly-parquet")
    write_parquet(retail_events(spark, d, [*EVENT_COLUMNS, "month"]), path, partition_by=["month"])
    stored = read_events_parquet(spark, path)
    return stored.withColumn("month", F.left(F.col("month").cast("string"), F.lit(7)))


NARROW_LIST = """event_time, event_type, CAST(product_id AS INTEGER) AS product_id, category_id, category_code, brand,
CAST(price AS FLOAT) AS price, CAST(user_id AS INTEGER) AS user_id, user_session"""


@query("snk_02_convert_csv", sql.retail(f"SELECT {NARROW_LIST} FROM r"))
def _(spark, d):
    path = scratch_path(spark, "converted")
    convert_csv(spark, retail_csv(spark, d), path)
    return read_events_parquet(spark, path)


@query("snk_02_convert_csv_by_month", sql.retail(f"SELECT {NARROW_LIST}, month FROM r"))
def _(spark, d):
    path = scratch_path(spark, "converted")
    convert_csv(spark, retail_monthly_csv(spark, d), path, month_pattern=MONTH_FOLDER, glob="*.csv")
    return read_events_parquet(spark, path).withColumn("month", F.left(F.col("month").cast("string"), F.lit(7)))


@query("snk_03_session_table", sql.click(sql.sessions("c")))
def _(spark, d):
    path = scratch_path(spark, "session-table")
    write_parquet(sessions.session_aggregate(click_events(spark, d)), path)
    return spark.read.parquet(path)


@query("snk_04_result_csv", sql.retail("SELECT brand, COUNT(*) AS freq FROM r GROUP BY brand"))
def _(spark, d):
    path = scratch_path(spark, "result-csv")
    brands = retail_events(spark, d, ["brand"]).groupBy("brand").agg(F.count(F.lit(1)).alias("freq"))
    write_csv(brands, path)
    return spark.read.schema("brand string, freq bigint").option("header", True).csv(path)


@query("snk_05_materialize", sql.retail(sql.sessions("r")))
def _(spark, d):
    path = scratch_path(spark, "materialized")
    events = retail_events(spark, d, SESSION_COLUMNS)
    materialize(spark, path, lambda: sessions.session_aggregate(events))
    return materialize(spark, path, lambda: events.limit(0))


@query(
    "typ_10_describe",
    sql.retail(
        " UNION ALL ".join(
            f"""SELECT {i} AS position, '{f.name}' AS "column", '{f.dataType.simpleString()}' AS type, true AS nullable, COUNT({f.name}) AS n_values FROM r"""
            for i, f in enumerate(EVENTS)
        )
    ),
)
def _(spark, d):
    events = retail_events(spark, d)
    counts = events.agg(*[F.count(c).alias(c) for c in events.columns]).unpivot([], events.columns, "column", "n_values")
    return describe(events).join(counts, "column").select("position", "column", "type", "nullable", "n_values")


def _smallest(column):
    """The type CSV inference gives whole numbers."""
    return f"CASE WHEN MIN({column}) >= -2147483648 AND MAX({column}) <= 2147483647 THEN 'int' ELSE 'bigint' END"


_INFERRED = {
    "event_time": "'timestamp'",
    "event_type": "'string'",
    "product_id": _smallest("product_id"),
    "category_id": _smallest("category_id"),
    "category_code": "'string'",
    "brand": "'string'",
    "price": "'double'",
    "user_id": _smallest("user_id"),
    "user_session": _smallest("CAST(user_session AS BIGINT)"),
}


@query(
    "typ_11_infer_types",
    sql.retail(" UNION ALL ".join(f"""SELECT {i} AS position, '{c}' AS "column", {t} AS type, COUNT({c}) AS n_values FROM r""" for i, (c, t) in enumerate(_INFERRED.items()))),
)
def _(spark, d):
    folder = retail_monthly_csv(spark, d)
    types = infer_types(spark, folder, glob="*.csv")
    rows = spark.read.schema(types).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).unpivot([], rows.columns, "column", "n_values")
    return describe(rows).join(counts, "column").select("position", "column", "type", "n_values")


def _profiled(metric, value):
    return " UNION ALL ".join(
        f"""SELECT month, '{metric}' AS metric, '{c}' AS "column", CAST({value.format(c=c)} AS VARCHAR) AS value FROM r GROUP BY month""" for c in EVENT_COLUMNS
    )


@query(
    "prf_04_file_profile",
    sql.retail(
        _profiled("missing", "COUNT(*) FILTER (WHERE {c} IS NULL)")
        + " UNION ALL "
        + _profiled("distinct", "COUNT(DISTINCT {c})")
        + " UNION ALL SELECT month, 'lines', NULL, CAST(COUNT(*) + 1 AS VARCHAR) FROM r GROUP BY month UNION ALL SELECT DISTINCT month, 'delimiter', NULL, ',' FROM r"
    ),
)
def _(spark, d):
    # One file for each month.
    found = profile.profile(spark, _one_file_a_month(spark, d), glob="*.csv")
    month = F.regexp_extract("file", MONTH_FOLDER, 1).alias("month")
    return found.where(F.col("metric").isin("missing", "distinct", "lines", "delimiter")).select(month, "metric", "column", "value")


def _one_file_a_month(spark, d):
    events = retail_events(spark, d, [*EVENT_COLUMNS, "month"]).withColumn("event_time", format_event_time("event_time"))
    path = scratch_path(spark, "month-files")
    events.repartition("month").write.partitionBy("month").option("header", True).csv(path)
    return path
