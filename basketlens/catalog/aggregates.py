"""Counts, summaries, category and session aggregates, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import month_of
from ..operators import categories, sessions, summaries
from ..operators.sampling import union_all, union_distinct
from ..runtime import scratch_path, stage
from ..schema import EventLabels
from ..sinks import write_csv
from ..sources.events import read_category_csv
from ..sources.tables import click_events, retail_events
from . import sql
from .registry import query

SESSION_COLUMNS = ["event_time", "event_type", "product_id", "price", "user_session"]
CATEGORY_COLUMNS = ["category_id", "event_type", "product_id", "price"]


def _category_totals(spark, sf_dir):
    events = retail_events(spark, sf_dir, [*CATEGORY_COLUMNS, "month"])
    return categories.with_month_str(categories.monthly_category_aggregate(events))


@query("agg_01_row_count", sql.click("SELECT COUNT(*) AS n_rows FROM c"))
def _(spark, d):
    return summaries.row_counts(click_events(spark, d))


@query("agg_01_row_count_per_source", sql.retail("SELECT month, COUNT(*) AS n_rows FROM r GROUP BY month"))
def _(spark, d):
    return summaries.row_counts(retail_events(spark, d, ["month"]), "month")


@query("agg_02_event_types", sql.click("SELECT event_type, COUNT(*) AS cnt FROM c GROUP BY event_type"))
def _(spark, d):
    return summaries.event_type_counts(click_events(spark, d))


@query(
    "agg_03_price_summary",
    sql.retail(
        """SELECT MIN(price) AS min_price, CAST(SUM(CAST(price AS DECIMAL(30,4))) AS DOUBLE) / COUNT(price) AS avg_price,
        MAX(price) AS max_price, quantile_cont(price, 0.5) AS median_price FROM r"""
    ),
)
def _(spark, d):
    return summaries.price_summary(retail_events(spark, d, ["price"]), exact=True)


# Sketches by month, stored and merged: all but the median exact, its rank within 0.5 % of the middle; twice that is allowed.
@query(
    "agg_03_price_summary_merged",
    sql.retail(
        """SELECT MIN(price) AS min_price, CAST(SUM(CAST(price AS DECIMAL(30,4))) AS DOUBLE) / COUNT(price) AS avg_price,
        MAX(price) AS max_price, true AS is_median FROM r"""
    ),
)
def _(spark, d):
    events = retail_events(spark, d, ["price", "month"])
    found = summaries.merge_price_sketches(stage(summaries.price_sketches(events, ["month"]), "price-sketches"))
    middle = found.first()["median_price"]
    below, upto, n = events.agg(F.count_if(F.col("price") < middle), F.count_if(F.col("price") <= middle), F.count("price")).first()
    return found.drop("median_price").withColumn("is_median", F.lit(below <= 0.51 * n and upto >= 0.49 * n))


# The sketch promises a rank within 1 / 10,000 of the middle; a percent is far outside.
@query(
    "agg_03_price_summary_approx",
    sql.retail(
        """SELECT MIN(price) AS min_price, MAX(price) AS max_price, CAST(0.49 AS DOUBLE) AS at_least, CAST(0.51 AS DOUBLE) AS at_most, true AS is_median
        FROM r"""
    ),
)
def _(spark, d):
    events = retail_events(spark, d, ["price"])
    found = summaries.price_summary(events)
    ranks = events.join(F.broadcast(found.select("median_price")), F.lit(True)).agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.lit(0.49).alias("at_least"),
        F.lit(0.51).alias("at_most"),
        (F.count_if(F.col("price") <= F.col("median_price")) / F.count("price")).alias("rank"),
        (F.count_if(F.col("price") < F.col("median_price")) / F.count("price")).alias("rank_below"),
    )
    within = (F.col("rank") >= F.col("at_least")) & (F.col("rank_below") <= F.col("at_most"))
    return ranks.withColumn("is_median", within).drop("rank", "rank_below")


def _top(column):
    return sql.retail(
        f"SELECT {column}, COUNT(*) AS freq FROM r GROUP BY {column} ORDER BY freq DESC, {column} NULLS LAST LIMIT 20"
    )


@query("agg_04_top_category_codes", _top("category_code"))
def _(spark, d):
    return summaries.top_values(retail_events(spark, d, ["category_code"]), "category_code")


@query("agg_05_top_brands", _top("brand"))
def _(spark, d):
    return summaries.top_values(retail_events(spark, d, ["brand"]), "brand")


@query("agg_06_events_per_day", sql.click("SELECT date_trunc('day', event_time)::TIMESTAMP AS day, COUNT(*) AS events FROM c GROUP BY 1"))
def _(spark, d):
    return summaries.events_per_day(click_events(spark, d))


@query("agg_07_category_aggregate", sql.retail(sql.category_totals()))
def _(spark, d):
    return categories.category_aggregate(retail_events(spark, d, CATEGORY_COLUMNS))


@query("agg_08_monthly_category_aggregate", sql.retail(sql.category_totals("category_id, event_type, month")))
def _(spark, d):
    return categories.monthly_category_aggregate(retail_events(spark, d, [*CATEGORY_COLUMNS, "month"]))


@query("agg_09_merge_partials_exact", sql.retail(sql.category_totals()))
def _(spark, d):
    events = retail_events(spark, d, [*CATEGORY_COLUMNS, "month"])
    return categories.merge_category_partials(categories.category_partials(events, ["month"]), ["month"])


@query(
    "agg_09_merge_partials_unweighted",
    sql.retail(
        """SELECT category_id, event_type,
        CAST(SUM(CAST(total_sales AS DECIMAL(30,6))) AS DOUBLE) AS total_sales, SUM(CAST(round_even(avg_price * 1e6, 0) AS BIGINT)) / 1e6 / COUNT(*) AS avg_price,
        CAST(SUM(num_events) AS BIGINT) AS num_events, CAST(SUM(unique_products) AS BIGINT) AS unique_products
        FROM t GROUP BY category_id, event_type""",
        f"t AS ({sql.category_totals('category_id, event_type, month')})",
    ),
)
def _(spark, d):
    events = retail_events(spark, d, [*CATEGORY_COLUMNS, "month"])
    partials = categories.category_partials(events, ["month"])
    return categories.merge_category_partials(partials, ["month"], merge="unweighted")


@query("agg_10_session_aggregate", sql.click(sql.sessions("c")))
def _(spark, d):
    return sessions.session_aggregate(click_events(spark, d))


@query("agg_10_session_aggregate_retail", sql.retail(sql.sessions("r")))
def _(spark, d):
    return sessions.session_aggregate(retail_events(spark, d, SESSION_COLUMNS))


@query("agg_10_session_aggregate_per_source", sql.retail(sql.sessions("r", by="month")))
def _(spark, d):
    return sessions.session_aggregate(retail_events(spark, d, [*SESSION_COLUMNS, "month"]), by=["month"])


@query(
    "agg_10_session_aggregate_labels",
    sql.click(sql.sessions("c").replace("'cart'", "'signup'")),
)
def _(spark, d):
    return sessions.session_aggregate(click_events(spark, d), EventLabels(cart="signup"))


@query(
    "agg_11_session_aggregate_compact",
    sql.retail(
        sql.sessions("r", price="CAST(CAST(price AS FLOAT) AS DOUBLE)", where="WHERE user_session IS NOT NULL", events="COUNT(event_type)", duration=False)
    ),
)
def _(spark, d):
    return sessions.session_aggregate_compact(retail_events(spark, d, SESSION_COLUMNS))


@query("agg_12_merge_session_fragments", sql.retail(sql.sessions("r")))
def _(spark, d):
    events = retail_events(spark, d, [*SESSION_COLUMNS, "month"])
    return sessions.merge_session_fragments(sessions.session_fragments(events, ["month"]))


_TOTALS = f"t AS ({sql.category_totals('category_id, event_type, month')})"
_SALES = sql.total("total_sales")

# The columns that the given tables have; the operators find theirs in the rows.
_MONTHS = [f"{year}-{month:02}" for year in range(1995, 2002) for month in range(1, 13)][:83]
EVENT_VOLUMES = (
    "SELECT month AS month_str, "
    + ", ".join(f"CAST(COALESCE(SUM(num_events) FILTER (WHERE event_type = '{e}'), 0) AS BIGINT) AS {e}" for e in ("cart", "purchase", "view"))
    + " FROM t WHERE event_type IS NOT NULL GROUP BY month"
)


@query(
    "agg_13_top_categories",
    sql.retail(f"SELECT category_id, {_SALES} AS total_sales FROM t GROUP BY 1 ORDER BY total_sales DESC, category_id LIMIT 15", _TOTALS),
)
def _(spark, d):
    return categories.top_categories(_category_totals(spark, d))


@query(
    "agg_14_events_pivot",
    sql.retail(
        EVENT_VOLUMES,
        _TOTALS,
    ),
)
def _(spark, d):
    return categories.events_pivot(_category_totals(spark, d))


@query(
    "agg_15_sales_pivot",
    sql.retail(
        "SELECT category_id, " + ", ".join(f"COALESCE({sql.total('total_sales', f"month = '{m}'")}, 0) AS \"{m}\"" for m in _MONTHS) + " FROM t GROUP BY category_id",
        _TOTALS,
    ),
)
def _(spark, d):
    return categories.sales_pivot(_category_totals(spark, d))


@query(
    "agg_15_sales_cells",
    sql.retail(
        f"""SELECT category_id, COUNT(*) AS n_cells, MAX(s) AS largest, MAX(s) FILTER (WHERE month = '1996-02') AS feb_1996
        FROM (SELECT category_id, month, {_SALES} AS s FROM t GROUP BY 1, 2) GROUP BY category_id""",
        _TOTALS,
    ),
)
def _(spark, d):
    cells = categories.sales_cells(_category_totals(spark, d))
    return cells.select(
        "category_id",
        F.size("cells").cast("bigint").alias("n_cells"),
        F.array_max(F.map_values("cells")).alias("largest"),
        F.try_element_at("cells", F.lit("1996-02")).alias("feb_1996"),
    )


@query(
    "agg_15_sales_long",
    sql.retail(f"SELECT category_id, month AS month_str, {_SALES} AS total_sales FROM t GROUP BY 1, 2", _TOTALS),
)
def _(spark, d):
    return categories.sales_long(_category_totals(spark, d))


@query("agg_16_sales_by_month", sql.retail(f"SELECT month AS month_str, {_SALES} AS total_sales FROM t GROUP BY 1", _TOTALS))
def _(spark, d):
    return categories.sales_by_month(_category_totals(spark, d))


@query(
    "set_01_union_all",
    sql.retail(
        f"""SELECT * FROM ({sql.sessions('r', where="WHERE month < '1999-01'")}) UNION ALL
        SELECT * FROM ({sql.sessions('r', where="WHERE month >= '1999-01'")})"""
    ),
)
def _(spark, d):
    events = retail_events(spark, d, [*SESSION_COLUMNS, "month"])
    early, late = events.where("month < '1999-01'"), events.where("month >= '1999-01'")
    return union_all([sessions.session_aggregate(early), sessions.session_aggregate(late)])


@query(
    "set_02_union_distinct",
    "WITH " + sql.CLICK + ", " + sql.RETAIL + " SELECT event_type, product_id FROM c UNION SELECT event_type, product_id FROM r",
)
def _(spark, d):
    columns = ["event_type", "product_id"]
    return union_distinct([click_events(spark, d).select(columns), retail_events(spark, d, columns)])


@query(
    "srt_03_spanning_sessions",
    sql.retail(
        """SELECT user_session, COUNT(DISTINCT month) AS n_periods, COUNT(*) AS n_events
        FROM r GROUP BY user_session HAVING COUNT(DISTINCT month) > 1"""
    ),
)
def _(spark, d):
    events = retail_events(spark, d, ["event_time", "user_session"])
    return sessions.spanning_sessions(events, month_of("event_time"))


@query("snk_04_category_csv", sql.retail(sql.category_totals("category_id, event_type, month")))
def _(spark, d):
    path = scratch_path(spark, "category-csv")
    write_csv(categories.monthly_category_aggregate(retail_events(spark, d, [*CATEGORY_COLUMNS, "month"])), path)
    return read_category_csv(spark, path)
