"""Typing, dictionaries and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import format_event_time, parse_event_time
from ..operators import dictionary, profile, typing
from ..runtime import scratch_path
from ..schema import DICTIONARY_COLUMNS, EVENT_COLUMNS
from ..sources import files
from ..sources.events import read_events_csv
from ..sources.tables import click_events, retail_events
from . import sql
from .registry import query, retail_monthly_csv

_IDS = "user_session, product_id"


@query(
    "typ_01_parse_event_time",
    sql.retail(f"SELECT {_IDS}, CASE WHEN brand IS NOT NULL THEN event_time END AS event_time FROM r"),
)
def _(spark, d):
    events = retail_events(spark, d, ["event_time", "brand", "product_id", "user_session"])
    # Events without a brand get a date in another form.
    text = F.when(F.col("brand").isNull(), F.col("event_time").cast("date").cast("string")).otherwise(format_event_time("event_time"))
    return events.select("user_session", "product_id", parse_event_time(text).alias("event_time"))


_NARROW = {"session_no": "smallint", "product_id": "tinyint"}


def _numbered(spark, d):
    events = retail_events(spark, d, ["user_session", "product_id", "price"])
    return events.withColumn("session_no", F.col("user_session").cast("bigint"))


@query(
    "typ_02_narrow",
    sql.retail(
        """SELECT user_session, price, CAST(TRY_CAST(CAST(user_session AS BIGINT) AS SMALLINT) AS DOUBLE) AS session_no,
        CAST(TRY_CAST(product_id AS TINYINT) AS DOUBLE) AS product_id FROM r"""
    ),
)
def _(spark, d):
    # Shown as doubles: a nullable integer has no plain form outside Spark.
    narrowed = typing.narrow(_numbered(spark, d), _NARROW)
    return narrowed.withColumns({c: F.col(c).cast("double") for c in _NARROW})


@query(
    "typ_02_narrowing_losses",
    sql.retail(
        """SELECT 'session_no' AS "column", COUNT(*) FILTER (WHERE CAST(user_session AS BIGINT) > 32767) AS n_lost FROM r
        UNION ALL SELECT 'product_id', COUNT(*) FILTER (WHERE product_id > 127) FROM r"""
    ),
)
def _(spark, d):
    return typing.narrowing_losses(_numbered(spark, d), _NARROW)


@query("typ_03_price_float", sql.retail(f"SELECT {_IDS}, CAST(price AS FLOAT) AS price FROM r"))
def _(spark, d):
    return typing.narrow(retail_events(spark, d, ["user_session", "product_id", "price"]), {"price": "float"})


@query(
    "typ_04_stringify",
    sql.retail(
        """SELECT event_type, CAST(product_id AS VARCHAR) AS product_id, COALESCE(category_code, 'nan') AS category_code,
        COALESCE(brand, 'nan') AS brand, user_session FROM r"""
    ),
)
def _(spark, d):
    columns = ["event_type", "product_id", "category_code", "brand", "user_session"]
    return typing.stringify_columns(retail_events(spark, d, columns), columns, "nan")


def _per_column(columns, select):
    return " UNION ALL ".join(select.format(c=c) for c in columns)


_TEXT = ["event_type", "category_code", "brand", "user_session"]


@query(
    "typ_05_cardinality",
    sql.retail(
        _per_column(
            _TEXT,
            """SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) AS n_rows,
            COUNT(DISTINCT {c}) / COUNT(*) AS share, COUNT(DISTINCT {c}) / COUNT(*) < 0.5 AS use_dictionary FROM r""",
        )
    ),
)
def _(spark, d):
    return profile.cardinality_profile(retail_events(spark, d, _TEXT))


def _fits(column):
    arms = " ".join(
        f"WHEN MIN({column}) >= {-(1 << (b - 1))} AND MAX({column}) <= {(1 << (b - 1)) - 1} THEN '{t}'"
        for t, b in (("tinyint", 8), ("smallint", 16), ("int", 32))
    )
    return f"SELECT '{column}' AS \"column\", 'bigint' AS type, CASE {arms} ELSE 'bigint' END AS suggested FROM {{view}}"


def _floats(column):
    error = f"MAX(ABS({column} - CAST(CAST({column} AS FLOAT) AS DOUBLE)))"
    return f"SELECT '{column}', 'double', CASE WHEN {error} <= 0.0005 THEN 'float' ELSE 'double' END FROM {{view}}"


@query(
    "typ_06_suggest_types",
    sql.retail(
        " UNION ALL ".join([_fits("product_id"), _fits("category_id"), _fits("user_id"), _floats("price")]).format(view="r")
    ),
)
def _(spark, d):
    return typing.suggest_types(retail_events(spark, d))


@query(
    "typ_06_suggest_types_click",
    sql.click(" UNION ALL ".join([_fits("product_id"), _fits("user_id"), _floats("price")]).format(view="c")),
)
def _(spark, d):
    return typing.suggest_types(click_events(spark, d))


def _as_types(column, integral):
    """A row per type the column can get: whether it did, and an exact digest of its values."""
    return f"""SELECT '{column}' AS "column", (SELECT suggested FROM n WHERE "column" = '{column}') AS type,
    CAST(SUM({'CAST(' + column + ' AS DECIMAL(38,0))' if integral else f'CAST(CAST({column} AS FLOAT) AS DECIMAL(30,6))'}) AS DOUBLE) AS total FROM c"""


@query(
    "typ_06_apply_types",
    sql.click(
        " UNION ALL ".join([_as_types("product_id", True), _as_types("user_id", True), _as_types("price", False)]),
        "n AS (" + " UNION ALL ".join([_fits("product_id"), _fits("user_id"), _floats("price")]).format(view="c") + ")",
    ),
)
def _(spark, d):
    events = click_events(spark, d)
    narrowed = typing.apply_types(events, typing.suggest_types(events))
    types = dict(narrowed.dtypes)
    sums = {c: F.sum(F.col(c).cast("decimal(28,0)")) for c in ("product_id", "user_id")} | {"price": F.sum(F.col("price").cast("double").cast("decimal(28,6)"))}
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), v.cast("double").alias("total")) for c, v in sums.items()]
    return narrowed.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


_DICTIONARY = """v AS (
  SELECT DISTINCT 'event_type' AS "column", event_type AS value FROM r UNION SELECT 'event_type', event_type FROM c
  UNION SELECT 'category_code', category_code FROM r UNION SELECT 'brand', brand FROM r),
dict AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM v WHERE value IS NOT NULL)"""
_BOTH = f"WITH {sql.CLICK}, {sql.RETAIL}, {_DICTIONARY} "


def _sources(spark, d):
    clicks = click_events(spark, d).withColumns(
        {"category_code": F.lit(None).cast("string"), "brand": F.lit(None).cast("string")}
    )
    return [retail_events(spark, d), clicks]


@query("typ_07_dictionary", _BOTH + "SELECT * FROM dict")
def _(spark, d):
    return dictionary.build_dictionary(_sources(spark, d))


_CODE = "(SELECT CAST(code AS DOUBLE) FROM dict WHERE \"column\" = '{c}' AND value = r.{c}) AS {c}_code"


@query(
    "typ_08_encode",
    _BOTH
    + "SELECT event_time, "
    + ", ".join(_CODE.format(c=c) for c in ("event_type", "category_code", "brand"))
    + ", product_id, category_id, price, user_id, user_session FROM r",
)
def _(spark, d):
    sources = _sources(spark, d)
    encoded = dictionary.encode(sources[0], dictionary.build_dictionary(sources))
    return encoded.withColumns({f"{c}_code": F.col(f"{c}_code").cast("double") for c in DICTIONARY_COLUMNS})


@query("typ_09_decode", sql.retail(f"SELECT {sql.EVENT_LIST} FROM r"))
def _(spark, d):
    sources = _sources(spark, d)
    codes = dictionary.build_dictionary(sources)
    # A limit of 0 takes the shuffled join in both directions.
    encoded = dictionary.encode(sources[0], codes, broadcast_bytes=0)
    return dictionary.decode(encoded, codes, broadcast_bytes=0)


@query(
    "prf_01_missing",
    sql.retail(_per_column(EVENT_COLUMNS, "SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM r")),
)
def _(spark, d):
    return profile.missing_counts(retail_events(spark, d))


@query(
    "prf_02_distinct",
    sql.retail(_per_column(EVENT_COLUMNS, "SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM r")),
)
def _(spark, d):
    return profile.distinct_counts(retail_events(spark, d))


# The sketch's standard error is 5 %; four of them, and one for very small columns.
@query(
    "prf_02_distinct_approx",
    sql.retail(_per_column(EVENT_COLUMNS, "SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_exact, true AS is_near FROM r")),
)
def _(spark, d):
    events = retail_events(spark, d)
    exact = profile.distinct_counts(events).withColumnRenamed("n_distinct", "n_exact")
    both = exact.join(profile.distinct_counts(events, approx=True), "column")
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(1.0), 0.2 * F.col("n_exact"))
    return both.select("column", "n_exact", near.alias("is_near"))


# Sketches of 2^14 registers have a standard error of 0.8 %: five of them.
@query(
    "prf_02_stored_profile",
    sql.retail(
        _per_column(
            EVENT_COLUMNS,
            "SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing, true AS is_near, true AS reads_new_files_only FROM r",
        )
    ),
)
def _(spark, d):
    store, folder = scratch_path(spark, "profile"), retail_monthly_csv(spark, d)
    rows = lambda paths: read_events_csv(spark, paths)
    states = files.file_states(spark, folder, "*.csv")
    first = states.where(F.col("path").rlike("month=.*[13579]/"))
    counts = [profile.add_to_profile(rows, which, store) for which in (first, states, states)]
    new_only = counts[0] + counts[1] == states.count() and counts[2] == 0
    exact = profile.distinct_counts(retail_events(spark, d)).withColumnRenamed("n_distinct", "n_exact")
    both = profile.stored_profile(spark, store).join(exact, "column")
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(1.0), 0.04 * F.col("n_exact"))
    return both.select("column", "n_rows", "n_missing", near.alias("is_near"), F.lit(new_only).alias("reads_new_files_only"))


def _bytes(c):
    if c in ("event_type", "category_code", "brand", "user_session"):
        return f"COALESCE(SUM(octet_length(encode({c}))), 0)"
    return f"COUNT({c}) * 8"


@query(
    "prf_03_footprint",
    sql.retail(
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({_bytes(c)} AS BIGINT) AS bytes FROM r" for c in EVENT_COLUMNS)
        + " UNION ALL SELECT '(total)', CAST("
        + " + ".join(_bytes(c) for c in EVENT_COLUMNS)
        + " AS BIGINT) FROM r"
    ),
)
def _(spark, d):
    return profile.column_footprint(retail_events(spark, d))
