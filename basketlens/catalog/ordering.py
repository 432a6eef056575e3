"""Heads, pages, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, sampling
from ..sources.tables import click_events, retail_events
from . import sql
from .registry import query, stored_sessions

_TIEBREAK = ["user_session", "product_id", "price", "event_type"]
_EVENTS = sql.retail(f"SELECT {sql.EVENT_LIST} FROM r WHERE {{where}} ORDER BY event_time {{way}}, user_session, product_id, price, event_type LIMIT 5")


@query("srt_01_last_events", _EVENTS.format(where="month < '1999-01'", way="DESC"))
def _(spark, d):
    source = retail_events(spark, d).where(F.col("event_time") < "1999-01-01")
    return ordering.last_events(source, 5, _TIEBREAK)


@query("srt_02_first_events", _EVENTS.format(where="month >= '1999-01'", way="ASC"))
def _(spark, d):
    source = retail_events(spark, d).where(F.col("event_time") >= "1999-01-01")
    return ordering.first_events(source, 5, _TIEBREAK)


_BY_START = "ORDER BY session_start NULLS LAST, user_session NULLS FIRST"


@query("srt_04_first_page", sql.with_sessions("r", f"SELECT * FROM s {_BY_START} LIMIT 500 OFFSET 100"))
def _(spark, d):
    return ordering.page(stored_sessions(spark, d, "retail"), ordering.by_time(), 100, 500)


@query("srt_04_page", sql.with_sessions("r", f"SELECT * FROM s {_BY_START} LIMIT 1000 OFFSET 2000"))
def _(spark, d):
    sessions = stored_sessions(spark, d, "retail")
    return ordering.page(sessions, ordering.by_time(), 2_000, 1_000)


@query(
    "srt_04_deep_page",
    sql.with_sessions(
        "r",
        f"""SELECT s.* FROM s JOIN (SELECT user_session, row_number() OVER ({_BY_START}) AS n, COUNT(*) OVER () AS total FROM s) p
        USING (user_session) WHERE n > CAST(floor(total * 0.8) AS BIGINT) AND n <= CAST(floor(total * 0.8) AS BIGINT) + 20000""",
    ),
)
def _(spark, d):
    sessions = stored_sessions(spark, d, "retail")
    offset = int(sessions.count() * sampling.TRAIN_FRACTION)
    return ordering.page(sessions, ordering.by_time(), offset, 20_000)


@query(
    "srt_04_numbered_pages",
    sql.with_sessions(
        "r",
        f"""SELECT user_session, session_start, row_number() OVER ({_BY_START}) AS rank,
        CAST((row_number() OVER ({_BY_START}) - 1) // 1000 AS BIGINT) AS page FROM s""",
    ),
)
def _(spark, d):
    sessions = stored_sessions(spark, d, "retail").select("user_session", "session_start")
    order = [F.col("session_start").asc_nulls_last(), F.col("user_session").asc_nulls_first()]
    return ordering.numbered_pages(sessions, order, 1_000)


@query("srt_05_ordered_output", sql.click("SELECT user_session, COUNT(*) AS n FROM c GROUP BY 1 ORDER BY 1"))
def _(spark, d):
    return click_events(spark, d).groupBy("user_session").agg(F.count(F.lit(1)).alias("n")).orderBy("user_session")


_LIMIT = 1 << 60


@query(
    "smp_01_sample_fraction",
    sql.click(f"SELECT {sql.CLICK_LIST} FROM c WHERE {sql.hash60('user_session', 42)} < {int(0.01 * _LIMIT)}"),
)
def _(spark, d):
    return sampling.sample_fraction(click_events(spark, d), 0.01, key="user_session")


# Six standard deviations around a hundredth of the rows.
@query("smp_01_bernoulli_sample", sql.click("SELECT COUNT(*) AS n_rows, true AS is_a_hundredth, true AS are_events FROM c"))
def _(spark, d):
    events = click_events(spark, d)
    sample = sampling.sample_fraction(events, 0.01)
    drawn = sample.join(events, sample.columns, "left_semi").agg(F.count(F.lit(1)).alias("found")).crossJoin(sample.agg(F.count(F.lit(1)).alias("n")))
    whole = events.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(drawn)
    near = F.abs(F.col("n") - 0.01 * F.col("n_rows")) <= 6 * F.sqrt(0.01 * F.col("n_rows")) + 1
    return whole.select("n_rows", near.alias("is_a_hundredth"), (F.col("found") == F.col("n")).alias("are_events"))


@query(
    "smp_02_sample_n",
    sql.with_sessions("r", f"SELECT * FROM s ORDER BY {sql.hash60('user_session', 42)}, user_session LIMIT 10000"),
)
def _(spark, d):
    return sampling.sample_n(stored_sessions(spark, d, "retail"), 10_000, "user_session")


@query(
    "smp_03_random_split",
    sql.with_sessions(
        "c", f"SELECT user_session, {sql.hash60('user_session', 42)} < {int(0.8 * _LIMIT)} AS is_train FROM s"
    ),
)
def _(spark, d):
    train, test = sampling.random_split(stored_sessions(spark, d, "click"), 0.8, "user_session")
    return sampling.union_all(
        [
            train.select("user_session", F.lit(True).alias("is_train")),
            test.select("user_session", F.lit(False).alias("is_train")),
        ]
    )


def _split(view):
    return sql.with_sessions(
        view,
        f"""SELECT user_session, session_start,
        row_number() OVER ({_BY_START}) <= CAST(floor(COUNT(*) OVER () * 0.8) AS BIGINT) AS is_train FROM s""",
    )


def _flagged(sessions):
    early = sampling.time_split_column(sessions)
    return sessions.select("user_session", "session_start", early.alias("is_train"))


@query("smp_04_time_split", _split("c"))
def _(spark, d):
    return _flagged(stored_sessions(spark, d, "click"))


@query("smp_04_time_split_retail", _split("r"))
def _(spark, d):
    return _flagged(stored_sessions(spark, d, "retail"))
