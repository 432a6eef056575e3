"""Pieces of the SQL that queries are checked against."""

from __future__ import annotations

from .. import schema

CLICK = """c AS (
  SELECT ts AS event_time,
         CASE WHEN event_type = 'click' THEN 'cart' ELSE event_type END AS event_type,
         CAST(regexp_extract(props, ':\\s*(-?[0-9]+)', 1) AS BIGINT) AS product_id,
         value AS price, user_id,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS user_session
  FROM events)"""

RETAIL = """r AS (
  SELECT l_shipdate AS event_time,
         CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'R' THEN 'cart' WHEN 'A' THEN 'purchase' END AS event_type,
         l_partkey AS product_id, CAST(p_size AS BIGINT) AS category_id,
         CASE WHEN p_type <> 'PROMO' THEN p_type END AS category_code,
         CASE WHEN p_brand <> 'Brand#13' THEN p_brand END AS brand,
         l_extendedprice AS price, o_custkey AS user_id,
         CAST(l_orderkey AS VARCHAR) AS user_session,
         strftime(l_shipdate, '%Y-%m') AS month
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN orders ON l_orderkey = o_orderkey)"""

EVENT_LIST = "event_time, event_type, product_id, category_id, category_code, brand, price, user_id, user_session"
CLICK_LIST = "event_time, event_type, product_id, price, user_id, user_session"


def total(price: str, where: str = "") -> str:
    """An exact sum of prices, null if there are none; ``where`` is a condition on the rows."""
    rows = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(SUM(CAST({price} AS DECIMAL(30,6))){rows} AS DOUBLE)"


def sessions(view: str, by: str = "", price: str = "price", where: str = "", events: str = "COUNT(*)", duration: bool = True) -> str:
    """SELECT of the session table over a view, a column for each of ``schema.SESSIONS``."""
    of = "event_type = '{}'".format
    counted = "COUNT(*) FILTER (WHERE {})".format
    viewed = f"COUNT({price}) FILTER (WHERE {of('view')})"
    measures = {
        "user_session": "user_session",
        "session_start": "MIN(event_time)",
        "session_end": "MAX(event_time)",
        "session_duration": seconds("MIN(event_time)", "MAX(event_time)"),
        "total_events": events,
        "n_views": counted(of("view")),
        "n_add_to_cart": counted(of("cart")),
        "n_purchases": counted(of("purchase")),
        "total_spent": f"COALESCE({total(price, of('purchase'))}, 0)",
        "avg_price_viewed": f"{total(price, of('view'))} / NULLIF({viewed}, 0)",
        "max_price_viewed": f"CAST(MAX({price}) FILTER (WHERE {of('view')}) AS DOUBLE)",
        "unique_products": "COUNT(DISTINCT product_id)",
    }
    names = [n for n in schema.SESSIONS.names if duration or n != "session_duration"]
    columns = ", ".join(f"{measures[n]} AS {n}" for n in names)
    keys = f"{by}, user_session" if by else "user_session"
    return f"SELECT {by + ', ' if by else ''}{columns} FROM {view} {where} GROUP BY {keys}"


def seconds(start: str, end: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start})) / 1e6"


def with_sessions(view: str, select: str, more: str = "") -> str:
    """``select`` over ``s``, the session table of ``c`` or ``r``; ``more`` adds CTEs."""
    base = CLICK if view == "c" else RETAIL
    extra = f", {more}" if more else ""
    return f"WITH {base}, s AS ({sessions(view)}){extra} {select}"


def click(select: str, more: str = "") -> str:
    return f"WITH {CLICK}{', ' + more if more else ''} {select}"


def retail(select: str, more: str = "") -> str:
    return f"WITH {RETAIL}{', ' + more if more else ''} {select}"


def category_totals(keys: str = "category_id, event_type", source: str = "r", where: str = "") -> str:
    sales = total("COALESCE(price, 0)")
    return f"""SELECT {keys}, {sales} AS total_sales, {sales} / COUNT(*) AS avg_price,
  COUNT(event_type) AS num_events, COUNT(DISTINCT product_id) AS unique_products
FROM {source} {where} GROUP BY {keys}"""


def rounded(expression: str, digits: int) -> str:
    """ROUND without negative zero."""
    return f"CASE WHEN ROUND({expression}, {digits}) = 0 THEN 0.0 ELSE ROUND({expression}, {digits}) END"


def hash60(key: str, seed: int) -> str:
    """The 60-bit key hash of the samples and splits."""
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR))), 1, 15) AS BIGINT)"


def held_out(key: str) -> str:
    """The condition of the spend model's held-out sessions."""
    return f"{hash60(key, 43)} >= {int(0.8 * (1 << 60))}"


def test_sessions(view: str) -> str:
    """CTEs ``s`` and ``test``: the latest fifth of the sessions of a view, with their label."""
    base = CLICK if view == "c" else RETAIL
    return f"""WITH {base}, s AS ({sessions(view)}),
placed AS (SELECT *, row_number() OVER (ORDER BY session_start NULLS LAST, user_session NULLS FIRST) AS place, COUNT(*) OVER () AS n_all FROM s),
train AS (SELECT *, CASE WHEN n_purchases > 0 THEN 1 ELSE 0 END AS label FROM placed WHERE place <= CAST(floor(n_all * 0.8) AS BIGINT)),
test AS (SELECT *, CASE WHEN n_purchases > 0 THEN 1 ELSE 0 END AS label FROM placed WHERE place > CAST(floor(n_all * 0.8) AS BIGINT))"""
