"""Column expressions. All are built-in Spark expressions; none depends on the time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text form of event times, other forms that are read, and the cap on session minutes.
EVENT_TIME_PATTERN = "____-__-__ __:__:__ UTC"
EVENT_TIME_SUFFIX = " UTC"
EVENT_TIME_FORMS = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?) ?(?:UTC|Z|([+-])(\d{2}):?(\d{2}))?$"
MAX_SESSION_MINUTES = 24 * 60

# Digits after the point that sums of prices keep.
PRICE_SCALE = 6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_event_time(text: Column | str) -> Column:
    """``2019-10-01 00:00:00 UTC`` to a timestamp; anything else is null.

    Also read: a ``T`` between date and time, fractions of a second, ``Z``, an offset such as
    ``+02:00`` (taken off), and no zone at all (UTC). A date alone is not a time.
    """
    text = _col(text)
    part = lambda k: F.regexp_extract(text, EVENT_TIME_FORMS, k)
    wall = F.concat(part(1), F.lit(" "), part(2)).try_cast("timestamp_ntz")
    minutes = (F.coalesce(part(4).try_cast("int"), F.lit(0)) * 60 + F.coalesce(part(5).try_cast("int"), F.lit(0)))
    east = F.make_dt_interval(mins=F.when(part(3) == "-", -minutes).otherwise(minutes))
    other = F.when(text.rlike(EVENT_TIME_FORMS), wall - east)
    return F.when(text.like(EVENT_TIME_PATTERN), F.left(text, F.lit(19)).try_cast("timestamp_ntz")).otherwise(other)


def format_event_time(ts: Column | str) -> Column:
    """Inverse of :func:`parse_event_time`, to whole seconds."""
    return F.concat(F.left(_col(ts).cast("string"), F.lit(19)), F.lit(EVENT_TIME_SUFFIX))


def month_of(ts: Column | str) -> Column:
    """``yyyy-MM`` of a timestamp."""
    return F.left(_col(ts).cast("date").cast("string"), F.lit(7))


def day_of(ts: Column | str) -> Column:
    """The timestamp truncated to its day."""
    return _col(ts).cast("date").cast("timestamp_ntz")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds with fractions; null if either side is."""
    return (_col(end) - _col(start)).cast("interval second").cast("decimal(20,6)").cast("double")


def micros_of(ts: Column | str) -> Column:
    """Microseconds since 1970 as a long, so times can be bucketed arithmetically."""
    since = _col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long")


def parse_month_tag(tag: Column | str) -> Column:
    """``2019-Oct`` or ``2019-10`` to ``2019-10``; anything else is null."""
    tag = _col(tag)
    day = F.coalesce(F.try_to_date(tag, "yyyy-MMM"), F.try_to_date(tag, "yyyy-MM"))
    return F.left(day.cast("string"), F.lit(7))


def known(number: Column | str) -> Column:
    """A number as a double; NaN and infinities count as missing."""
    value = _col(number).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def amount(price: Column | str, scale: int = PRICE_SCALE) -> Column:
    """A price as a decimal with ``scale`` digits after the point.

    Sums of decimals are exact and independent of the order rows arrive in. NaN, infinities
    and prices too large for the type count as missing.
    """
    return known(price).try_cast(f"decimal({24 + scale},{scale})")


def money(total: Column) -> Column:
    """A sum of amounts as a double, correctly rounded."""
    return total.cast("double")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator where a zero denominator counts as one."""
    d = _col(denominator)
    return _col(numerator) / F.when(d == 0, F.lit(1)).otherwise(d)


def null_to_zero(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def value_if(condition: Column, value: Column | str, otherwise=None) -> Column:
    """``CASE WHEN condition THEN value ELSE otherwise END``."""
    return F.when(condition, _col(value)).otherwise(F.lit(otherwise))


def minutes_capped(seconds: Column | str, cap: float = MAX_SESSION_MINUTES) -> Column:
    """Seconds as minutes, at most ``cap``; null stays null."""
    minutes = _col(seconds) / 60.0
    return F.when(minutes > cap, F.lit(float(cap))).otherwise(minutes)


def flag(condition: Column, dtype: str = "int") -> Column:
    """1 where the condition holds, else 0 (also where it is null)."""
    return F.coalesce(condition, F.lit(False)).cast(dtype)


def stringify(c: Column | str, null_literal: str | None = None) -> Column:
    """Text form; nulls stay null unless a literal for them is asked for."""
    text = _col(c).cast("string")
    return text if null_literal is None else F.coalesce(text, F.lit(null_literal))


def log_target(c: Column | str) -> Column:
    return F.log1p(_col(c))


def unlog_target(c: Column | str) -> Column:
    return F.expm1(_col(c))


# Hex digits of a key's hash that are used, and how many values they take.
HASH_DIGITS = 15
HASH_RANGE = 16**HASH_DIGITS


def hash_digits(key: Column | str, seed: int) -> Column:
    """Fixed-width hex digits drawn from the key and a seed.

    A function of the key alone, so a sample or split does not change when the data is
    partitioned differently or a task is run again. Digits sort like the number they are.
    """
    text = F.concat_ws(":", F.lit(str(seed)), _col(key).cast("string"))
    return F.left(F.md5(text), F.lit(HASH_DIGITS))


def hash_number(digits: Column) -> Column:
    """Hash digits as a long."""
    return F.conv(digits, 16, 10).cast("long")


def hash_below(key: Column | str, seed: int, fraction: float) -> Column:
    """True for about ``fraction`` of the keys."""
    limit = int(fraction * HASH_RANGE)
    if limit >= HASH_RANGE:
        return F.lit(True)
    return hash_digits(key, seed) < F.lit(f"{limit:0{HASH_DIGITS}x}")
