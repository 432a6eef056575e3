"""Heads, pages, ranks and order statistics without gathering rows in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import hash_digits, hash_number, known, micros_of
from ..runtime import stage

# Up to this many rows an ordered limit is cheap: each task keeps that many and one
# task merges them. Longer prefixes are found by their boundary or rank instead.
TOP_ROWS = 1_000

# Rows one histogram pass brings to the driver, at most.
HISTOGRAM_BUCKETS = 4_096

# monotonically_increasing_id keeps the row's position in its partition below this bit.
_POSITION_BITS = 33

Order = Sequence[Column | str]


def head_rows(df: DataFrame, n: int, order: Order | None = None) -> DataFrame:
    """The first ``n`` rows: in the order ``order``, or any ``n`` rows without one.

    However large ``n``, no task gathers more than ``TOP_ROWS`` of them.
    """
    if n <= TOP_ROWS:
        return df.orderBy(*order).limit(n) if order else df.limit(n)
    if order:
        return global_rank(df, order).where(F.col("rank") <= n).drop("rank").orderBy(*order)
    return _numbered(df, "_number").where(F.col("_number") <= n).drop("_number")


def last_events(events: DataFrame, n: int, tiebreak: Sequence[str]) -> DataFrame:
    """The latest ``n`` events of a source, latest first."""
    return head_rows(events, n, [F.col("event_time").desc_nulls_last(), *tiebreak])


def first_events(events: DataFrame, n: int, tiebreak: Sequence[str]) -> DataFrame:
    """The earliest ``n`` events of a source, earliest first."""
    return head_rows(events, n, [F.col("event_time").asc_nulls_last(), *tiebreak])


def global_rank(df: DataFrame, order: Order, name: str = "rank") -> DataFrame:
    """Add each row's 1-based position in the total order ``order``.

    One range shuffle sorts the rows; a row's rank is its position in its partition plus
    the sizes of the partitions before it. Range bounds come from a sample that may
    differ between runs, so the sorted rows are written once and ranked from the copy.
    ``order`` must tell all rows apart, otherwise a repeated key cannot be split over
    partitions.
    """
    return _numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Number the rows from 1, partition by partition, from a stored copy."""
    laid_out = stage(df.withColumn("_position", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_position", _POSITION_BITS)
    # One row per partition.
    sizes = laid_out.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    offset = F.col("_position").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        laid_out.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + offset + 1)
        .drop("_part", "_position", "_start")
    )


@dataclass(frozen=True)
class Position:
    """Where the k-th value lies: the value, how many are smaller, how many equal it."""

    value: float | int
    below: int
    equal: int


class Places:
    """Finds values by their place in the order of a numeric column; nulls have none.

    Each pass counts equal-width buckets between known bounds and keeps the bucket that holds
    the place, so there is no sort and at most ``buckets`` counts reach the driver. The first
    pass serves every place asked for; a few more are enough for times, prices or hashes.
    """

    def __init__(self, values: DataFrame, buckets: int = HISTOGRAM_BUCKETS):
        """``values`` has ``v`` and ``n``, how many rows have that value."""
        self.values = values.where(F.col("v").isNotNull())
        self.buckets = buckets
        self.low, self.high, n = self.values.agg(F.min("v"), F.max("v"), F.sum("n")).first()
        self.n = n or 0
        self._first: list | None = None

    def _counts(self, low, high) -> list:
        v = F.col("v")
        if isinstance(low, int):
            width = (high - low) // self.buckets + 1
            bucket = F.floor((v - F.lit(low)) / F.lit(width))
        else:
            width = high / self.buckets - low / self.buckets
            if width > 0:
                bucket = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(self.buckets - 1))
            else:
                bucket = (v > F.lit(low)).cast("int")
        grouped = self.values.where(v.between(low, high)).groupBy(bucket.alias("b"))
        return grouped.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()

    def at(self, k: int) -> Position:
        """The k-th smallest, from 1."""
        if not 1 <= k <= self.n:
            raise ValueError(f"position {k} is outside 1..{self.n}")
        low, high, below, equal = self.low, self.high, 0, self.n
        if isinstance(low, float) and (math.isinf(low) or math.isinf(high)):
            raise ValueError("infinite values have no buckets")
        counts = None
        while low < high:
            if counts is None:
                self._first = counts = self._first or self._counts(low, high)
            else:
                counts = self._counts(low, high)
            for row in counts:
                if below + row.n >= k:
                    low, high, equal = row.low, row.high, row.n
                    break
                below += row.n
        return Position(low, below, equal)


def _ones(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.alias("v"), F.lit(1).cast("long").alias("n"))


def kth_smallest(df: DataFrame, value: Column | str, k: int, buckets: int = HISTOGRAM_BUCKETS) -> Position:
    """The k-th smallest (from 1) of a numeric column, exactly; nulls do not count."""
    return Places(_ones(df, F.col(value) if isinstance(value, str) else value), buckets).at(k)


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """``v, n``: each distinct value and its rows, null included, as a stored table."""
    return stage(df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")


def percentile_of_counts(counts: DataFrame, p: float) -> float | None:
    """The interpolated percentile of counted values; null for no values."""
    places = Places(counts)
    if places.n == 0:
        return None
    at = p * (places.n - 1)
    k = int(at) + 1
    left = places.at(k)
    if at == int(at) or left.below + left.equal > k:
        return left.value
    return left.value + (places.at(k + 1).value - left.value) * (at - int(at))


def exact_percentile(df: DataFrame, value: str, p: float) -> float | None:
    """The interpolated percentile of a numeric column; null for no values."""
    return percentile_of_counts(value_counts(df, known(value)), p)


@dataclass(frozen=True)
class TotalOrder:
    """An order of rows as three columns.

    ``coarse`` is a whole number of few values, ``fine`` a number that orders rows of equal
    ``coarse`` (nulls last in both), and ``tie`` tells rows of equal ``fine`` apart (nulls
    first). With very many coarse values places take another pass or two.
    """

    coarse: Column
    fine: Column
    tie: Column

    def columns(self) -> list[Column]:
        return [self.coarse.asc_nulls_last(), self.fine.asc_nulls_last(), self.tie.asc_nulls_first()]


def by_time(time: str = "session_start", tie: str = "user_session") -> TotalOrder:
    """By a timestamp, then by ``tie``; the day is the coarse part."""
    return TotalOrder(F.unix_date(F.col(time).cast("date")), micros_of(time), F.col(tie))


def by_hash(key: str, seed: int) -> TotalOrder:
    """By the hash of a key, then by the key; three hex digits are the coarse part."""
    digits = hash_digits(key, seed)
    return TotalOrder(hash_number(F.left(digits, F.lit(3))), hash_number(digits), F.col(key))


def _is(column: Column, value) -> Column:
    return column.isNull() if value is None else F.coalesce(column == F.lit(value), F.lit(False))


def _precedes(column: Column, value) -> Column:
    # Nulls come last.
    return column.isNotNull() if value is None else F.coalesce(column < F.lit(value), F.lit(False))


def in_first(df: DataFrame, n: int, order: TotalOrder) -> Column:
    """A condition that holds for exactly the first ``n`` rows by ``order``.

    A count of the coarse values finds the one the boundary lies in; another pass stores
    that value's keys, and the rest is decided on them. Applying the condition moves no
    rows. ``order`` must tell rows apart.
    """
    return _in_first(df, n, order, Places(_ones(df, order.coarse)))


def _in_first(df: DataFrame, n: int, order: TotalOrder, places: Places) -> Column:
    if n <= 0:
        return F.lit(False)
    if n <= places.n:
        found = places.at(n)
        coarse, wanted, here = found.value, n - found.below, found.equal
    else:
        coarse, wanted = None, n - places.n
        here = df.where(order.coarse.isNull()).count()
        if wanted >= here:
            return F.lit(True)
    before, at_edge = _precedes(order.coarse, coarse), _is(order.coarse, coarse)
    if wanted == here:
        return before | at_edge
    # Few rows of many partitions: write them to few files.
    edge = df.where(at_edge).select(order.fine.alias("v"), order.tie.alias("t")).hint("rebalance")
    return before | (at_edge & _in_first_fine(stage(edge, "boundary"), wanted, order))


def _in_first_fine(edge: DataFrame, n: int, order: TotalOrder) -> Column:
    places = Places(_ones(edge, F.col("v")))
    if n <= places.n:
        found = places.at(n)
        fine, wanted, here = found.value, n - found.below, found.equal
    else:
        fine, wanted = None, n - places.n
        here = edge.where("v IS NULL").count()
    before, at_edge = _precedes(order.fine, fine), _is(order.fine, fine)
    if wanted == here:
        return before | at_edge
    tied = edge.where(_is(F.col("v"), fine)).select("t")
    first = F.col("t").asc_nulls_first()
    if here <= TOP_ROWS:
        last = tied.orderBy(first).offset(wanted - 1).limit(1)
    else:
        last = global_rank(tied, [first]).where(F.col("rank") == wanted)
    last = last.first().t
    up_to = order.tie.isNull() if last is None else (order.tie.isNull() | (order.tie <= F.lit(last)))
    return before | (at_edge & up_to)


def page(df: DataFrame, order: TotalOrder, offset: int, limit: int) -> DataFrame:
    """Rows ``offset + 1 .. offset + limit`` of the order, in order.

    A deep page is cut out by its two boundaries, found in one count, and sorted; an
    ordered offset would send everything before the page through one task.
    """
    if offset + limit <= TOP_ROWS:
        return df.orderBy(*order.columns()).offset(offset).limit(limit)
    places = Places(_ones(df, order.coarse))
    cut = _in_first(df, offset + limit, order, places) & ~_in_first(df, offset, order, places)
    return df.where(cut).orderBy(*order.columns())


def numbered_pages(df: DataFrame, order: Order, size: int) -> DataFrame:
    """Every row with its ``rank`` and 0-based ``page`` number."""
    ranked = global_rank(df, order)
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / F.lit(size)))
