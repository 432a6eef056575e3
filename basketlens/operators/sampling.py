"""Samples and splits that are functions of the keys, not of the data layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..functions.columns import hash_below
from .ordering import by_hash, by_time, in_first

# The sampling and split settings used by the training jobs.
SEED = 42
TRAIN_FRACTION = 0.8


def sample_fraction(df: DataFrame, fraction: float, seed: int = SEED, key: Column | str | None = None) -> DataFrame:
    """About ``fraction`` of the rows.

    With a key, the rows whose key hashes below the fraction: the same rows however the
    data is partitioned. Without one, Spark's own Bernoulli sample.
    """
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(hash_below(key, seed, fraction))


def sample_n(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) drawn without replacement.

    The rows with the smallest key hashes. The cut-off hash is found by counting passes,
    so no task holds the sample, however large. ``key`` must be unique.
    """
    return df.where(in_first(df, n, by_hash(key, seed)))


def random_split(df: DataFrame, fraction: float, key: Column | str, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(about ``fraction`` of the rows, the rest), decided by the key's hash."""
    inside = hash_below(key, seed, fraction)
    return df.where(inside), df.where(~inside)


def time_split_column(
    df: DataFrame,
    fraction: float = TRAIN_FRACTION,
    time: str = "session_start",
    tie: str = "user_session",
    n_rows: int | None = None,
) -> Column:
    """True for the first ``floor(fraction * rows)`` rows by ``(time, tie)``."""
    n_rows = df.count() if n_rows is None else n_rows
    return in_first(df, int(n_rows * fraction), by_time(time, tie))


def time_split(df: DataFrame, fraction: float = TRAIN_FRACTION, **options) -> tuple[DataFrame, DataFrame]:
    """(train, test) by time: the first ``floor(fraction * rows)`` rows, and the rest.

    Equal times are ordered by the session, so the split is the same on every run. ``df``
    is read twice: pass a stored table, not a long computation. The split itself is
    a filter and moves no rows.
    """
    early = time_split_column(df, fraction, **options)
    return df.where(early), df.where(~early)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs, columns matched by name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """The distinct rows of all inputs, columns matched by name."""
    return union_all(frames).distinct()
