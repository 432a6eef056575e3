"""Standardised features (mean 0, population standard deviation 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import by_time, in_first


def first_rows(df: DataFrame, n: int, time: str = "session_start", tie: str = "user_session") -> DataFrame:
    """The earliest ``n`` rows, to fit a scaler on those alone."""
    return df.where(in_first(df, n, by_time(time, tie)))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, mean, std`` over all rows of ``df``, in one pass.

    A constant column gets std 1, so scaling it gives 0.
    """
    moments = df.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{c}.{name}")
            for c in columns
            for name, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )
    rows = []
    for c in columns:
        std = F.col(f"`{c}.std`")
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`{c}.mean`").alias("mean"),
                F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"),
            )
        )
    return moments.select(F.inline(F.array(*rows)))


def scale(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Apply a fitted scaler (one row per column) to the columns it names."""
    fitted = scaler.collect()
    return df.withColumns(
        {r["column"]: (F.col(r["column"]) - F.lit(r["mean"])) / F.lit(r["std"]) for r in fitted}
    )
