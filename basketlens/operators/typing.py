"""Narrowing, describing and advising column types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import stringify

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)

# Range of each integer type, and the error a float may introduce.
INTEGER_TYPES = [("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64)]
FLOAT_TOLERANCE = 5e-4

# Types of a narrowed event table.
NARROW_EVENTS = {"product_id": "int", "user_id": "int", "price": "float"}


def narrow(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast to fixed narrower types; a value out of range becomes null.

    :func:`narrowing_losses` counts such values, :func:`fitting_types` picks types without any.
    """
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def narrowing_losses(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Values :func:`narrow` would turn into null: ``column, n_lost``."""
    present = [c for c in types if c in df.columns]
    lost = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull()).alias(c) for c in present]
    )
    return lost.unpivot([], present, "column", "n_lost")


def fitting_types(df: DataFrame, types: Mapping[str, str]) -> dict[str, str]:
    """Those of ``types`` that no value is lost by; one pass, a row per column to the driver."""
    present = [c for c in types if c in df.columns]
    if not present:
        return {}
    return {r["column"]: types[r["column"]] for r in narrowing_losses(df, types).where("n_lost = 0").collect()}


def stringify_columns(df: DataFrame, columns: Sequence[str], null_literal: str | None = None) -> DataFrame:
    """Columns as text, optionally with a literal where they are null."""
    return df.withColumns({c: stringify(c, null_literal) for c in columns if c in df.columns})


def describe(df: DataFrame) -> DataFrame:
    """The columns of ``df`` as rows: ``position, column, type, nullable``."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def suggest_types(df: DataFrame) -> DataFrame:
    """The narrowest type each numeric column fits: ``column, type, suggested``.

    Integers by range (Spark has no unsigned types); doubles become floats if no value
    moves by more than ``FLOAT_TOLERANCE``. One pass over the numeric columns.
    """
    fields = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, INTEGRAL + FRACTIONAL)}
    aggregates = []
    for name, dtype in fields.items():
        c = F.col(name)
        if isinstance(dtype, INTEGRAL):
            aggregates += [F.min(c).alias(f"{name}.a"), F.max(c).alias(f"{name}.b")]
        else:
            error = F.abs(c.cast("double") - c.cast("float").cast("double"))
            aggregates += [F.max(error).alias(f"{name}.a")]
    measured = df.agg(*aggregates)
    rows = []
    for name, dtype in fields.items():
        a = F.col(f"`{name}.a`")
        if isinstance(dtype, INTEGRAL):
            b = F.col(f"`{name}.b`")
            best = F.lit(dtype.simpleString())
            for type_name, bits in reversed(INTEGER_TYPES):
                limit = 1 << (bits - 1)
                best = F.when((a >= F.lit(-limit)) & (b <= F.lit(limit - 1)), type_name).otherwise(best)
        else:
            best = F.when(a <= FLOAT_TOLERANCE, "float").otherwise("double")
        rows.append(F.struct(F.lit(name).alias("column"), F.lit(dtype.simpleString()).alias("type"), best.alias("suggested")))
    return measured.select(F.inline(F.array(*rows)))


def apply_types(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Cast ``df`` to the types :func:`suggest_types` found (one row per column)."""
    types = {r["column"]: r["suggested"] for r in suggestions.collect()}
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
