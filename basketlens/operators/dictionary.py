"""One dictionary of string values over several inputs; encoding and decoding with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from ..schema import DICTIONARY_COLUMNS
from .ordering import global_rank
from .sampling import union_distinct

# A column's dictionary is broadcast up to this size; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024
_ENTRY_BYTES = 32


def distinct_values(frames: Sequence[DataFrame], columns: Sequence[str] = DICTIONARY_COLUMNS) -> DataFrame:
    """Distinct non-null values per column over all inputs: ``column, value``; one scan each."""
    values = []
    for frame in frames:
        pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
        values.append(frame.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()))
    return union_distinct(values)


def build_dictionary(frames: Sequence[DataFrame], columns: Sequence[str] = DICTIONARY_COLUMNS) -> DataFrame:
    """``column, value, code``: a value's code is its 0-based place among its column's
    sorted values.

    All columns are ranked in one distributed sort, so a column with very many values is
    not gathered in one task.
    """
    values = distinct_values(frames, columns)
    ranked = global_rank(values, [F.col("column"), F.col("value")], "place")
    # One row per column.
    firsts = ranked.groupBy("column").agg(F.min("place").alias("first_place"))
    codes = ranked.join(F.broadcast(firsts), "column").select(
        "column", "value", (F.col("place") - F.col("first_place")).alias("code")
    )
    # Looked up once per column and input: store it rather than rank it each time.
    return stage(codes, "dictionary")


def dictionary_bytes(dictionary: DataFrame) -> dict[str, int]:
    """Approximate size of each column's dictionary."""
    size = F.sum(F.octet_length("value") + F.lit(_ENTRY_BYTES))
    return {r["column"]: r["bytes"] for r in dictionary.groupBy("column").agg(size.alias("bytes")).collect()}


def _lookup(df: DataFrame, side: DataFrame, key: str, small: bool) -> DataFrame:
    # Beyond the broadcast limit this is a shuffled left join, whose hot keys and nulls
    # Spark splits over several tasks (AQE skew join).
    return df.join(F.broadcast(side) if small else side, key, "left")


def encode(
    df: DataFrame,
    dictionary: DataFrame,
    columns: Sequence[str] = DICTIONARY_COLUMNS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Replace each column by ``<column>_code``; null stays null."""
    sizes = dictionary_bytes(dictionary)
    result = df
    for c in columns:
        side = dictionary.where(F.col("column") == c).select(
            F.col("value").alias(c), F.col("code").cast("int").alias(f"{c}_code")
        )
        result = _lookup(result, side, c, sizes.get(c, 0) <= broadcast_bytes)
    return result.select(*[f"{c}_code" if c in columns else c for c in df.columns])


def decode(
    df: DataFrame,
    dictionary: DataFrame,
    columns: Sequence[str] = DICTIONARY_COLUMNS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inverse of :func:`encode`."""
    sizes = dictionary_bytes(dictionary)
    result = df
    for c in columns:
        side = dictionary.where(F.col("column") == c).select(
            F.col("code").cast("int").alias(f"{c}_code"), F.col("value").alias(c)
        )
        result = _lookup(result, side, f"{c}_code", sizes.get(c, 0) <= broadcast_bytes)
    names = {f"{c}_code": c for c in columns}
    return result.select(*[names.get(c, c) for c in df.columns])
