"""Tables written on the way, joins with small tables, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

#: Most rows of a table that is broadcast; rows here are a few hundred bytes at most.
BROADCAST_ROWS = 50_000
#: Most bytes of a table that is broadcast, where rows have texts of any length.
BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``limit`` rows; ``df`` must be stored.

    A larger one is joined by shuffle, where AQE splits the partitions of hot keys.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else large_side(df)


def large_side(df: DataFrame) -> DataFrame:
    """``df`` with the hint to join it by shuffle, as its rows grow with the input.

    Spark's own choice goes by the size of files, which knows neither what ``explode`` makes of a row nor how well ids
    are packed, so tables of many million rows can be built as one broadcast in the driver.
    """
    return df.hint("merge")


def small_bytes(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` bytes: ``size`` of each row and 64 for the rest; ``df`` must be stored."""
    total = df.agg(F.sum(F.coalesce(size.cast("bigint"), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(df) if total <= limit else large_side(df)


def relabelled(table: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``table`` with every value of ``column`` that has a row in ``labels`` (id, component) replaced by its component."""
    side = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    joined = table.join(large_side(side), F.col(column) == F.col("_id"), "left")
    return joined.withColumn(column, F.coalesce("_component", column)).drop("_id", "_component")


def _ends(pointers: DataFrame) -> DataFrame:
    """``pointers`` (id, component), each followed to its end; lengths double in every step."""
    while True:
        before = F.col("component").alias("before")
        followed = stage(relabelled(pointers.select("id", "component", before), pointers, "component"), "pointers")
        pointers = followed.select("id", "component")
        if followed.agg(F.max(F.col("component") != F.col("before"))).first()[0] is not True:
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b) that is not the smallest of its component: the smallest id it is connected with.

    In a round every node that has a smaller neighbour points at its smallest one, and pointers are followed to their ends. Links
    between different ends are the next round's edges; of neighbours only one is left there, so few rounds do. Trees, as of nodes
    that have a single smaller neighbour each, take one. A round is a partial aggregate and some joins; a node
    with very many neighbours is split by AQE.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    found = None
    while True:
        pointers = stage(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "pointers")
        ends = _ends(pointers)
        found = ends if found is None else extended(found, ends)
        if edges.count() == pointers.count():
            return found
        moved = relabelled(relabelled(edges, ends, "a"), ends, "b").where("a <> b")
        edges = stage(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        if edges.count() == 0:
            return found


def extended(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` after ``more``, both as :func:`components` gives them; the ids of ``more`` are components of ``found`` or in none."""
    return stage(relabelled(found, more, "component").union(more), "components")
