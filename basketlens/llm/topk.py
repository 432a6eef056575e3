"""Exact top-k search by Fagin's threshold algorithm.

Vectors are dealt into blocks by a hash of their id. A task holds one block: its matrix and, for every
dimension, the block's rows sorted by their component. Queries pass by. For each, the lists are gone down side
by side, from the end that the sign of the query's component favours; rows met for the first time are
scored, and the sum of the products at the present depth bounds all rows not met yet. It stops when that bound is
below the k-th score (at equality a smaller id could still come).

Every query first searches the block that holds itself. The k-th score there is a floor for all others: a block whose
bound is below it at the top of its lists is left at once, and of others only scores from the floor up come out, so what is
shuffled is a few rows per query. A window per query keeps the k best. Nothing is approximate and no candidate is skipped unseen by a bound.

Null vectors and those with null or non-finite components take no part, nor do rows without an id. Every finite vector
does: scores are sums in doubles or 64-bit integers where these hold all of them exactly, else in Python's
integers. A result whose score does not fit a long stops the query with an error, and so does a component of 2**1015 and
more. Vectors of different length have no score. Equal rows are one;
candidates with the query's id are the query. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage
from .text import prepare

BLOCK_ROWS = 8192
SCALE = 256
#: Scores beyond 38 digits are ranked as this; as a result they are an error.
_FAR = 10**38 - 1
_SCORE = pa.decimal128(38, 0)


def scaled(vector: Column) -> Column:
    """floor(SCALE * x) of each component, a whole double; null for vectors that take no part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    # Whole numbers from 2**53 up are themselves; floor() would make them longs.
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return F.when(finite, F.transform(F.when(finite, vector), lambda x: whole(x.cast("double") * SCALE)))


def _integers(numbers: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    if not np.isfinite(numbers).all():
        raise OverflowError("a component is 2**1015 or more")
    return np.array([int(x) for x in numbers.ravel()], object).reshape(numbers.shape)


class Lists:
    """A block of vectors with its sorted lists."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.floats = ids[order], matrix[order]
        columns = np.ascontiguousarray(self.floats.T)
        self.rows = np.argsort(columns, axis=1, kind="stable")  # a list for each dimension
        self.values = np.take_along_axis(columns, self.rows, axis=1)
        self.largest = float(np.abs(self.floats).max(initial=0))
        self.kinds: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _exact(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matrix, lists and query in the fastest numbers that hold all sums of products exactly."""
        most = self.largest * float(np.abs(query).max(initial=0)) * max(1, len(query))
        if most < 2**53:
            return self.floats, self.values, query
        name, convert = ("int64", lambda x: x.astype(np.int64)) if most < 2**62 else ("object", _integers)
        if name not in self.kinds:
            self.kinds[name] = convert(self.floats), convert(self.values)
        return *self.kinds[name], convert(query)

    def best(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the k best rows that score ``floor`` at least; smaller ids first among equals."""
        matrix, values, query = self._exact(query)
        n = len(self.ids)
        ascending, falling = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        bound_at = lambda low, high: query[ascending] @ values[ascending, low] + query[falling] @ values[falling, high]
        if n and floor is not None and bound_at(0, n - 1) < floor:
            return []
        seen = np.zeros(n, bool)
        found: list[tuple[int, int]] = []
        depth, step = 0, max(k, n // 256)
        while depth < n:
            until = min(n, depth + step)
            fresh = np.concatenate((self.rows[ascending, depth:until].ravel(), self.rows[falling, n - until : n - depth].ravel()))
            if not (len(ascending) or len(falling)):
                fresh, until = np.arange(n), n
            mark = np.zeros(n, bool)
            mark[fresh] = True
            rows = np.flatnonzero(mark & ~seen)
            seen |= mark
            rows = rows[self.ids[rows] != query_id]
            scores = matrix[rows] @ query if len(query) else np.zeros(len(rows))
            least = floor if len(found) < k else max(found[-1][1], found[-1][1] if floor is None else floor)
            if least is not None:
                rows, scores = rows[scores >= least], scores[scores >= least]
            if len(rows) > k and scores.dtype != object:
                near = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[near], scores[near]
            found = sorted([*found, *zip(self.ids[rows].tolist(), map(int, scores), strict=True)], key=lambda x: (-x[1], x[0]))[:k]
            bound = bound_at(until - 1, n - until)
            if (len(found) == k and bound < found[-1][1]) or (floor is not None and bound < floor):
                break
            depth, step = until, step * 2
        return found


def _search(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each block, from rows sorted by (block, size, is_query)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, lists = None, [], [], None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for block, size, is_query, vec_id, vector, floor in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), batch.column(5).to_pylist(), strict=True):
                if (block, size) != at:
                    at, ids, vectors, lists = (block, size), [], [], None
                numbers = vector.values.to_numpy()
                if not is_query:
                    ids.append(vec_id)
                    vectors.append(numbers)
                    continue
                if lists is None:
                    lists = Lists(np.array(ids, np.int64), np.array(vectors, np.float64).reshape(len(ids), size))
                out += [(vec_id, *pair) for pair in lists.best(vec_id, numbers, k, None if floor is None else int(floor))]
            scores = [max(-_FAR, min(_FAR, score)) for _, _, score in out]
            arrays = [pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, _SCORE)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(search, "query_id bigint, vec_id bigint, score decimal(38,0)")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``is_query`` names, their k best among all others."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), scaled(F.col(f"`{embedding}`")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("vec_id is not null and vector is not null").distinct()
    n_blocks = max(1, math.ceil(vectors.count() / block_rows))
    rows = stage(rows, "vectors")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    no_floor = F.lit(None).cast("decimal(38,0)").alias("floor")
    corpus = rows.select(block.alias("block"), F.size("vector").alias("size"), F.lit(False).alias("is_query"), "vec_id", "vector", no_floor)
    asking = rows.where("asks").select(block.alias("block"), F.size("vector").alias("size"), F.lit(True).alias("is_query"), "vec_id", "vector", no_floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(questions: DataFrame) -> DataFrame:
        dealt = corpus.union(questions).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "size", "is_query")
        return _search(dealt, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = ranked(asking)
    if n_blocks > 1:
        # What the own block gives is a floor; each query then passes by the other blocks.
        own = stage(found, "own-block")
        floors = own.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda b: b != F.col("own")))
        again = asking.drop("floor").withColumnRenamed("block", "own").join(floors, "vec_id", "left")
        again = again.select(others.alias("block"), "size", "is_query", "vec_id", "vector", "floor")
        both = own.drop("rank").union(ranked(again).drop("rank"))
        found = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # A score that does not fit is an error, also where casts are lenient.
    fits = F.abs("score") <= 2**63 - 1
    score = F.when(fits, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("decimal(38,0)"))
    return found.select("query_id", "rank", "vec_id", score.cast("bigint").alias("score"))
