"""Quality rules: documents far from the robust centre of their language and source.

Every document gets a vector of transformed statistics. For each language and source a
minimum-covariance-determinant estimate is fitted to all its documents: from two deterministic
starts, concentration steps alternate between distances and the moments of the nearest half.
Documents are first summed (count, sums, products) in the cells of a bounded grid of half a
floor's width, in the map tasks; the steps take cells nearest first. So a group with a third of all rows
is a table of cells like any other, and no group of documents is ever gathered. Groups of under ``min_rows`` documents are judged by
the estimate of their language, or else by that of the whole table; with fewer rows than that in
all, no document is rejected by distance. A variance below a floor per statistic is raised to it, as most documents
have no symbols and no repetition at all, where a plain estimate would be singular. The floors let each statistic
reject by itself: its range holds six floors.

Null and empty texts have no words and fail the base rule. Null languages and sources form groups of
their own. Equal rows get equal verdicts. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .storage import small_side
from .text import _LAP, gram_hashes, grouped, mix, prepare, runs, slices, span_hashes, utf8, word_offsets, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines"]
#: Vector components are whole multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1024
#: Standard deviation, at least, of: log word length, symbols per letter, repeated words, repeated lines (roots).
FLOORS = [0.10, 0.03, 0.12, 0.16]
SIZE = len(FLOORS)
MIN_ROWS = 50
COVER = 0.5
#: The share of a normal population that lies beyond the cutoff.
TAIL = 1e-6
MAX_STEPS = 100
#: Components count as no larger than this for their cell: e to the 5th characters a word, and the most there is.
LARGEST = [5, 1, 2, 1]

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_COUNT_TYPE = "struct<" + ",".join(f"{n}:bigint" for n in COUNTS) + ">"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how many there are of it, and whether it is the first of them."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    head = np.zeros(len(keys), bool)
    head[first] = True
    return counts[inverse], head


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text."""
    n = len(offsets) - 1
    starts, ends = words(data, offsets)
    first = word_offsets(starts, offsets)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.subtract.at(inside, ends, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _sums(_SYMBOLS[data], offsets)}

    line_starts, line_ends = runs(data != 10, offsets)
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_text = np.searchsorted(offsets, line_starts, side="right") - 1
    _, head = _repeats(mix(span_hashes(data, line_starts, line_ends) + line_text.astype(np.uint64) * _LAP))
    out["n_dup_lines"] = np.bincount(line_text[~head], minlength=n)[:n]
    out["n_lines"] = np.bincount(line_text, minlength=n)[:n]

    grams = gram_hashes(span_hashes(data, starts, ends), 3)
    windows = np.maximum(n_words - 2, 0)
    at = grouped(first[:-1], windows)
    owner = np.repeat(np.arange(n), windows)
    often, _ = _repeats(mix(grams[at] + owner.astype(np.uint64) * _LAP))
    marked = np.zeros(len(starts), bool)
    for k in range(3):
        marked[at[often > 1] + k] = True
    out["n_repeat_words"] = _sums(marked, first)
    return out


def _count_struct(text: pa.Array) -> pa.Array:
    parts = [count_texts(*utf8(s.column(0))) for s in slices(pa.record_batch([text], names=["text"]), "text")]
    parts = parts or [{n: np.zeros(0, np.int64) for n in COUNTS}]
    arrays = [pa.array(np.concatenate([p[n] for p in parts]).astype(np.int64)) for n in COUNTS]
    return pa.StructArray.from_arrays(arrays, names=COUNTS)


def counts(text: Column) -> Column:
    """A struct of ``COUNTS`` for each text."""

    def count(column: pa.Array) -> pa.Array:
        return _count_struct(column)

    # Not marked so, a filter on the counts would be pushed below and count every text twice.
    return F.arrow_udf(count, _COUNT_TYPE).asNondeterministic()(text)


def base_failed() -> Column:
    """Too short, or half of it repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    share = F.least(F.lit(1.0), F.col("n_repeat_words") / n)
    raw = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.asin(F.sqrt(share)),
        F.sqrt(F.col("n_dup_lines") / lines),
    ]
    return [F.round(x * UNIT).cast("double") for x in raw]


def _levels() -> Column:
    tag = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("-"))
    return F.array(F.concat_ws("\x1f", F.lit("2"), tag("lang"), tag("source")), F.concat_ws("\x1f", F.lit("1"), tag("lang")), F.lit("0"))


def vectors(df: DataFrame, *names: str) -> DataFrame:
    """``names``, then levels (its group, its language, everything), z0.. and base_failed.

    ``df`` has lang, source and the columns of ``COUNTS``.
    """
    return df.select(*names, _levels().alias("levels"), base_failed().alias("base_failed"), *(z.alias(f"z{i}") for i, z in enumerate(_vector())))


def chi2_share(x: float, size: int) -> float:
    """The share of a chi-square population of even ``size`` that lies below ``x``."""
    term, total = 1.0, 0.0
    for i in range(size // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(share: float, size: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, size) < share else (low, mid)
    return high


def _distance() -> Column:
    away = [F.col(f"z{i}") - F.col("center")[i] for i in range(SIZE)]
    total = F.lit(0.0)
    for i in range(SIZE):
        for j in range(SIZE):
            total = total + away[i] * away[j] * F.col("inverse")[i * SIZE + j]
    return F.greatest(total, F.lit(0.0))


def _cell() -> list[Column]:
    """Which cell of the grid a vector lies in; the grid is bounded, as the statistics are."""
    return [F.floor(F.least(F.col(f"z{i}"), F.lit(float(LARGEST[i] * UNIT))) / F.lit(FLOORS[i] * UNIT / 2)).cast("int").alias(f"c{i}") for i in range(SIZE)]


def _raised(cov: np.ndarray) -> np.ndarray:
    """The covariance with variances of at least the floors."""
    return cov + np.diag(np.maximum((np.array(FLOORS) * UNIT) ** 2 - np.diag(cov), 0))


class _Cells:
    """The cells of a group: how many vectors each has, their sums and the sums of their products."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values([f"c{i}" for i in range(SIZE)])
        self.n = rows["n"].to_numpy(float)
        self.sums = rows[[f"s{i}" for i in range(SIZE)]].to_numpy(float)
        self.products = np.stack([[rows[f"s{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(SIZE)] for i in range(SIZE)]).transpose(2, 0, 1)
        self.means = self.sums / self.n[:, None]

    def estimate(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean, and covariance with the floors, of the vectors in these cells."""
        count = self.n[cells].sum()
        center = self.sums[cells].sum(axis=0) / count
        cov = self.products[cells].sum(axis=0) / count - np.outer(center, center)
        share = count / self.n.sum()
        if share < 1:
            cov = cov * share / chi2_share(chi2_quantile(share, SIZE), SIZE + 2)
        return center, _raised(cov)

    def nearest(self, center: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """The cells nearest to the center, as many as hold ``COVER`` of all vectors, in order of their number."""
        away = self.means - center
        order = np.argsort(np.einsum("ki,ij,kj->k", away, np.linalg.inv(cov), away), kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.n[order]), math.ceil(COVER * self.n.sum())))
        return np.sort(order[: enough + 1])

    def medians(self) -> tuple[np.ndarray, np.ndarray]:
        """Median and median deviation of each component, over the cells' means."""

        def middle(values: np.ndarray) -> float:
            order = np.argsort(values, kind="stable")
            return float(values[order][np.searchsorted(np.cumsum(self.n[order]), self.n.sum() / 2)])

        center = np.array([middle(self.means[:, i]) for i in range(SIZE)])
        spread = [1.4826 * middle(np.abs(self.means[:, i] - center[i])) for i in range(SIZE)]
        return center, _raised(np.diag(np.square(spread)))


_PARAMS = "level string, center array<double>, inverse array<double>, logdet double"


def _concentrated(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The estimate with the least determinant, from either start."""
    cells = _Cells(rows)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for center, cov in (cells.medians(), cells.estimate(np.arange(len(cells.n)))):
        chosen = np.zeros(0, int)
        for _ in range(MAX_STEPS):
            after = cells.nearest(center, cov)
            if np.array_equal(after, chosen):
                break
            chosen = after
            center, cov = cells.estimate(chosen)
        logdet = float(np.linalg.slogdet(cov)[1])
        if best is None or logdet < best[0]:
            best = (logdet, center, cov)
    return best[1], best[2]


def fit(table: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(level, center, inverse): the estimate of every level with at least ``min_rows`` rows, stored.

    ``table`` is a result of ``vectors``; rows that fail the base rule are left out.
    """
    z = [f"z{i}" for i in range(SIZE)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(z)]
    sums += [F.sum(F.col(z[i]) * F.col(z[j])).alias(f"s{i}_{j}") for i in range(SIZE) for j in range(i, SIZE)]
    rows = table.where("not base_failed").select(F.explode("levels").alias("level"), *z, *_cell())
    cells = rows.groupBy("level", *(f"c{i}" for i in range(SIZE))).agg(F.count("*").alias("n"), *sums)

    def estimate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if rows["n"].sum() < min_rows:
            return pd.DataFrame(columns=["level", "center", "inverse", "logdet"], dtype=object)
        center, cov = _concentrated(rows)
        return pd.DataFrame({"level": [key[0]], "center": [center.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()], "logdet": [float(np.linalg.slogdet(cov)[1])]})

    return stage(cells.groupBy("level").applyInPandas(estimate, _PARAMS).select("level", "center", "inverse"), "estimates")


def judge(table: DataFrame, params: DataFrame, *names: str) -> DataFrame:
    """``names`` of a result of ``vectors``, with the squared distance and whether each row is kept."""
    side = small_side(params)
    found = table
    for k in range(3):
        found = found.join(side.select(F.col("level").alias(f"level{k}"), F.struct("center", "inverse").alias(f"p{k}")), found["levels"][k] == F.col(f"level{k}"), "left")
    found = found.withColumn("p", F.coalesce("p0", "p1", "p2")).withColumn("center", F.col("p.center")).withColumn("inverse", F.col("p.inverse"))
    cutoff = chi2_quantile(1 - TAIL, SIZE)
    found = found.withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return found.select(*names, "base_failed", kept.alias("kept"), "distance")


def quality_counts(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``) and the columns of ``COUNTS``."""
    prepare(docs.sparkSession)
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), counts(F.col("text")).alias("c"))
    return marked.select("row", *(F.col(f"c.{n}").alias(n) for n in COUNTS))


def quality_filter(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents that pass the base rule and lie near the centre of their group."""
    table = quality_counts(docs).select("row", "row.lang", "row.source", *COUNTS)
    fitted = fit(stage(vectors(table), "vectors"), min_rows)
    return judge(vectors(table, "row"), fitted, "row").where("kept").select("row.*")
