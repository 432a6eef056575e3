"""Words, lines and hashes of whole texts, computed on Arrow buffers inside a task.

A batch of texts is one byte array with offsets; nothing here loops over words in Python. Null
texts count as empty. Hashes are 64 bits: a random table per byte value and position, summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_POSITIONS = 1024
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**64, 256, np.uint64)
_PLACE = _rng.integers(1, 2**64, _POSITIONS, np.uint64) | np.uint64(1)
_LAP = np.uint64(0x9E3779B97F4A7C15)


#: Arrow batches end at so many bytes or rows, as documents can be long and a task holds a batch whole.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set ``BATCHES``."""
    for name, value in BATCHES.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def kept_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names``; whatever else a caller's table has cannot clash with columns made here."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``limit`` bytes in ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and the offset of each (one more than values)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every text."""
    return runs(~_SPACE[data], offsets)


def word_offsets(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the number of its first word (one more than texts)."""
    return np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes. Spans are in order and do not overlap; an empty one has hash 0."""
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    some = np.flatnonzero(sizes)
    if len(some):
        first = np.cumsum(sizes[some]) - sizes[some]
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes[some])
        at = place + np.repeat(starts[some], sizes[some])
        value = _BYTE[data[at]] * _PLACE[place % _POSITIONS]
        if (far := place >= _POSITIONS).any():
            value[far] *= mix((place[far] // _POSITIONS).astype(np.uint64) * _LAP) | np.uint64(1)
        out[some] = np.add.reduceat(value, first) + sizes[some].astype(np.uint64) * _LAP
    return mix(out)


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive symbols, across whatever borders there are."""
    size = len(symbols) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += symbols[k : k + size] * (_PLACE[k % _POSITIONS] + np.uint64(2 * (k // _POSITIONS)))
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def grouped(numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of the consecutive groups of these sizes, plus ``numbers`` repeated."""
    starts = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(starts - numbers, counts)
