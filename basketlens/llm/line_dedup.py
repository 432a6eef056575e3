"""Line dedup by content-defined chunks and by windows of two lines.

``removed_passages`` (op9 and the pipeline's stage) does the whole job: every two consecutive lines with a word, and what stands between
them, are a window; of windows found more than once in the table the first (by doc_id, key and place) stays, and the
lines of every other one are removed if its bytes equal those of the first. So each repeated passage of two
lines or more goes, wherever it begins and ends. Where a window overlaps an equal one (three equal lines), the
shared line is left to the first.

``removed_lines`` has fewer rows to compare: a chunk ends after each line whose hash is a local
minimum among the lines with a word, so that the same passage is cut alike wherever it stands, about every three
lines. No chunk has fewer than ``MIN_LINES`` lines with a word unless its text has fewer, so a copy of a text with
so many lines goes as a whole. Chunks are counted, and repeated ones go in the same way. A
passage loses only the chunks that lie inside it whole; short ones often have none.

Equal rows (same doc_id and text) are one document and are cut alike. Null ids come first; null texts
stay null. A text that loses all its lines leaves the table, as earlier documents have all of it; empty
texts stay. Counts by hash are summed in the map tasks, and the comparison joins one row per repeated
chunk with its copies, so a chunk in a third of all rows is split by AQE. Bytes are
cut out for the repeated spans only, so what is written on the way follows the texts and not the windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .storage import large_side
from .text import prepare, slices, span_hashes, text_key, utf8, words

MIN_LINES = 2


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every line: its text's number, its start, its end with and without the line end, and whether it has a word."""
    starts, _ = words(data, offsets)
    first = np.concatenate(([True], data[:-1] == 10)) if len(data) else np.zeros(0, bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    line_starts = np.flatnonzero(first)
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    bare = line_ends - (data[np.maximum(line_ends - 1, 0)] == 10 if len(data) else 0)
    line_text = np.searchsorted(offsets, line_starts, side="right") - 1
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    return line_text, line_starts, line_ends, bare, filled


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every chunk: its text's number, its start and end in bytes, and its lines with a word.

    The chunks of a text, joined, are the text; line ends belong to the line they end.
    """
    line_text, line_starts, line_ends, bare, filled = _lines(data, offsets)
    ends = np.append(line_text[1:] != line_text[:-1], True) if len(line_text) else np.zeros(0, bool)
    own = np.flatnonzero(filled)
    hashes, text = span_hashes(data, line_starts, bare)[own], line_text[own]
    if len(own) > 3:
        within = text[3:] == text[:-3]  # two lines at least on both sides
        ends[own[1:-2]] |= within & (hashes[:-3] > hashes[1:-2]) & (hashes[1:-2] <= hashes[2:-1])
    end_lines = np.flatnonzero(ends)
    start_lines = np.concatenate(([0], end_lines[:-1] + 1)) if len(end_lines) else end_lines
    total = np.concatenate(([0], np.cumsum(filled)))
    return line_text[start_lines], line_starts[start_lines], line_ends[end_lines], total[end_lines + 1] - total[start_lines]


def _long_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, start, end, lines = cut(data, offsets)
    pick = lines >= MIN_LINES
    return text[pick], start[pick], end[pick]


def _line_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line_text, line_starts, _, bare, filled = _lines(data, offsets)
    own = np.flatnonzero(filled)
    one, two = own[:-1], own[1:]
    pick = line_text[one] == line_text[two]
    return line_text[one[pick]], line_starts[one[pick]], bare[two[pick]]


def _bare(chunk: bytes) -> bytes:
    """A chunk that ends its text has no line end; it is the same passage."""
    return chunk[:-1] if chunk.endswith(b"\n") else chunk


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _spans(docs: DataFrame, find: Callable) -> DataFrame:
    """(key, doc_id, place, size, hash) of every span that ``find`` gives; place is its first byte, size that of its bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(2))
                text, start, end = find(data, offsets)
                raw = [_bare(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(text)),
                        part.column(1).take(pa.array(text)),
                        pa.array(start - offsets[text]),
                        pa.array([len(r) for r in raw], pa.int64()),
                        pa.array([hashlib.md5(r).digest() for r in raw], pa.binary()),
                    ],
                    names=["key", "doc_id", "place", "size", "hash"],
                )

    return _rows(docs).mapInArrow(make, "key binary, doc_id bigint, place bigint, size bigint, hash binary")


def _bytes_of(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (key, doc_id, place, size, hash, is_first) with their ``bytes``. Texts that have none of them are not looked at."""
    wanted = spans.groupBy("key", "doc_id").agg(F.collect_list(F.struct("place", "size", "hash", "is_first")).alias("spans"))
    wanted = wanted.select(F.col("key").alias("in_key"), F.col("doc_id").alias("in_id"), "spans")
    texts = _rows(docs).join(large_side(wanted), (F.col("key") == F.col("in_key")) & F.col("doc_id").eqNullSafe(F.col("in_id")))
    each = texts.select("key", "doc_id", F.col("text").cast("binary").alias("data"), F.explode("spans").alias("s"))
    piece = F.substring("data", (F.col("s.place") + 1).cast("int"), F.col("s.size").cast("int"))
    return each.select("key", "doc_id", "s.*", piece.alias("bytes"))


def chunks(docs: DataFrame) -> DataFrame:
    """The chunks of ``MIN_LINES`` lines."""
    return _spans(docs, _long_chunks)


def windows(docs: DataFrame) -> DataFrame:
    """Every two consecutive lines with a word, and what stands between them."""
    return _spans(docs, _line_pairs)


def removals(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = chunks) -> DataFrame:
    """(key, doc_id, places): the spans that each document loses; documents that lose none have no row."""
    prepare(docs.sparkSession)
    occurrences = stage(find(docs).distinct(), "chunk-places")
    counted = occurrences.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "place")).alias("first"))
    repeated = stage(counted.where("n > 1").select("hash", "first"), "chunk-hashes")
    is_first = F.struct("doc_id", "key", "place").eqNullSafe(F.col("first"))
    spans = occurrences.join(large_side(repeated), "hash").select("key", "doc_id", "place", "size", "hash", is_first.alias("is_first"))
    # Equal rows of a table give equal copies; both sides of the comparison take them once.
    copies = stage(_bytes_of(docs, spans), "chunk-copies")
    originals = copies.where("is_first").select("hash", F.col("bytes").alias("original")).dropDuplicates(["hash"])
    equal = copies.where("NOT is_first").join(large_side(originals), "hash").where("bytes = original")
    return equal.groupBy("key", "doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def _without_chunks(data: bytes, places: list[int]) -> tuple[bytes, int]:
    _, start, end, _ = cut(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    lost = set(places)
    return b"".join(data[a:b] for a, b in zip(start, end, strict=True) if a not in lost), len(lost)


def _without_windows(data: bytes, places: list[int]) -> tuple[bytes, int]:
    """What is left, and how many passages of adjoining windows are gone."""
    _, starts, ends, bare, filled = _lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    starts, ends, bare = starts[filled].tolist(), ends[filled].tolist(), bare[filled].tolist()
    gone, left, n, until = [False] * len(starts), [], 0, 0
    for k in np.searchsorted(starts, places).tolist():
        overlaps = k > 0 and data[starts[k - 1] : bare[k]] == data[starts[k] : bare[k + 1]]
        gone[k] |= not overlaps
        gone[k + 1] = True
        begin = ends[k] if overlaps else starts[k]
        if begin > until or not n:
            left.append(data[until:begin])
            n += 1
        until = ends[k + 1]
    left.append(data[until:])
    return (b"" if all(gone) else b"".join(left)), n


def _removed(docs: DataFrame, find: Callable[[DataFrame], DataFrame], without: Callable[[bytes, list[int]], tuple[bytes, int]]) -> DataFrame:
    lost = removals(docs, find).select(F.col("key").alias("lost_key"), F.col("doc_id").alias("lost_id"), "places")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key(F.col("text")).alias("key"), F.col("doc_id").cast("bigint").alias("id"))
    joined = rows.join(large_side(lost), (F.col("key") == F.col("lost_key")) & F.col("id").eqNullSafe(F.col("lost_id")), "left")

    def rebuild(column: pa.Array, places: pa.Array) -> pa.Array:
        texts, counts, gone = [], [], []
        for text, lost in zip(column, places, strict=True):
            raw, lost = text.as_py(), lost.as_py()
            n, size = 0, 0
            if raw is not None and lost:
                data = raw.encode()
                left, n = without(data, lost)
                raw, size = left.decode(), len(data) - len(left)
            texts.append(raw)
            counts.append(n)
            gone.append(size)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=["text", "n_chunks", "n_bytes"])

    # Not marked so, a filter on the result would be pushed below and rebuild every text twice.
    left = F.arrow_udf(rebuild, "struct<text:string,n_chunks:bigint,n_bytes:bigint>").asNondeterministic()(F.col("row.text"), F.col("places"))
    return joined.select("row", left.alias("left")).select("row", "left.text", "left.n_chunks", "left.n_bytes")


def removed_lines(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text (what is left of it), n_chunks and n_bytes (removed)."""
    return _removed(docs, chunks, _without_chunks)


def removed_passages(docs: DataFrame) -> DataFrame:
    """The same by windows; n_chunks counts the passages removed."""
    return _removed(docs, windows, _without_windows)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, texts without repeated passages; texts of which nothing is left are gone."""
    found = removed_passages(docs).where("n_chunks = 0 or trim(both ' \\t\\n\\r' from text) <> ''")
    return found.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
