"""Windows of units (bytes or words) that start more than once in the corpus, whatever finds them in a block.

1. Of every window the smallest hash of its ``gram``-unit grams is its anchor: equal windows have equal
   anchors at equal places. Anchors are counted by hash; only those at two places matter.
2. Texts with such anchors are read again. For each anchor the stretch of text under the windows that
   it stands for is cut out, a segment. Equal segments are one, with a note that there were several.
3. Segments are brought together by anchor, several anchors to a block, and a caller's function says
   which windows of a block occur more than once. A window has one anchor, so it meets all its copies.
4. An anchor with more than ``most`` different segments is split: its windows by where the anchor
   stands in them, in halves. All windows of a half have more than the anchor in common (a longer core),
   and the halves are grouped by hashes of their cores; again and again, until windows themselves are the
   key and equal ones have become one row. So no group grows with the corpus, and nothing is left out.

Texts that are equal as a whole are only counted, and one of them is read. Null texts are empty. A
row per text comes out, so documents that share a text, or an id, are no special case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .text import _LAP, gram_hashes, mix, prepare, runs, slices, span_hashes, utf8, window_minima, word_offsets, words

#: Starts of windows that are looked at in one go.
PIECE = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)

#: Gets the segments of a block; says of each, for every start of a window, whether the window repeats.
Finder = Callable[[list[bytes]], list[np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """How texts are cut into units."""

    by_words: bool
    length: int
    gram: int
    block_bytes: int
    most: int

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, the number of each text's first one, and their starts and ends in bytes."""
        if self.by_words:
            starts, ends = words(data, offsets)
            return span_hashes(data, starts, ends), word_offsets(starts, offsets), starts, ends
        at = np.arange(len(data))
        return data, offsets, at, at + 1

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bytes:
        """Units ``a`` to ``b`` (exclusive) as bytes; words are joined by one space."""
        raw = data[starts[a] : ends[b - 1]].tobytes()
        return b" ".join(raw.split()) if self.by_words else raw

    def core(self, segment: bytes, a: int, b: int) -> bytes:
        return b" ".join(segment.split()[a:b]) if self.by_words else segment[a:b]


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes (a multiple of 8)."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    padded = np.ascontiguousarray(data)
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    n = len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        out = (out ^ mix(eight[k : k + n] + np.uint64(k))) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def anchor_runs(symbols: np.ndarray, first: np.ndarray, kind: Kind) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last start, anchor's place, its hash.

    Places are numbers of units over all texts.
    """
    width = kind.length - kind.gram + 1
    valid_starts = np.maximum(np.diff(first) - kind.length + 1, 0)
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(symbols) - kind.length + 1, PIECE):
        high = min(low + PIECE, len(symbols) - kind.length + 1)
        part = symbols[low : high + kind.length - 1]
        grams = gram_hashes(part, kind.gram) if kind.by_words else byte_grams(part, kind.gram)
        packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        place = (window_minima(packed, width) & _LOW).astype(np.int64)
        start = np.arange(high - low)
        text = np.searchsorted(first, start + low, side="right") - 1
        good = start + low < first[text] + valid_starts[text]
        start, text, place = start[good], text[good], place[good]
        if not len(start):
            continue
        change = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0) | (np.diff(start) != 1))
        begin, end = np.concatenate(([0], change + 1)), np.append(change, len(start) - 1)
        found.append((text[begin], start[begin] + low, start[end] + low, place[begin] + low, grams[place[begin]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), id, text (null as empty) and k1, k2, which stand for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), text.alias("text"), *keys)


def anchors(rows: DataFrame, kind: Kind) -> DataFrame:
    """(k1, k2, anchor, twice): the distinct anchors of each row's text, and whether it is there twice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                symbols, first, _, _ = kind.units(*utf8(part.column(2)))
                text, _, _, place, hashes = anchor_runs(symbols, first, kind)
                # A run that a piece's end has cut is one place all the same.
                _, fresh = np.unique(place, return_index=True)
                text, hashes = text[fresh], hashes[fresh]
                _, index, counts = np.unique(mix(hashes + text.astype(np.uint64) * _LAP), return_index=True, return_counts=True)
                owner = pa.array(text[index])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array(hashes[index].view(np.int64)), pa.array(counts > 1)],
                    names=["k1", "k2", "anchor", "twice"],
                )

    return rows.select("k1", "k2", "text").mapInArrow(find, "k1 bigint, k2 bigint, anchor bigint, twice boolean")


def _digest(*parts: bytes | int) -> bytes:
    return hashlib.md5(b"|".join(p if isinstance(p, bytes) else b"%d" % p for p in parts)).digest()


def segments(texts: DataFrame, kind: Kind) -> DataFrame:
    """(k1, k2, start, place, gid, sid, rel, segment) from texts and the anchors that matter in each.

    start: the segment's first unit in its text; rel: the anchor's place in the segment; gid: the
    anchor; sid: stands for segment and rel.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = utf8(part.column(2))
                symbols, first, starts, ends = kind.units(data, offsets)
                text, low, high, place, hashes = anchor_runs(symbols, first, kind)
                wanted = part.column(3)
                owner = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
                known = mix(wanted.flatten().to_numpy().view(np.uint64) + owner.astype(np.uint64) * _LAP)
                pick = np.isin(mix(hashes + text.astype(np.uint64) * _LAP), known)
                text, low, high, place, hashes = text[pick], low[pick], high[pick], place[pick], hashes[pick].view(np.int64)
                cut = [kind.segment(data, starts, ends, a, b + kind.length) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                rel = place - low
                sid = [_digest(r, c) for r, c in zip(rel.tolist(), cut, strict=True)]
                base, rows = first[text], pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(low - base), pa.array(place - base), pa.array(hashes), pa.array(sid, pa.binary()), pa.array(rel), pa.array(cut, pa.binary())],
                    names=["k1", "k2", "start", "place", "gid", "sid", "rel", "segment"],
                )

    return texts.select("k1", "k2", "text", "anchors").mapInArrow(make, "k1 bigint, k2 bigint, start bigint, place bigint, gid bigint, sid binary, rel bigint, segment binary")


def _n_units(segment: bytes, kind: Kind) -> int:
    return segment.count(b" ") + 1 if kind.by_words else len(segment)


def _split(contents: DataFrame, kind: Kind) -> DataFrame:
    """Of every segment the windows of either half of its offsets: as contents, with their parent and shift."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pgid", "psid", "shift", "gid", "sid", "segment", "rel", "low", "high", "several"]
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for r in batch.to_pylist():
                rel, n = r["rel"], _n_units(r["segment"], kind) - kind.length + 1
                middle = (r["low"] + r["high"]) // 2
                for a, b in ((r["low"], middle), (middle + 1, r["high"])):
                    least, most = max(a, rel - n + 1), min(b, rel)
                    if least > most:
                        continue
                    part = kind.core(r["segment"], rel - most, rel - least + kind.length)
                    group = int.from_bytes(_digest(a, b, kind.core(r["segment"], rel - a, rel - b + kind.length))[:8], "little", signed=True)
                    values = (r["gid"], r["sid"], rel - most, group, _digest(most, part), part, most, a, b, r["several"])
                    for name, value in zip(names, values, strict=True):
                        out[name].append(value)
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names=names)

    rows = contents.select("gid", "sid", "segment", "rel", "low", "high", "several")
    return rows.mapInArrow(halve, "pgid bigint, psid binary, shift bigint, gid bigint, sid binary, segment binary, rel bigint, low bigint, high bigint, several boolean")


def _search(contents: DataFrame, kind: Kind, finder: Finder) -> DataFrame:
    """(gid, sid, firsts, lasts): the runs of starts, in each segment, of windows that repeat."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, bool]] = []
        size, last = 0, None

        def result() -> pa.RecordBatch:
            firsts, lasts = [], []
            for (_, _, segment, several), flags in zip(held, finder([h[2] for h in held]), strict=True):
                if several:
                    flags = np.ones(_n_units(segment, kind) - kind.length + 1, bool)
                a, b = runs(flags, np.zeros(1, np.int64))
                firsts.append(a)
                lasts.append(b - 1)
            some = [k for k, a in enumerate(firsts) if len(a)]
            columns = [pa.array([held[k][0] for k in some], pa.int64()), pa.array([held[k][1] for k in some], pa.binary())]
            columns += [pa.array([c[k] for k in some], pa.list_(pa.int64())) for c in (firsts, lasts)]
            return pa.RecordBatch.from_arrays(columns, names=["gid", "sid", "firsts", "lasts"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= kind.block_bytes:
                    yield result()
                    held, size = [], 0
                held.append(row)
                last, size = row[0], size + len(row[2])
        if held:
            yield result()

    n = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = contents.select("gid", "sid", "segment", "several").repartition(n, "gid").sortWithinPartitions("gid")
    return rows.mapInArrow(search, "gid bigint, sid binary, firsts array<bigint>, lasts array<bigint>")


def _shifted(by: str) -> list:
    return [F.transform(name, lambda x: x + F.col(by)).alias(name) for name in ("firsts", "lasts")]


def _all_levels(contents: DataFrame, kind: Kind, finder: Finder) -> DataFrame:
    """The result of ``_search``; groups over ``kind.most`` are split until none is left."""
    hot = stage(contents.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > kind.most).select("gid"), "large-groups")
    if hot.isEmpty():
        return _search(contents, kind, finder)
    rest = _search(contents.join(hot, "gid", "left_anti"), kind, finder)
    parts = stage(_split(contents.join(hot, "gid"), kind), "halves")
    several = F.max("several") | (F.count_distinct("pgid", "psid") > 1)
    below = parts.groupBy("gid", "sid", "rel", "low", "high").agg(F.first("segment").alias("segment"), several.alias("several"))
    found = _all_levels(stage(below, "contents"), kind, finder)
    up = parts.select("pgid", "psid", "shift", "gid", "sid").join(found, ["gid", "sid"])
    return rest.union(up.select(F.col("pgid").alias("gid"), F.col("psid").alias("sid"), *_shifted("shift")))


def repeated_windows(rows: DataFrame, kind: Kind, finder: Finder) -> DataFrame:
    """(k1, k2, n, firsts, lasts): texts that occur n > 1 times, or have windows that start elsewhere too.

    ``rows`` is a result of ``keyed``; firsts and lasts are runs of the starts of such windows.
    """
    prepare(rows.sparkSession)
    counted = stage(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("rep")), "texts")
    placed = stage(anchors(rows, kind), "anchors")
    bounds = [f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]
    repeated = placed.groupBy("anchor").agg(*bounds, F.max("twice").alias("twice"))
    repeated = repeated.where("twice or min_k1 <> max_k1 or min_k2 <> max_k2").select("anchor")
    wanted = placed.join(repeated, "anchor").groupBy("k1", "k2").agg(F.collect_set("anchor").alias("anchors"))
    wanted = wanted.join(counted.select("k1", "k2", "rep"), ["k1", "k2"])
    texts = rows.select("k1", "k2", "id", "text").join(wanted, ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("rep")))
    made = stage(segments(texts, kind), "segments")
    occurrence = F.xxhash64("k1", "k2", "place")
    contents = made.groupBy("gid", "sid", "rel").agg(F.first("segment").alias("segment"), (F.min(occurrence) != F.max(occurrence)).alias("several"))
    contents = contents.withColumn("low", F.lit(0).cast("bigint")).withColumn("high", F.lit(kind.length - kind.gram).cast("bigint"))
    found = _all_levels(stage(contents, "contents"), kind, finder)
    placed_runs = made.select("k1", "k2", "start", "gid", "sid").distinct().join(found, ["gid", "sid"]).select("k1", "k2", *_shifted("start"))
    flat = [F.flatten(F.collect_list(name)).alias(name) for name in ("firsts", "lasts")]
    per_text = placed_runs.groupBy("k1", "k2").agg(*flat)
    return stage(counted.select("k1", "k2", "n").join(per_text, ["k1", "k2"], "left").where("n > 1 or firsts is not null"), "repeats")


def covered(n_units: int, n: int | None, firsts: np.ndarray | None, lasts: np.ndarray | None, length: int) -> np.ndarray:
    """Which units of a text lie in a window that starts elsewhere too."""
    if (n or 0) > 1 and n_units >= length:
        return np.ones(n_units, bool)
    change = np.zeros(n_units + 1, np.int64)
    if firsts is not None:
        np.add.at(change, firsts, 1)
        np.subtract.at(change, lasts + length, 1)
    return np.cumsum(change[:-1]) > 0
