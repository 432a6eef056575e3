"""Suffix-array dedup: bytes covered by long strings that occur more than once are removed.

``repeats`` brings candidate segments together in blocks. In a block, text is parsed at trigger
grams into phrases none of which begins another, so suffixes of the phrase sequence order like suffixes of
the bytes, with a fraction of the symbols. The suffix array is built by grouping: suffixes start in groups by first
symbol; groups are taken in descending order, each suffix finds the nearest earlier one in a smaller group by the
pointers already there, and the suffixes pointed to move behind their group, those pointed to more
often further. Groups then are equal Lyndon prefixes in order; one pass over the sorted suffixes emits each
group's order. Nothing is renamed or solved again. Neighbours in the array and the bytes before a trigger
tell which windows are equal.

Matches never cross documents; null texts are empty. Removed bytes can split a character, so what is kept is binary.
Repeated rows are repeats of each other. Texts shorter than the window lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Kind, covered, keyed, repeated_windows
from .text import gram_hashes, mix

LENGTH = 400
TRIGGER = 8
#: Mean bytes in a phrase.
PHRASE = np.uint64(64)


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of all suffixes in order; symbols are 0, 1, ... without gaps."""
    n = len(symbols)
    if not n:
        return []
    first = np.asarray(symbols)
    order = np.argsort(first, kind="stable")
    begin = np.searchsorted(first[order], np.arange(first.max() + 2))
    group: list[int] = begin[first].tolist()  # the place of a suffix's group in the array
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    array, place = order.tolist(), place.tolist()
    size = [0] * n
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b > a:
            size[a] = b - a
    smaller = [-1] * n  # nearest earlier suffix in a smaller group
    end = n
    while end:
        low = group[array[end - 1]]
        pointed: dict[int, int] = {}
        for s in sorted(array[low:end]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, count in pointed.items():
            by_count.setdefault(count, []).append(p)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[count]:
                g = group[p]
                last = g + size[g] - 1
                other, at = array[last], place[p]
                array[at], place[other] = other, at
                array[last], place[p] = p, last
                size[g] = last - g
                moved[g] = moved.get(g, 0) + 1
            for p in by_count[count]:
                group[p] += size[group[p]]
            for g, count_moved in moved.items():
                size[g + size[g]] = count_moved
        end = low
    # Every suffix, when its turn comes, places those whose Lyndon prefix ends where it begins.
    out, done = [0] * n, bytearray(n)
    free = list(range(n))
    for rank in range(-1, n):
        s = (out[rank] if rank >= 0 else n) - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = smaller[s]
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, zeros past the end."""
    padded = np.concatenate((data, np.zeros(16 + LENGTH, np.uint8)))
    return np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()


def _common(eights: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes from x and from y on are equal, up to the limits."""
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(limit > 0)
    step = 0
    while len(live):
        differ = eights[x[live] + step] ^ eights[y[live] + step]
        stop = differ != 0
        lowest = differ[stop] & (~differ[stop] + np.uint64(1))
        out[live] = step + 8
        out[live[stop]] = step + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        step += 8
        live = live[~stop & (limit[live] > step)]
    return np.minimum(out, limit)


def _phrases(data: np.ndarray, offsets: np.ndarray, triggers: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Where each phrase starts (separators: -1), and their symbols; every segment ends with its own separator."""
    starts = np.union1d(offsets[:-1], triggers)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    next_start = np.append(starts[1:], offsets[-1])
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(last, offsets[owner + 1], next_start + TRIGGER)
    raw = data.tobytes()
    phrases = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    # Within equal bytes, the phrase that ends its segment comes first: it is followed by a separator.
    keys = [(p, not e) for p, e in zip(phrases, last.tolist(), strict=True)]
    n_segments = len(offsets) - 1
    rank = {k: n_segments + i for i, k in enumerate(sorted(set(keys)))}
    where, symbols = np.full(len(starts) + n_segments, -1, np.int64), np.empty(len(starts) + n_segments, np.int64)
    at = np.arange(len(starts)) + owner
    where[at], symbols[at] = starts, [rank[k] for k in keys]
    symbols[np.flatnonzero(last) + owner[last] + 1] = owner[last]
    return where, symbols.tolist()


def repeated_starts(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment and start of a window in it, whether the window occurs more than once here."""
    sizes = np.array([len(s) for s in segments], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(segments), np.uint8)
    eights = _eights(data)
    flags = np.zeros(len(data), bool)
    ends = np.repeat(offsets[1:], sizes)
    at = np.arange(len(data))
    triggers = np.flatnonzero((mix(eights[: len(data)]) % PHRASE == 0) & (at + TRIGGER <= ends))
    owner = np.searchsorted(offsets, triggers, side="right") - 1
    before = np.concatenate(([-1], triggers[:-1]))
    before = np.maximum(before, offsets[owner] - 1)

    if len(triggers):
        where, symbols = _phrases(data, offsets, triggers)
        is_trigger = np.zeros(len(data) + 1, bool)
        is_trigger[triggers] = True
        order = where[np.array(suffix_array(symbols))]
        order = order[(order >= 0) & is_trigger[order]]
        number = np.empty(len(data), np.int64)
        number[triggers] = np.arange(len(triggers))
        left = ends[order] - order
        common = np.zeros(len(order), np.int64)
        common[1:] = _common(eights, order[:-1], order[1:], np.minimum(np.minimum(left[:-1], left[1:]), LENGTH))
        # A window whose first trigger is at distance d: d bytes before the trigger, the rest after it.
        furthest = np.minimum(order - before[number[order]] - 1, LENGTH - TRIGGER)
        nearest = LENGTH - left
        live, hashes = np.arange(len(order)), np.zeros(len(order), np.uint64)
        d = 0
        while len(live):
            run = np.cumsum(common < LENGTH - d)[live]
            now = nearest[live] <= d
            keys = mix(hashes[now] + run[now].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            flags[order[live[now]][counts[inverse] > 1] - d] = True
            d += 1
            stay = furthest[live] >= d
            live, hashes = live[stay], hashes[stay]
            hashes = mix(hashes * np.uint64(0x100000001B3) + data[order[live] - d].astype(np.uint64) + np.uint64(1))

    # Windows without a trigger: low variety, or rare chance. They are compared as a whole.
    following = np.append(triggers, np.iinfo(np.int64).max // 2)[np.searchsorted(triggers, at)]
    bare = np.flatnonzero((at + LENGTH <= ends) & (following > at + LENGTH - TRIGGER))
    if len(bare):
        keys = gram_hashes(eights[bare], 1)
        for k in range(8, LENGTH, 8):
            keys = mix(keys * np.uint64(0x100000001B3) + eights[bare + k])
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        flags[bare[counts[inverse] > 1]] = True
    return [flags[a : max(a, b - LENGTH + 1)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


KIND = Kind(by_words=False, length=LENGTH, gram=64, block_bytes=1 << 20, most=4096)


def removed_bytes(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), kept (binary), n_bytes, n_removed and n_spans of every document."""
    rows = keyed(docs)
    found = repeated_windows(rows, KIND, repeated_starts)
    joined = rows.join(found, ["k1", "k2"], "left")

    def strip(texts: pa.Array, n: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for text, count, a, b in zip(texts, n, firsts, lasts, strict=True):
            raw = text.as_py().encode()
            if count.as_py() is None:
                out.append((raw, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            runs_ = (None, None) if not a.is_valid else (a.values.to_numpy(), b.values.to_numpy())
            gone = covered(len(raw), count.as_py(), *runs_, LENGTH)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
            out.append((kept, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
        return pa.StructArray.from_arrays(columns, names=["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "struct<kept:binary,n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>"
    return joined.select("row", F.arrow_udf(strip, schema)("text", "n", "firsts", "lasts").alias("s")).select("row", "s.*")
