"""Substring dedup by relative Lempel-Ziv parsing: words in passages that occur more than once are removed.

``repeats`` brings candidate segments together in blocks; a block is the reference for the segments
in it, and holds every other copy of their windows. Its suffix order is the index. A segment is parsed greedily
from left to right: a factor is the longest match of what starts there with any other place of the
reference. At the factor's end the next one is looked for among the starts inside: the first whose match passes that end, found by
bisection, as no later start matches less far. So a factor of ``LENGTH`` words or more is a duplicate span, windows across its end
belong to the next factor or to none, and only a few starts of each factor are looked up.

Words are compared as they are, not by hashes; matches never cross documents. Null texts have no words. Repeated rows are
repeats of each other. Texts of fewer words than the window lose nothing. A text of any length is cut into segments of at
most ``2 * LENGTH`` words where it has candidates.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Kind, covered, keyed, repeated_windows

LENGTH = 35


class Reference:
    """A block of words with an index for longest matches.

    ``ranks[h]`` orders all grams of ``h`` symbols, for h = 1, 2, 4, ... up to the longest segment: equal ranks are equal grams. The last of
    them is the suffix order, since every segment ends with a symbol of its own.
    """

    def __init__(self, symbols: np.ndarray, longest: int):
        self.ranks, h = {1: symbols}, 1
        while h < longest:
            half = self.ranks[h]
            following = np.concatenate((half[h:] + 1, np.zeros(min(h, len(half)), np.int64)))
            self.ranks[2 * h] = np.unique(half * (int(half.max()) + 2) + following, return_inverse=True)[1]
            h *= 2
        self.order = np.argsort(self.ranks[h], kind="stable")
        self.rank = np.empty(len(symbols), np.int64)
        self.rank[self.order] = np.arange(len(symbols))

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of symbols that what starts at ``x`` and at ``y`` has in common."""
        common = np.zeros(len(x), np.int64)
        last = len(self.order) - 1
        for h in sorted(self.ranks, reverse=True):
            # No match reaches the last symbol, which is an end.
            i, j = np.minimum(x + common, last), np.minimum(y + common, last)
            common += h * ((self.ranks[h][i] == self.ranks[h][j]) & (i != j))
        return common

    def reach(self, at: np.ndarray) -> np.ndarray:
        """Where the longest match of each place with any other place ends (exclusive): that one is next to it in the order."""
        rank = self.rank[at]
        before = self._common(at, self.order[np.maximum(rank - 1, 0)])
        after = self._common(at, self.order[np.minimum(rank + 1, len(self.order) - 1)])
        return at + np.maximum(before, after)


def _next_factor(reference: Reference, begin: np.ndarray, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first start after each factor's ``begin`` whose match passes its ``end``, or that end; at most ``stop``."""
    low, high = begin + 1, np.minimum(np.maximum(end, begin + 1), stop)
    while len(still := np.flatnonzero(low < high)):
        middle = (low[still] + high[still]) // 2
        passes = reference.reach(middle) > end[still]
        high[still[passes]] = middle[passes]
        low[still[~passes]] = middle[~passes] + 1
    return low


def repeated_starts(segments: list[bytes]) -> list[np.ndarray]:
    """For each segment and start of a window in it, whether the window occurs more than once here."""
    numbers: dict[bytes, int] = {}
    parts = [[numbers.setdefault(w, len(numbers)) for w in s.split(b" ")] for s in segments]
    sizes = np.array([len(p) for p in parts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    symbols = np.empty(offsets[-1], np.int64)
    border = np.zeros(offsets[-1], bool)
    border[offsets[1:] - 1] = True
    symbols[~border] = np.fromiter(itertools.chain.from_iterable(parts), np.int64, int(sizes.sum()))
    symbols[border] = np.arange(len(numbers), len(numbers) + len(segments))
    reference = Reference(symbols, int(sizes.max()) + 1)

    # All segments are parsed side by side, a factor each at a time.
    at, stop = offsets[:-1].copy(), offsets[:-1] + sizes - LENGTH + 1
    change = np.zeros(offsets[-1] + 1, np.int64)
    while len(live := np.flatnonzero(at < stop)):
        begin = at[live]
        end = reference.reach(begin)
        following = _next_factor(reference, begin, end, stop[live])
        windows = np.minimum(following, end - LENGTH + 1)  # those up to the next factor that lie in this one
        long = windows > begin
        np.add.at(change, begin[long], 1)
        np.subtract.at(change, windows[long], 1)
        at[live] = following
    flags = np.cumsum(change[:-1]) > 0
    return [flags[x:y] for x, y in zip(offsets[:-1].tolist(), stop.tolist(), strict=True)]


KIND = Kind(by_words=True, length=LENGTH, gram=8, block_bytes=4 << 20, most=8192)


def removed_passages(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), kept (words joined by spaces), n_words and n_removed of every document."""
    rows = keyed(docs)
    found = repeated_windows(rows, KIND, repeated_starts)
    joined = rows.join(found, ["k1", "k2"], "left")

    def strip(texts: pa.Array, n: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for text, count, a, b in zip(texts, n, firsts, lasts, strict=True):
            own = text.as_py().encode().split()
            gone = 0
            kept = own
            if count.as_py() is not None:
                runs_ = (None, None) if not a.is_valid else (a.values.to_numpy(), b.values.to_numpy())
                flags = covered(len(own), count.as_py(), *runs_, LENGTH)
                kept = [w for w, f in zip(own, flags.tolist(), strict=True) if not f]
                gone = int(flags.sum())
            joined_words = b" ".join(kept)
            out.append((joined_words.decode(), len(own), gone, hashlib.sha256(joined_words).hexdigest()))
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
        return pa.StructArray.from_arrays(columns, names=["kept", "n_words", "n_removed", "kept_sha256"])

    schema = "struct<kept:string,n_words:bigint,n_removed:bigint,kept_sha256:string>"
    return joined.select("row", F.arrow_udf(strip, schema)("text", "n", "firsts", "lasts").alias("s")).select("row", "s.*")
