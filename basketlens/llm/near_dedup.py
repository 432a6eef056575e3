"""Near duplicates by MinHash bands, verified by odd sketches and then on full shingle sets.

A document's set is its distinct ``SHINGLE``-word shingles. Documents with the same word sequence are
one class; the rest works on classes. Each has ``BANDS`` x ``ROWS`` MinHash samples, whose bands are
the buckets, and one more from each of ``BINS`` bins of a single hash (none from an empty bin). Those are folded by
parity into ``64 * SKETCH`` bits, the odd sketch. The XOR of two sketches has at most as many bits as the samples differ in,
so its population count estimates a high similarity precisely: sets much smaller than the bins differ in
hardly more samples than shingles. ``sketch_limit`` leaves five standard deviations. What passes is compared on full sets.

No bucket is expanded into pairs. (1) Every class is held against the smallest class of each of its
buckets; the best of these is verified, then those that are still in other components: most groups are one
component after that. (2) In buckets that still
hold several components, classes outside the largest one meet the others of the bucket in a join whose condition
is the sketch, so only likely pairs come out; each class's best per component is verified, (3) then all that
are still in different components. No cap is set anywhere. Sets of unequal size (one below the threshold's share of the other) are no candidates.

Texts without words have no set and link with nothing. Null ids: such a row can be in a component, its
component_id is the smallest id there, null if there is none; it counts as kept then. Rows with one id and one
text are one document. A component is known by its smallest doc_id. ``dedup_near`` goes by the component itself and
keeps one document of each, also where ids are null or shared. Extra columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .storage import components, extended, large_side, relabelled, small_side
from .text import _LAP, gram_hashes, grouped, lower_ascii, mix, prepare, slices, span_hashes, text_key, utf8, word_offsets, words

SHINGLE = 2
THRESHOLD = 80  # percent
BANDS, ROWS = 50, 5
SAMPLES = BANDS * ROWS
SKETCH = 64  # 64-bit words
BINS = 1 << 13
#: Bits of a sample that tell it from others of its bin, and sets that are sketched at once.
_RANK, _STEP = 38, 256
SLACK = 5.0
#: Bytes of text that are hashed at once, and rows of a table that is broadcast; its rows are ids and keys of fixed size.
SLICE, WANTED = 256 << 10, 100_000
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64, SAMPLES, np.uint64) | np.uint64(1)


def sketch_limit(size_a: Column, size_b: Column, threshold: int = THRESHOLD) -> Column:
    """Most bits in which the sketches of two sets of these sizes differ if they are linked, ``SLACK`` deviations included."""
    j, bits = threshold / 100, 64 * SKETCH
    total = (size_a + size_b).cast("double")
    apart, union = total * ((1 - j) / (1 + j)), total / (1 + j)
    # A shingle of one set only differs where it is the least of its bin, and twice where the other set has one there.
    least = F.lit(BINS) / union * (1 - F.exp(-union / BINS))
    shared = 1 - F.exp(-F.greatest(size_a, size_b) / F.lit(BINS))
    spread = F.sqrt(apart * least * ((1 + shared) ** 2 * (1 - least) + shared * (1 - shared)))
    samples = apart * least * (1 + shared) + SLACK * spread + 2
    load = 4 * samples / bits
    parities = bits / 2 * (1 - F.exp(-load / 2)) + SLACK * F.sqrt(bits / 4 * (1 - F.exp(-load) * (1 + load)))
    return F.least(samples, parities)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, text by text, and how many each has."""
    n = len(offsets) - 1
    data = lower_ascii(data)
    starts, ends = words(data, offsets)
    first = word_offsets(starts, offsets)
    hashes, n_words = span_hashes(data, starts, ends), np.diff(first)
    grams = gram_hashes(hashes, size)
    counts = np.maximum(n_words - size + 1, 0)
    values, owner = grams[grouped(first[:-1], counts)], np.repeat(np.arange(n), counts)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    whole = np.array([gram_hashes(np.append(hashes[first[k] : first[k + 1]], np.uint64(size)), n_words[k] + 1)[0] for k in short], np.uint64)
    values, owner = np.concatenate((values, whole)), np.concatenate((owner, short))
    _, index = np.unique(mix(values + owner.astype(np.uint64) * _LAP), return_index=True)
    index = index[np.argsort(owner[index], kind="stable")]
    return values[index], np.bincount(owner[index], minlength=n)[:n]


def minhashes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of samples per set; sets must not be empty."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), SAMPLES), np.uint64)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(values * factor, starts)
    return out


def odd_sketch(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of 64-bit words per set: the parity of the samples, one per bin, that fall on each bit."""
    bits, first = np.uint64(64 * SKETCH), np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros((len(counts), SKETCH), np.int64)
    for start in range(0, len(counts), _STEP):
        own = values[first[start] : first[min(start + _STEP, len(counts))]]
        owner = np.repeat(np.arange(len(counts[start : start + _STEP])), counts[start : start + _STEP])
        spread = mix(own ^ _LAP)
        place = owner.astype(np.uint64) * np.uint64(BINS) + spread % np.uint64(BINS)
        ranked = np.sort((place << np.uint64(_RANK)) | (spread >> np.uint64(64 - _RANK)))
        place = ranked >> np.uint64(_RANK)
        least = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
        sample, owner = ranked[least] & np.uint64((BINS << _RANK) - 1), place[least] // np.uint64(BINS)
        bit = (owner * bits + mix(sample) % bits).astype(np.int64)
        rows = len(counts[start : start + _STEP])
        parity = np.bincount(bit, minlength=rows * int(bits)).astype(np.uint8) & np.uint8(1)
        out[start : start + rows] = np.packbits(parity.reshape(rows, -1), axis=1).view(np.int64)
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _LAP
    for r in range(ROWS):
        out = mix(out + samples[:, r::ROWS])
    return out.view(np.int64)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, key, class, n_shingles, sketch, bands) of every row; without words the last two are empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw = part.column(2).cast(pa.binary())
                classes = [hashlib.md5(b" ".join((t.as_py() or b"").lower().split())).digest() for t in raw]
                values, counts = shingle_sets(*utf8(part.column(2)), size)
                some = counts > 0
                samples = minhashes(values, counts[some]) if some.any() else np.zeros((0, SAMPLES), np.uint64)
                listed = lambda a, width, some=some: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * width))).astype(np.int32)), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(classes, pa.binary()), pa.array(counts.astype(np.int64)), listed(odd_sketch(values, counts[some]), SKETCH), listed(band_hashes(samples), BANDS)],
                    names=["doc_id", "key", "class", "n_shingles", "sketch", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(sign, "doc_id bigint, key binary, class binary, n_shingles bigint, sketch array<bigint>, bands array<bigint>")


def _classes(signed: DataFrame) -> DataFrame:
    """(class, id, doc_id, key, n, sketch words, bands): one row per word sequence; id is unique."""
    found = signed.where("n_shingles > 0").groupBy("class").agg(F.min_by(F.struct("doc_id", "key", "n_shingles", "sketch", "bands"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("r"))
    found = stage(found.select("class", "r.*"), "classes")
    # An id that several texts bear, or none, is replaced by a negative number.
    twice = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("class").alias("first")).where("n > 1")
    twice = small_side(stage(twice.select(F.col("doc_id").alias("twice_id"), "first"), "shared-ids"))
    plain = found.join(twice, found["doc_id"] == F.col("twice_id"), "left")
    given = F.col("doc_id").isNotNull() & (F.col("twice_id").isNull() | (F.col("class") == F.col("first")))
    node = F.when(given, F.col("doc_id")).otherwise(-1 - F.monotonically_increasing_id() - F.lit(1 << 62))
    sketch = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]
    return stage(plain.select("class", node.alias("id"), "doc_id", "key", "n_shingles", *sketch, "bands"), "class-ids")


def _bits(a: str, b: str) -> Column:
    total = F.lit(0)
    for k in range(SKETCH):
        total = total + F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
    return total


def _likely(a: str, b: str, threshold: int) -> Column:
    """Whether two classes can be linked, by their sizes and then their sketches."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(x, y) >= threshold * F.greatest(x, y)) & (_bits(a, b) <= sketch_limit(x, y, threshold))


class _Verifier:
    """Confirms pairs (a, b) of class ids on full sets; keeps the sets it has read."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, threshold: int):
        self.docs, self.classes, self.size, self.threshold = docs, classes, size, threshold
        self.sets: DataFrame | None = None

    def read(self, pairs: DataFrame) -> None:
        """Read the sets of all ends of ``pairs`` that are not known yet: one scan of the texts."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        if self.sets is not None:
            ids = ids.join(large_side(self.sets.select("id")), "id", "left_anti")
        wanted = self.classes.select("id", F.col("doc_id").alias("rep"), F.col("key").alias("rep_key")).join(large_side(ids), "id")
        wanted = small_side(stage(wanted, "wanted-texts"), WANTED)
        rows = self.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
        rows = rows.join(wanted, (F.col("key") == F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("id", "text")
        size = self.size

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    values, counts = shingle_sets(*utf8(part.column(1)), size)
                    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column(0), listed], names=["id", "shingles"])

        found = rows.mapInArrow(read, "id bigint, shingles array<bigint>").dropDuplicates(["id"])
        found = stage(found, "sets")
        self.sets = found if self.sets is None else self.sets.union(found)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` that are linked, a stored table; their sets must have been read."""
        side = lambda name: large_side(self.sets.select(F.col("id").alias(name), F.col("shingles").alias(f"set_{name}")))
        both = pairs.join(side("b"), "b").join(side("a"), "a")
        common, sizes = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
        return stage(both.where(100 * common >= self.threshold * (sizes - common)).select(*pairs.columns), "linked")


def _labelled(table: DataFrame, found: DataFrame, column: str, label: str) -> DataFrame:
    return relabelled(table.withColumn(label, F.col(column)), found, label)


def _merged(found: DataFrame, linked: DataFrame) -> DataFrame:
    """``found`` after links between members of the components ``label_a`` and ``label_b``."""
    return extended(found, components(linked.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))))


def linked_classes(docs: DataFrame, classes: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(id, component) of every class that is linked with a smaller one: its component by confirmed links. Each step goes on from the components before."""
    sketches = classes.select("id", "n_shingles", *(f"s{k}" for k in range(SKETCH)))
    banded = classes.select(F.explode("bands").alias("bucket"), "id")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1")
    members = stage(banded.join(large_side(buckets.select("bucket", "center")), "bucket"), "buckets")
    verifier = _Verifier(docs, classes, size, threshold)

    stars = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(large_side(sketches).alias("x"), F.col("a") == F.col("x.id")).join(large_side(sketches).alias("y"), (F.col("b") == F.col("y.id")) & _likely("x", "y", threshold))
    stars = stage(stars.select("a", "b", _bits("x", "y").alias("bits")), "stars")
    verifier.read(stars)
    best = stage(stars.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b"), "best")
    # A class has one link to a smaller one at most, so these are trees.
    found = components(verifier.confirm(best))
    # The other smallest classes of its buckets, where the best one has not brought them together.
    others = _labelled(_labelled(stars.select("a", "b").join(large_side(best), ["a", "b"], "left_anti"), found, "a", "label_a"), found, "b", "label_b")
    others = stage(others.where("label_a <> label_b"), "other-stars")
    if not others.isEmpty():
        found = _merged(found, verifier.confirm(others))

    # Buckets with several components; all but the largest one meet the whole bucket.
    labelled = stage(_labelled(members.select("bucket", "id"), found, "id", "label"), "bucket-labels")
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")).where("labels > 1")
    open_ = stage(labelled.join(large_side(mixed.select("bucket", "main")), "bucket"), "open-buckets").join(large_side(classes.select("bands", *sketches.columns)), "id")
    x, y = open_.where("label <> main").alias("x"), large_side(open_).alias("y")
    crossing = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & _likely("x", "y", threshold)
    crossing = crossing & ((F.col("y.label") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    # Once per pair, in one of the buckets it shares.
    crossing = crossing & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket"))
    pairs = x.join(y, crossing).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), _bits("x", "y").alias("bits"))
    pairs = stage(pairs.join(large_side(stars.select("a", "b")), ["a", "b"], "left_anti"), "crossing")
    if pairs.isEmpty():
        return found
    verifier.read(pairs)
    marked = _labelled(_labelled(pairs, found, "a", "label_a"), found, "b", "label_b")
    labels = ["label_a", "label_b"]
    ends = marked.select("a", "b", "bits", *labels, F.col("a").alias("end"), F.col("label_b").alias("other")).union(marked.select("a", "b", "bits", *labels, F.col("b").alias("end"), F.col("label_a").alias("other")))
    nearest = ends.groupBy("end", "other").agg(F.min_by(F.struct("a", "b", *labels), F.struct("bits", "a", "b")).alias("p"))
    nearest = stage(nearest.select("p.*").distinct(), "nearest")
    found = _merged(found, verifier.confirm(nearest))
    rest = _labelled(_labelled(pairs.join(large_side(nearest), ["a", "b"], "left_anti"), found, "a", "label_a"), found, "b", "label_b")
    rest = stage(rest.where("label_a <> label_b"), "rest")
    return found if rest.isEmpty() else _merged(found, verifier.confirm(rest))


def _members(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, first) of every row of ``docs``; first is the (none, doc_id, key) that stands for its component, null without words."""
    prepare(docs.sparkSession)
    signed = stage(signatures(docs, size), "signatures")
    classes = _classes(signed)
    found = linked_classes(docs, classes, size, threshold)
    labelled = _labelled(classes.select("class", "id", "doc_id", "key"), found, "id", "label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("first"))
    per_class = labelled.join(large_side(smallest), "label").select("class", "component_id", "first")
    rows = signed.select("doc_id", "key", "class", "n_shingles")
    joined = rows.where("n_shingles > 0").join(large_side(per_class), "class").select("doc_id", "key", "n_shingles", "component_id", "first")
    alone = F.lit(None).cast(joined.schema["first"].dataType)
    return joined.union(rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id"), alone.alias("first")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept) of every row of ``docs``."""
    return _members(docs, size, threshold).drop("first").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def dedup_near(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` that are the first of their component by (doc_id, text key), null ids last, with all their columns.

    Rows with one id and one text are one document and stay together; those without an id are copies, of which one stays.
    """
    stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    gone = _members(docs, size, threshold).where(F.col("first").isNotNull() & ~stands).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    gone = small_side(stage(gone, "near-duplicates"), WANTED)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("id"), text_key(F.col("text")).alias("key"))
    rows = rows.join(gone, (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    if docs.where(F.col("doc_id").cast("bigint").isNull()).isEmpty():
        return rows.select("row.*")
    copies = F.col("id").isNull() & F.coalesce(F.col("row.text").rlike(r"[^ \t\n\x0b\f\r]"), F.lit(False))
    others = F.to_json(F.struct(F.lit(0), *(F.col(f"row.`{c}`") for c in docs.columns if c != "text")))
    once = rows.where(copies).groupBy("key").agg(F.min_by("row", others).alias("row"))
    return rows.where(~copies).select("row.*").union(once.select("row.*"))
