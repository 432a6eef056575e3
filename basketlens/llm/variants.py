"""Spelling variants by blocked Gram matrices of letter counts.

Spark counts the words. Two words are near if one inserted, deleted or replaced code point turns one into the
other; their letter counts are then at a squared distance of two at most, and their lengths differ by one at
most. The words of one length are divided into cells by how many letters of each of a few letter classes they have: an edit
takes a word to a cell that is one step away at most, so a cell meets itself, the cells of its length that have one
letter less of one class and one more of another, and those of the next length with one more letter. Cells with many words are cut
into blocks of bounded size. A pair of blocks is a row; its task multiplies the letter counts of both (a Gram
matrix), keeps pairs at a squared distance of two at most and compares those letter by letter. Only each word's number of near words and the
best of them leave the task, not the pairs. No word and no pair is left out.

The number of classes grows with the logarithm of the vocabulary, so blocks stay small against it.

Null and empty texts have no words; a null id deletes nothing. Repeated rows count as often as they stand there. Words of any
length take part: blocks of long words hold fewer. Ties go to the word that is first by code point. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

LEAST_LETTERS = 6
LEAST_USES = 5
#: A word's form is so many times as frequent at least.
RATIO = 5
#: One run in so many loses a letter, by its hash.
NOISE = 199
#: Words, and code points of words, in a block.
BLOCK_WORDS, BLOCK_LETTERS = 1024, 1 << 17
#: Entries of a Gram matrix, and letters of candidate pairs, that a task holds at once.
ENTRIES = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = 256


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, uses: int = LEAST_USES, noise: int = NOISE) -> DataFrame:
    """(word, n): the words of at least ``letters`` code points that occur at least ``uses`` times."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))
    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (hashed % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    word = F.when(hashed % noise == 0, cut).otherwise(F.col("run"))
    counted = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.char_length("word") >= letters) & (F.col("n") >= uses))


def letter_classes(words: DataFrame, size: int) -> list[str]:
    """The letters of all words in ``max(2, log10(size))`` classes of about the same frequency; one row per letter reaches the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    often = [(row.n, row.letter) for row in letters.collect()]
    classes, loads = [""] * max(2, round(math.log10(max(size, 1)))), []
    loads = [0] * len(classes)
    for n, letter in sorted(often, key=lambda x: (-x[0], x[1])):
        least = loads.index(min(loads))
        classes[least] += letter
        loads[least] += n
    return classes


def _cell(classes: list[str]) -> Column:
    """How many letters of each class a word has."""
    return F.array(*(F.char_length("word") - F.char_length(F.translate("word", c, "")) if c else F.lit(0) for c in classes))


def blocks(words: DataFrame, classes: list[str]) -> DataFrame:
    """(cell, part, words, counts): the words of every cell, in blocks of at most about ``BLOCK_WORDS`` words."""
    placed = stage(words.withColumn("cell", _cell(classes)), "variant-cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max(F.char_length("word")).alias("letters"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_LETTERS) / F.col("letters"))))
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / most)))
    rows = dealt.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rows"))
    return rows.select("cell", "part", F.col("rows.word").alias("words"), F.col("rows.n").alias("counts"))


def block_pairs(table: DataFrame, n_classes: int) -> DataFrame:
    """Every two blocks whose cells are one step apart, once; a block also meets itself (the right side is null then)."""
    steps = [[0] * n_classes]
    for a in range(n_classes):
        steps.append([int(k == a) for k in range(n_classes)])
    for a, b in combinations(range(n_classes), 2):
        steps.append([1 if k == a else -1 if k == b else 0 for k in range(n_classes)])
    reached = F.array(*(F.array(*(F.col("cell")[k] + s for k, s in enumerate(step))) for step in steps))
    left = table.select(F.explode(reached).alias("meets"), "cell", "part", F.col("words").alias("words_a"), F.col("counts").alias("counts_a"))
    right = table.select(F.col("cell").alias("meets"), F.col("part").alias("part_b"), F.col("words").alias("words_b"), F.col("counts").alias("counts_b"))
    both = left.join(right, "meets").where((F.col("cell") != F.col("meets")) | (F.col("part") <= F.col("part_b")))
    same = (F.col("cell") == F.col("meets")) & (F.col("part") == F.col("part_b"))
    other = lambda name: F.when(~same, F.col(name)).alias(name)
    return both.select("words_a", "counts_a", other("words_b"), other("counts_b"))


def _matrix(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.array(words, dtype=f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def _letter_counts(points: np.ndarray) -> np.ndarray:
    n, length = points.shape
    rows = np.repeat(np.arange(n), length) * _LETTERS
    counts = np.bincount(rows + points.ravel(), minlength=n * _LETTERS).reshape(n, _LETTERS)
    # Sums of products stay exact in the type chosen.
    return counts.astype(np.float32 if length < 2000 else np.float64)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (as long, or one longer) are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    ahead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= short.shape[1]


def near_words(a: list[str], b: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the near words of two blocks, or of one with itself (each pair once)."""
    left = _matrix(a)
    right = left if b is None else _matrix(b)
    x = _letter_counts(left)
    y = x if b is None else _letter_counts(right)
    used = np.flatnonzero(x.any(0) | y.any(0))
    x, y = x[:, used], y[:, used]
    own, other = (x * x).sum(1), (y * y).sum(1)
    found_a, found_b = [], []
    step = max(1, ENTRIES // len(y))
    for start in range(0, len(x), step):
        distance = own[start : start + step, None] + other - 2 * (x[start : start + step] @ y.T)
        near_a, near_b = np.nonzero(distance <= 2)
        near_a = near_a + start
        if b is None:
            near_a, near_b = near_a[near_a < near_b], near_b[near_a < near_b]
        pairs = max(1, ENTRIES // right.shape[1])
        for k in range(0, len(near_a), pairs):
            i, j = near_a[k : k + pairs], near_b[k : k + pairs]
            sure = _one_edit(left[i], right[j])
            found_a.append(i[sure])
            found_b.append(j[sure])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a pair of blocks that has near words there: their number, and the best."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b = row["words_a"], row["words_b"]
            i, j = near_words(a, b)
            if not len(i):
                continue
            words = a if b is None else a + b
            counts = row["counts_a"] if b is None else row["counts_a"] + row["counts_b"]
            j = j if b is None else j + len(a)
            ends, others = np.concatenate((i, j)), np.concatenate((j, i))
            # By word, then the most frequent neighbour, then the first by code point.
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))] = np.arange(len(words))  # noqa: B023
            order = np.lexsort((rank[others], ends))
            ends, others = ends[order], others[order]
            _, first, size = np.unique(ends, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([words[k] for k in ends[first]], pa.string()),
                    pa.array(size.astype(np.int64)),
                    pa.array([words[k] for k in others[first]], pa.string()),
                    pa.array([counts[k] for k in others[first]], pa.int64()),
                ],
                names=["word", "n_near", "best", "best_n"],
            )


def near_table(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words of ``words`` (word, n; stored) that have a near word."""
    classes = letter_classes(words, words.count())
    pairs = block_pairs(stage(blocks(words, classes), "variant-blocks"), len(classes))
    found = pairs.mapInArrow(_best, "word string, n_near bigint, best string, best_n bigint")
    best = F.min_by(F.struct("best", "best_n"), F.struct(-F.col("best_n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", "b.best_n")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form; stored): the last word when forms are followed.

    A chain has at most ``longest`` steps; every pass doubles the steps taken.
    """
    table = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        ahead = table.select(F.col("word").alias("root"), F.col("root").alias("further"))
        table = stage(table.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "variant-roots")
    return table


def spelling_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = stage(vocabulary(docs), "vocabulary")
    near = words.join(near_table(words), "word", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    near = stage(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")),
        "variants",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    # Every step multiplies the count by ``ratio``.
    found = roots(near.where(F.col("form").isNotNull()), int(math.log(most, ratio)) + 1)
    joined = near.join(found, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
