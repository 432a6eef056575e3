"""Benchmark decontamination by winnowing; DataFrame functions only.

Of every ``SPAN - GRAM + 1`` consecutive ``GRAM``-word grams the one with the smallest hash is a fingerprint (all of them at a tie), so
any two equal passages of ``SPAN`` words share a fingerprint at the same place. Documents' fingerprints are joined with
those of the benchmark, each with the words around it, and a hit is extended to both sides while the words are equal, as far as a
passage of ``SPAN`` words around it can reach: longer passages have further fingerprints. What is ``SPAN`` words or longer is
a leak; words decide, not hashes. Items of fewer words hold no such passage: they are compared as wholes with all
grams of their length, one pass per length there is (below ``SPAN``).

Only hits leave the scan, by text, so copies are reported once and joined back. The benchmark's fingerprints are broadcast
if their measured bytes allow, else joined by shuffle.

Null and empty texts have no words: such documents are clean, such items occur nowhere. An item without an id marks words but
is not listed; equal item ids count once. Equal texts get equal results, repeated rows included. Long texts are worked on whole. Extra columns are
carried along in ``row``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .storage import BROADCAST_ROWS, small_bytes, small_side

SPAN = 10
GRAM = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def compared_words(text: Column) -> Column:
    """The words of a text with A-Z lowered; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2: stand for a whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("2"), text)})


def fingerprints(rows: DataFrame, *keys: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(keys, hash, pos, context) of the rows' ``words``: the grams chosen, and the words from ``span - gram`` before to as many after, null beyond the text."""
    around = span - gram
    # No filter here: it would be pushed below and split the texts a second time. Too short texts have null arrays.
    # Elements are taken one by one, as slice() copies its whole array.
    enough = lambda made: F.when(F.size("words") >= span, made)
    gram_hash = lambda i: F.xxhash64(*(F.col("words")[i + k] for k in range(gram)))
    rows = rows.withColumn("grams", enough(F.transform(F.sequence(F.lit(0), F.size("words") - gram), gram_hash)))
    least = F.transform(F.sequence(F.lit(0), F.size("grams") - 1 - around), lambda j: F.least(*(F.col("grams")[j + k] for k in range(around + 1))))
    rows = rows.withColumn("least", enough(least))
    # A gram is chosen if it is the least of a window it lies in: those windows begin up to ``around`` before it.
    places = enough(F.sequence(F.lit(0), F.size("grams") - 1))
    chosen = F.filter(places, lambda i: F.col("grams")[i] == F.greatest(*(F.get("least", i - k) for k in range(around + 1))))
    context = lambda i: F.array(*(F.get("words", i + k) for k in range(-around, span)))
    marks = F.transform(chosen, lambda i: F.struct(F.col("grams")[i].alias("hash"), i.alias("pos"), context(i).alias("context")))
    return rows.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*")


def _reach(steps: list[Column]) -> Column:
    """How many of ``steps`` hold from the first on."""
    return reduce(lambda further, step: F.when(step, further + 1).otherwise(F.lit(0)), reversed(steps), F.lit(0))


def long_leaks(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(k1, k2, start, stop, item): shared passages of ``span`` words and more; docs (k1, k2, words), items (item, words)."""
    around = span - gram
    prints = fingerprints(items, "item", span=span, gram=gram).select("item", "hash", F.col("context").alias("context_b")).distinct()
    prints = small_bytes(stage(prints, "benchmark-fingerprints"), F.octet_length(F.concat_ws(" ", "context_b")))
    hits = fingerprints(docs, "k1", "k2", span=span, gram=gram).join(prints, "hash")
    same = lambda k: F.coalesce(F.col("context")[around + k] == F.col("context_b")[around + k], F.lit(False))
    hits = hits.where(reduce(lambda a, b: a & b, [same(k) for k in range(gram)]))
    hits = hits.withColumn("before", _reach([same(-k) for k in range(1, around + 1)]))
    hits = hits.withColumn("after", _reach([same(gram - 1 + k) for k in range(1, around + 1)]))
    hits = hits.where(F.col("before") + gram + F.col("after") >= span)
    return hits.select("k1", "k2", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + gram - 1 + F.col("after")).alias("stop"), "item")


def _whole_grams(n: int) -> Column:
    """All grams of ``n`` words: (start, phrase)."""
    phrase = lambda i: F.concat_ws(" ", *(F.col("words")[i + k] for k in range(n)))
    places = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.struct(i.alias("start"), phrase(i).alias("phrase")))


def short_leaks(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame | None:
    """The same for items of fewer words, as wholes; None if there are none."""
    whole = items.where((F.size("words") > 0) & (F.size("words") < span))
    whole = stage(whole.select("item", F.size("words").alias("size"), F.concat_ws(" ", "words").alias("phrase")).distinct(), "short-items")
    sizes = sorted(row["size"] for row in whole.select("size").distinct().collect())  # at most span - 1
    if not sizes:
        return None
    grams = [_whole_grams(n) for n in sizes]
    found = docs.select("k1", "k2", F.explode(F.concat(*grams)).alias("g")).select("k1", "k2", "g.*")
    found = found.join(small_bytes(whole, F.octet_length("phrase")), "phrase")
    return found.select("k1", "k2", "start", (F.col("start") + F.col("size") - 1).alias("stop"), "item")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k1, k2, start, stop, item), a stored table: passages of texts, in words from 0, that stand in an item, too."""
    items = stage(benchmark.select(F.col("item_id").cast("string").alias("item"), compared_words(F.col("text")).alias("words")), "benchmark-words")
    texts = _keyed(docs.select("text")).select("k1", "k2", compared_words(F.col("text")).alias("words"))
    found, short = long_leaks(texts, items), short_leaks(texts, items)
    found = found if short is None else found.union(short)
    return stage(found.distinct(), "leaks")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = leaks(docs, benchmark)
    per_text = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    # Spans by start: each adds the words beyond the furthest stop so far.
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("last")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"] - 1, acc["last"]))).alias("n"),
            F.greatest(acc["last"], s["stop"]).alias("last"),
        ),
        lambda acc: acc["n"],
    )
    digest = lambda listed: F.sha2(F.concat_ws(",", listed).cast("binary"), 256)
    per_text = per_text.select("k1", "k2", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), digest(F.col("items")).alias("items_sha256"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    rows = _keyed(docs.select(row, "text")).select("row", "k1", "k2", F.size(words).cast("bigint").alias("n_words"))
    # A row per leaking text, of fixed size.
    joined = rows.join(small_side(stage(per_text, "leaking-texts"), BROADCAST_ROWS), ["k1", "k2"], "left")
    hits = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return joined.select(
        "row",
        "n_words",
        hits.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", digest(F.array().cast("array<string>"))).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )
