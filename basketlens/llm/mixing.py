"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

Each source's mean repetition rate is its target share of the characters over the share it has.
A document's count is the inverse of the Poisson distribution at a uniform number hashed from seed
and id, so it does not depend on the layout, and a source with a third of all rows needs no
exchange: only the rates (one row per source) meet the documents. Copies are then dealt over all
partitions by a hash of id and copy and sorted inside them: a global shuffle without sampling.

A mean over ``CHUNK`` is drawn as a sum of equal smaller ones. Null sources are a source; null texts
have no characters; documents that share an id share its draws (null ids share one). A source
without characters, or without weight, yields nothing; an empty table gives an empty one. All input
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage
from .storage import small_side

SEED = "mix-1"
#: Without weights, a source's target share is its characters to this power.
TEMPERING = 0.5
CHUNK = 16.0
#: Beyond so many copies a Poisson variable of mean CHUNK has less than 2**-52 left.
MOST = 96


def uniform(*parts: Column) -> Column:
    """A number from 0 up to 1, of 52 bits, from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _identity(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, tempering: float = TEMPERING) -> DataFrame:
    """(source, rate): the mean number of copies of a document, a stored table."""
    mass = docs.groupBy("source").agg(F.sum(F.length("text")).cast("double").alias("chars")).where("chars > 0")
    if weights is None:
        weight = F.pow("chars", F.lit(tempering))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    mass = stage(mass.withColumn("weight", weight), "mass")
    total = mass.agg(F.sum("chars"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(total[1] or 1.0)
    return mass.select("source", (F.lit(epochs * (total[0] or 0.0)) * share / F.col("chars")).alias("rate"))


def _distribution(rates_table: DataFrame) -> DataFrame:
    """With chunks, and cdf: the probabilities of at most 0, 1, 2, ... copies per chunk."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int"))
    mean = F.col("rate") / F.col("chunks")
    start = F.struct(F.array(F.exp(-mean)).alias("cdf"), F.exp(-mean).alias("p"))

    def grow(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"), p.alias("p"))

    return rates_table.withColumn("chunks", chunks).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, grow, lambda acc: acc["cdf"]))


def replicate(docs: DataFrame, rates_table: DataFrame, seed: str = SEED) -> DataFrame:
    """row (all columns of ``docs``), copy (from 1) and order (the place in the global shuffle)."""
    side = _distribution(rates_table).select(F.col("source").alias("rate_source"), "chunks", "cdf")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").alias("doc_source"), _identity(F.col("doc_id")).alias("id"))
    rows = rows.join(small_side(side), F.col("doc_source").eqNullSafe(F.col("rate_source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("chunks")), lambda k: uniform(F.lit(seed), F.col("id"), k.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda p: p <= u)))
    rows = rows.select("row", "id", copies.alias("copies")).where("copies > 0")
    rows = rows.select("row", "id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.select("row", "copy", uniform(F.lit(seed), F.lit("order"), F.col("id"), F.col("copy").cast("string")).alias("order"))


def shuffled(rows: DataFrame) -> DataFrame:
    """Sorted by order: partition k holds the k-th part of the range from 0 to 1."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.floor(F.col("order") * n).cast("int")).sortWithinPartitions("order", "copy")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The documents, each as often as drawn, in a random order; the columns of ``docs``."""
    return shuffled(replicate(docs, rates(docs, weights, epochs), seed)).select("row.*")
