"""Facts about files: sizes, lines, delimiter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Delimiters tried.
DELIMITERS = [",", ";", "\t", "|"]

FILE = "_file"


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``path, bytes, mb`` of every file below ``path``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    mb = F.col("bytes") / F.lit(1024.0 * 1024.0)
    files = reader.load(path if isinstance(path, str) else list(path))
    return files.select("path", F.col("length").alias("bytes")).withColumn("mb", F.round(mb, 2))


def file_states(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``path, modified`` of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path if isinstance(path, str) else list(path)).select("path", F.col("modificationTime").alias("modified"))


def count_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Physical lines (header included) per file: ``path, n_lines``."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path if isinstance(path, str) else list(path))
    return lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def detect_delimiters(spark: SparkSession, path: str | Sequence[str], candidates: Sequence[str] = DELIMITERS, glob: str | None = None) -> DataFrame:
    """Per file the delimiter that splits most lines into the same number of fields.

    ``_file, delimiter, n_fields, share``; a file in which no candidate occurs has no row. Quoted
    text does not count. Every line is looked at, in one scan whose map tasks count.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    lines = reader.text(path if isinstance(path, str) else list(path))
    bare = F.regexp_replace("value", '"[^"]*"', "")
    sizes = [
        F.struct(F.lit(i).alias("choice"), F.lit(d).alias("delimiter"), F.size(F.split(bare, f"\\Q{d}\\E", -1)).alias("n_fields"))
        for i, d in enumerate(candidates)
    ]
    counts = lines.select(F.col("_metadata.file_path").alias(FILE), F.inline(F.array(*sizes)))
    counts = counts.groupBy(FILE, "choice", "delimiter", "n_fields").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("n"), F.col("n_fields"), (-F.col("choice")).alias("choice"))
    best = counts.groupBy(FILE).agg(
        F.max_by(F.struct("delimiter", "n_fields", "n"), F.when(F.col("n_fields") > 1, order)).alias("best"),
        F.max(F.when(F.col("n_fields") > 1, F.lit(1))).alias("found"),
        F.sum(F.when(F.col("choice") == 0, F.col("n"))).alias("lines"),
    )
    return best.where("found = 1").select(FILE, "best.delimiter", "best.n_fields", (F.col("best.n") / F.col("lines")).alias("share"))


def detect_delimiter(spark: SparkSession, path: str, candidates: Sequence[str] = DELIMITERS) -> DataFrame:
    """``delimiter, n_fields, share`` for all files below ``path`` together, or no row."""
    found = detect_delimiters(spark, path, candidates).groupBy("delimiter", "n_fields").agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("share"))
    return found.orderBy(F.desc("n"), F.desc("n_fields"), "delimiter").limit(1).select("delimiter", "n_fields", "share")


def first_rows_of_files(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each file with their ``place``.

    ``rows`` has ``_file`` and ``_block``, where in it the row's split starts. The rank is limited, so
    each task keeps ``n`` rows of a file before the shuffle.
    """
    order = Window.partitionBy(FILE).orderBy("_block", "_at")
    numbered = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(order))
    return numbered.where(F.col("place") <= n).drop("_at", "_block")
