"""Column profiles: missing values, distinct values, cardinality, bytes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import micros_of
from ..runtime import path_exists, stage
from ..sources.files import FILE, count_lines, detect_delimiters, first_rows_of_files, list_files

# Rows previewed, share below which a text column is worth a dictionary.
PREVIEW_ROWS = 10
DICTIONARY_SHARE = 0.5
#: Two to this power are the registers of a sketch of distinct values.
SKETCH_BITS = 14
# Types a text column may be read as, in the order they are tried.
TEXT_TYPES = ["int", "bigint", "double", "timestamp", "boolean"]
# What a text must look like for a cast to succeed, and numbers that no time has as its year.
_AROUND = r"[\x00-\x20\x7F-\x9F]*"
_MAY_BE = {
    "int": rf"\A{_AROUND}[-+]?[0-9]+{_AROUND}\z",
    "bigint": rf"\A{_AROUND}[-+]?[0-9]+{_AROUND}\z",
    "double": rf"\A{_AROUND}[-+]?(?:[.0-9][-+.0-9a-zA-Z]*|(?i:nan|inf|infinity)){_AROUND}\z",
    "timestamp": r"[0-9]",
    "boolean": rf"\A{_AROUND}(?i:t|true|y|yes|1|f|false|n|no|0){_AROUND}\z",
}
_NO_YEAR = rf"\A{_AROUND}[-+]?(?:29[5-9]|[3-9][0-9]{{2}})[0-9]{{3}}{_AROUND}\z"


def read_as(text: Column, dtype: str) -> Column:
    """``text`` as one of ``TEXT_TYPES``, null if it cannot be read so.

    The same as ``try_cast``, which raises and catches an error for each text that it cannot read; most of those are told by their look.
    """
    fits = text.rlike(_MAY_BE[dtype])
    if dtype == "timestamp":
        fits = fits & ~text.rlike(_NO_YEAR)
    return F.when(fits, text.try_cast(dtype))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, n_missing``, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_missing")


def _as_text(name: str, dtype: T.DataType) -> Column:
    """Text that differs where the values differ; both zeros are one value."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0).cast(dtype)
    return F.hex(c) if isinstance(dtype, T.BinaryType) else c.cast("string")


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _typed(name: str, dtype: T.DataType) -> list[Column]:
    """The value as one of ``whole, real, text``, whichever fits its type; both zeros are one value."""
    c = F.col(f"`{name}`")
    kind = "whole" if isinstance(dtype, _WHOLE) else "real" if isinstance(dtype, (T.DoubleType, T.FloatType)) else "text"
    # Floats stay what they are as doubles; times are counted in microseconds.
    if isinstance(dtype, T.TimestampNTZType):
        kind, c = "whole", micros_of(c)
    value = _as_text(name, dtype) if kind == "text" else c.cast("bigint") if kind == "whole" else c.cast("double") + F.lit(0.0)
    types = {"whole": "bigint", "real": "double", "text": "string"}
    return [(value if k == kind else F.lit(None).cast(t)).alias(k) for k, t in types.items()]


def _value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, column, value, n`` for every distinct value (null too), in one scan.

    Map tasks combine equal values, and the shuffle spreads a column over its values.
    """
    pairs = [F.struct(F.lit(c).alias("column"), _as_text(c, df.schema[c].dataType).alias("value")) for c in columns]
    flat = df.select(*by, F.inline(F.array(*pairs)))
    return flat.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``column, n_distinct`` of non-null values, in one scan.

    The exact form shuffles each column's distinct values, spread by value.
    ``approx=True`` uses a sketch per column and shuffles next to nothing.
    """
    columns = list(columns or df.columns)
    if approx:
        counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return counts.unpivot([], columns, "column", "n_distinct")
    cells = [F.struct(F.lit(k).alias("k"), *_typed(c, df.schema[c].dataType)) for k, c in enumerate(columns)]
    values = df.select(F.inline(F.array(*cells))).distinct()
    given = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
    found = values.groupBy("k").agg(F.count_if(given).alias("n_distinct"))
    # A column of a table without rows has no value at all.
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, column string")
    return names.join(F.broadcast(found), "k", "left").select("column", F.coalesce("n_distinct", F.lit(0).cast("long")).alias("n_distinct"))


def add_to_profile(rows: Callable[[list[str]], DataFrame], files: DataFrame, store: str) -> int:
    """Profile the files of ``files`` (``path``, ``modified``) that ``store`` does not know yet; how many those are.

    ``rows`` reads a list of files. For each file and column the store keeps the rows, the missing values and a
    sketch (HLL) of the distinct ones: a file that has been profiled is not read again, one that has changed since is. One
    scan, in which map tasks combine the sketches of a file; the list of new files is what reaches the driver.
    """
    spark = files.sparkSession
    fresh = files
    if path_exists(spark, store):
        fresh = files.join(spark.read.parquet(store).select("path", "modified").distinct(), ["path", "modified"], "left_anti")
    fresh = stage(fresh.select("path", "modified"), "new-files")
    paths = [r[0] for r in fresh.select("path").collect()]
    if not paths:
        return 0
    # A file without rows is known, too.
    fresh.join(_file_columns(rows(paths)), "path", "left").write.mode("append").parquet(store)
    return len(paths)


def _file_columns(table: DataFrame) -> DataFrame:
    """``path, column, n_rows, n_missing, sketch``: a file's rows are summed as they are, and laid out by column after that."""
    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(f"`{f.name}`").isNull()).alias("n_missing"),
            F.hll_sketch_agg(_as_text(f.name, f.dataType), F.lit(SKETCH_BITS)).alias("sketch"),
        )
        for f in table.schema.fields
    ]
    counted = table.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.array(*cells).alias("cells"))
    return counted.select("path", F.inline("cells"))


def stored_profile(spark: SparkSession, store: str, files: DataFrame | None = None) -> DataFrame:
    """``column, n_rows, n_missing, n_distinct`` over the stored files, or those of ``files``; the sketches are united.

    Counts of rows and missing values are exact. The standard error of ``n_distinct`` is 1.04 / 2^(``SKETCH_BITS`` / 2), 0.8 %, however many files
    are united. Of a file that was profiled again the last state counts.
    """
    known = spark.read.parquet(store)
    if files is not None:
        known = known.join(files.select("path", "modified"), ["path", "modified"], "left_semi")
    else:
        last = known.groupBy("path").agg(F.max("modified").alias("modified"))
        known = known.join(last, ["path", "modified"], "left_semi")
    united = known.where(F.col("column").isNotNull()).groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("bigint").alias("n_distinct"),
    )
    return united


def cardinality_profile(df: DataFrame, threshold: float = DICTIONARY_SHARE) -> DataFrame:
    """Text columns with ``n_distinct, n_rows, share, use_dictionary``, in one scan."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts = _value_counts(df, columns).groupBy("column").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("n_rows"))
    share = F.col("n_distinct") / F.nullif(F.col("n_rows"), F.lit(0))
    return counts.withColumn("share", share).withColumn("use_dictionary", F.col("share") < threshold)


def column_footprint(df: DataFrame) -> DataFrame:
    """Bytes of each column's values, and their total: ``column, bytes``.

    Text counts its UTF-8 length, other types their width for each non-null value.
    """
    sizes = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            size = F.sum(F.octet_length(c).cast("long"))
        else:
            size = F.count(c) * F.lit(_width(f.dataType)).cast("long")
        sizes.append(F.coalesce(size, F.lit(0)).alias(f.name))
    measured = df.agg(*sizes)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in df.columns])
    return measured.withColumn("(total)", total).unpivot([], [*df.columns, "(total)"], "column", "bytes")


def _width(dtype: T.DataType) -> int:
    widths = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    return widths.get(type(dtype), 8)


def profile(spark: SparkSession, path: str | Sequence[str], glob: str | None = None, preview: int = PREVIEW_ROWS) -> DataFrame:
    """Everything known about delimited files as ``file, metric, column, value`` rows.

    For each file its size, lines, delimiter, missing and distinct counts over all rows, and a
    preview of its first rows; types are those that fit all rows of the files with one
    delimiter, which are expected to share a header. Header lines are not rows.
    """
    delimiters = stage(detect_delimiters(spark, path, glob=glob), "delimiters")
    none = F.lit(None).cast("string").alias("column")
    parts = [
        list_files(spark, path, glob).select(F.col("path").alias(FILE), F.lit("bytes").alias("metric"), none, F.col("bytes").cast("string").alias("value")),
        count_lines(spark, path, glob).select(F.col("path").alias(FILE), F.lit("lines").alias("metric"), none, F.col("n_lines").cast("string").alias("value")),
        delimiters.select(FILE, F.lit("delimiter").alias("metric"), none, F.col("delimiter").alias("value")),
    ]
    # One pass per delimiter in use; there are as many as candidates at most.
    for (delimiter,) in delimiters.select("delimiter").distinct().orderBy("delimiter").collect():
        parts += _profile_alike(spark, path, glob, delimiter, delimiters, preview)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed(FILE, "file")


def _profile_alike(spark: SparkSession, path, glob: str | None, delimiter: str, delimiters: DataFrame, preview: int) -> list[DataFrame]:
    own = delimiters.where(F.col("delimiter") == delimiter).select(FILE)
    reader = spark.read.option("header", True).option("sep", delimiter)
    names = reader.csv(own.agg(F.min(FILE)).first()[0]).columns
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = reader.schema(texts).csv(path if isinstance(path, str) else list(path))
    rows = rows.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_block"), "*").join(own, FILE, "left_semi")
    counts = stage(_value_counts(rows, names, [FILE]).groupBy(FILE, "column").agg(
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        *[F.count_if(F.col("value").isNotNull() & read_as(F.col("value"), t).isNull()).alias(t) for t in TEXT_TYPES],
    ), "profile")
    # The narrowest type that every value of every file can be read as.
    fits = [F.when(F.sum(t) == 0, F.lit(t)) for t in TEXT_TYPES]
    types = counts.groupBy("column").agg(F.coalesce(F.when(F.sum("distinct") == 0, F.lit("string")), *fits, F.lit("string")).alias("value"))
    described = own.join(F.broadcast(types)).select(FILE, F.lit("type").alias("metric"), "column", "value")
    first = first_rows_of_files(rows, preview)
    shown = [F.struct(F.concat_ws(" ", F.lit("row"), "place").alias("metric"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names]
    return [
        counts.select(FILE, F.lit("missing").alias("metric"), "column", F.col("missing").cast("string").alias("value")),
        counts.select(FILE, F.lit("distinct").alias("metric"), "column", F.col("distinct").cast("string").alias("value")),
        described,
        first.select(FILE, F.inline(F.array(*shown))),
    ]
