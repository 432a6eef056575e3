"""Several event CSV sources to dictionary-encoded Parquet under one dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.dictionary import build_dictionary, encode
from ..schema import DICTIONARY_COLUMNS
from ..sinks import write_parquet
from ..sources.events import read_events_csv


def build(spark: SparkSession, sources: Sequence[str], targets: Sequence[str], **options) -> DataFrame:
    """Encode each source to its target; returns the dictionary they share.

    Each source is parsed twice: for all its dictionary columns at once, and to be encoded.
    """
    frames = [read_events_csv(spark, s, **options) for s in sources]
    dictionary = build_dictionary(frames, DICTIONARY_COLUMNS)
    for frame, target in zip(frames, targets, strict=True):
        write_parquet(encode(frame, dictionary), target)
    return dictionary
