"""The verbs in Structured Streaming.

All verbs that give a Column are stateless and work on streams as they are.  State keyed by collated text
is not supported by Spark's state store; ``surrogate_key`` gives a plain key for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.functions.patterns import text
from glyphframe.operators.encoding import trans_nfc


def surrogate_key(string, ignore_case: bool = False) -> Column:
    """A plain text that is equal for canonically equivalent texts (without regard to case, if asked)."""
    key = trans_nfc(text(string))
    return F.lower(F.upper(key)) if ignore_case else key


def stream_unique(stream: DataFrame, string, event_time: str, delay: str = "10 minutes", ignore_case: bool = False) -> DataFrame:
    """The first row of each text within the watermark."""
    keyed = stream.withWatermark(event_time, delay).withColumn("__key", surrogate_key(string, ignore_case))
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def stream_counts(stream: DataFrame, string, event_time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """How often each text occurs in windows of event time."""
    keyed = stream.withWatermark(event_time, delay).withColumn("key", surrogate_key(string))
    return keyed.groupBy(F.window(event_time, window), "key").agg(F.count("*").alias("n"))
