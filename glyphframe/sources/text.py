"""Text files as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.operators.encoding import str_conv
from glyphframe.operators.split import split_lines

#: Terminators that Spark's text reader does not know.
MORE_ENDS = "[\x0b\x0c\x85\u2028\u2029]"


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files as (path, content): one row a file, whole."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_lines(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Lines of files as (path, line_no, line), by any Unicode line terminator.

    A byte-order mark is dropped, bytes that are not in the encoding become U+FFFD, and a terminator
    at the end begins no line.  A file is one row until it is split, so files must fit in a task;
    for larger ones there is ``scan_lines``.
    """
    decoded = str_conv("content", encoding or "utf-8")
    texts = read_raw(spark, path).select("path", F.regexp_replace(decoded, "^\ufeff", "").alias("text"))
    lines = texts.where(F.col("text") != "").select("path", F.posexplode(split_lines("text", drop_last=True)).alias("pos", "line"))
    return lines.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of UTF-8 files as (path, line), without numbers: files of any size are split among tasks.

    The reader splits at newlines and carriage returns; what it gives is split again at the
    other terminators.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("value"))
    return rows.select("path", F.explode(F.split("value", MORE_ENDS, -1)).alias("line"))
