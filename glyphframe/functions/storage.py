"""Order across partitions: positions of rows, without gathering rows in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; local sessions without one get a folder of their own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = found or tempfile.mkdtemp(prefix="glyphframe-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/glyphframe-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/data"


def written(df: DataFrame) -> DataFrame:
    """``df`` from the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def columns(order_by: str | Column | list) -> list[Column]:
    many = order_by if isinstance(order_by, (list, tuple)) else [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in many]


def with_position(df: DataFrame, order_by: str | Column | list, name: str = "index") -> DataFrame:
    """``df`` with 1-based positions in the order of ``order_by``, which must tell all rows apart.

    Rows are range-partitioned and sorted; each partition counts its own, and offsets come
    from one number a partition.
    """
    keys = columns(order_by)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    ordered = written(ordered)
    part = F.shiftright("__at", 33)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = ordered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, (F.col("__before") + within + 1).cast("long")).drop("__at", "__part", "__before")


def with_running_sum(df: DataFrame, keys: list[str], value: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with the sum of ``value`` over all rows before, in the order of ``keys``; and its number of rows."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    ordered = written(ordered).withColumn("__part", F.shiftright("__at", 33))
    sizes = ordered.groupBy("__part").agg(F.sum(value).alias("__sum"), F.count("*").alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    within = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    own = ordered.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    out = own.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(name, F.col("__own") + F.col("__offset"))
    return out.drop("__at", "__part", "__p", "__own", "__offset"), sizes.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
