"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters A-Z only; other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, local sessions get a folder of their own; on a cluster that is an error, since executors could not
    read what lies on the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="glyphframe-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder of intermediate tables; it is deleted when the application ends."""
    base = f"{checkpoint_dir(spark)}/glyphframe-{spark.sparkContext.applicationId}"
    files, where = _hadoop(spark, base)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return base


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``.  What was shuffled for it is not needed again and is removed at once.

    Spark would remove it when its driver next collects garbage.  Shuffles are told by their numbers; while other jobs of the
    application run, whose numbers lie among these, they are left to Spark.
    """
    spark = df.sparkSession
    context, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext.statusTracker()
    alone, first = not tracker.getActiveJobsIds(), context.newShuffleId()
    df.write.option("compression", "zstd").parquet(path)
    cleaner = context.cleaner()
    if alone and not tracker.getActiveJobsIds() and cleaner.isDefined():
        for shuffle in range(first, context.newShuffleId()):
            cleaner.get().doCleanupShuffle(shuffle, True)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table, without lineage.

    Unlike a checkpoint, which computes its last stage twice, this computes it once, and columns are compressed.
    """
    return _written(df, f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}")


class Scratch:
    """Tables that are deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table and read again."""
        return _written(df, f"{self.base}/{name}")

    def discard(self, *names: str) -> None:
        for name in names:
            files, where = _hadoop(self.spark, f"{self.base}/{name}")
            files.delete(where, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of ``rows`` rows, so that what a worker makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` has a fast path for ASCII, but would also change other letters; so only
    texts without such letters take it.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once.

    The optimizer may put a column's expression where the column is used, and inside a lambda
    it would then be evaluated for every element; a bound variable stays a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_ids(rows: DataFrame, key: str, stratum: str, per_stratum: int, seed: str) -> DataFrame:
    """About ``per_stratum`` rows of each value of ``stratum``, chosen by a hash of ``key``.

    A documented bound for fitting classifiers: the threshold follows from the counts, so
    the choice needs no sort and no window, and is the same on every run.
    """
    counts = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    unit = (F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    return (
        rows.join(F.broadcast(counts), rows[stratum].eqNullSafe(counts[stratum]))
        .where(unit * F.col("__n") < F.lit(float(per_stratum)))
        .select(rows["*"])
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, seed: str) -> list:
    """About ``per_label`` rows (id, text, label) of labels 0 and 1 each, in a fixed order.

    Ids are drawn from the labels alone; they are few, and meet the texts where these are.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    drawn = sample_ids(marks, "id", "label", per_label, seed)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = own.join(F.broadcast(drawn), "id").select("id", "text", "label").collect()
    return sorted(rows, key=lambda r: (r["id"], r["text"] or "", r["label"]))
