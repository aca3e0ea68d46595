"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words.  Whole epochs of the source come first; the rest of the
target is filled by weighted sampling without replacement: every record draws an
exponential key scaled by its quality weight (``weight``, any column; the query and the pipeline give the quality
classifier's score), records are sorted by key within the source,
and sizes are prefix-summed up to the budget.  The record on the budget's end gives way to
the one, among those left, whose size is nearest to what is missing.

The prefix sums are distributed: keys fall into ordered bins (equal steps of the key's
logarithm, so the weights' scale does not matter), bins are summed before they are shuffled,
and only the bin that holds the budget's end is looked into: it is cut into ``N_PARTS`` parts,
and the one part on the edge is ordered row by row.  A bin holds less than a thousandth of
a source, a part some ten-millionth, so no task gets much of a source at any size.  The
outcome is one row a source, from which every record is decided where it is.

Edge cases: a null or empty text has no words, takes none, and appears with ``taken`` 0.  A null
source is a source of its own, last in order.  Repeated rows (one id and one text) draw the
same key and are taken together.  A source without words has target 0.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphframe.llm.common import cut

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
BINS_PER_OCTAVE = 512
N_PARTS = 4096
#: Up to so many sources the table of sources is broadcast; beyond, it is joined by source and salt.
BROADCAST_SOURCES = 10_000
N_SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plain_share(text: Column) -> Column:
    """Where no weight is given: the share of a text that is neither a symbol nor a digit nor upper case, 0.05 at least."""
    odd = F.regexp_count(text, F.lit(r"[A-Z0-9#*$%&|<>{}=_\\]")).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - odd / F.greatest(F.length(text), F.lit(1))), F.lit(0.05))


def targets(
    sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS
) -> DataFrame:
    """From (source, source_size) to (source, source_size, target): one row a source.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all
    words; no target exceeds ``most`` times its source, and what is cut off is shared again.
    The limit of that is a level: each target is ``min(most * size, level * weight)``.  Going
    through the sources by ``size / weight``, the level is the first one that its source does
    not exceed.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("__k") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = (
        sizes.withColumn("__k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("__w", w)
        .withColumn("__cap", F.lit(float(most)) * F.col("source_size"))
    )
    by_ratio = W.orderBy(F.col("__cap") / F.col("__w"), "__k")
    upto = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))) / (
        F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(upto), F.lit(0.0))
    )
    rows = rows.withColumn("__level", level)
    fits = F.when(F.col("__cap") / F.col("__w") >= F.col("__level"), F.col("__level"))
    rows = rows.withColumn("__level", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")))
    return rows.select("source", "source_size", target.alias("target"))


def drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: str) -> DataFrame:
    """``docs`` with __source, __size, __key and the key's __bin and __part.

    The draw depends on the seed, the id and the text alone, so reruns and retried tasks agree.
    """
    text = F.col(text_col)
    bits = F.xxhash64(F.lit(seed), F.col(id_col), text).bitwiseAND(F.lit((1 << 52) - 1))
    w = plain_share(text) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6))
    steps = F.log2("__key") * BINS_PER_OCTAVE
    return (
        docs.withColumn("__source", F.col(source_col).cast("string"))
        .withColumn("__size", word_count(text))
        .withColumn("__key", -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / w)
        .withColumn("__bin", F.floor(steps).cast("int"))
        .withColumn("__part", F.least(F.floor((steps - F.floor(steps)) * N_PARTS), F.lit(N_PARTS - 1)).cast("int"))
    )


def _edge(masses: DataFrame, goals: DataFrame, step: str, before: Column) -> DataFrame:
    """Of each source, the ``step`` (bin or part) in which its budget ends, and the words before it."""
    running = W.partitionBy("__source").orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    goals = goals.withColumnRenamed("__source", "__s")
    return (
        masses.withColumn("__sum", F.coalesce(F.sum("__mass").over(running), F.lit(0)))
        .join(goals, F.col("__source").eqNullSafe(F.col("__s")))
        .withColumn("__before", before + F.col("__sum"))
        .where((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__mass") >= F.col("__rest")))
    )


def plan(
    rows: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS
) -> DataFrame:
    """From drawn rows, one row a source: its __source_size, __target, __epochs, and where the selection ends."""
    per_bin = cut(rows.groupBy("__source", "__bin").agg(F.sum("__size").alias("__mass")))
    sizes = per_bin.groupBy(F.col("__source").alias("source")).agg(F.sum("__mass").cast("long").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    goals = (
        targets(sizes, weights=weights, share=share, most=most)
        .withColumn("__epochs", epochs.cast("long"))
        .withColumn("__rest", F.greatest(F.col("target") - F.col("__epochs") * F.col("source_size"), F.lit(0.0)))
        .withColumnRenamed("source", "__source")
    )
    goals = cut(goals)
    first = cut(
        _edge(per_bin, goals.select("__source", "__rest"), "__bin", F.lit(0)).select(
            "__source", F.col("__bin").alias("__edge_bin"), F.col("__before").alias("__bin_before"), "__rest"
        )
    )
    on_edge = with_plan(rows, first).where(F.col("__bin") == F.col("__edge_bin"))
    parts = on_edge.groupBy("__source", "__part").agg(F.sum("__size").alias("__mass"))
    second = cut(
        _edge(parts, first, "__part", F.col("__bin_before")).select(
            "__source", "__edge_bin", F.col("__part").alias("__edge_part"), F.col("__before").alias("__part_before"), "__rest"
        )
    )
    last = with_plan(rows, second).where((F.col("__bin") == F.col("__edge_bin")) & (F.col("__part") == F.col("__edge_part")))
    keys = last.groupBy("__source", "__key", "__rest", "__part_before").agg(F.sum("__size").alias("__mass"))
    order = W.partitionBy("__source").orderBy("__key").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__part_before") + F.coalesce(F.sum("__mass").over(order), F.lit(0))
    # the first key with which the budget would be reached; all before it are taken
    reached = keys.withColumn("__sum", before).where((F.col("__sum") < F.col("__rest")) & (F.col("__sum") + F.col("__mass") >= F.col("__rest")))
    edges = cut(
        reached.select(
            "__source", F.col("__key").alias("__edge_key"), (F.col("__rest") - F.col("__sum")).alias("__gap")
        )
    )
    # of the records not taken so far, the one whose size is nearest to what is missing closes the selection
    left = with_plan(rows, edges).where((F.col("__size") > 0) & (F.col("__key") >= F.col("__edge_key")))
    left = left.withColumn("__off", F.abs(F.col("__size") - F.col("__gap"))).where(F.col("__off") < F.col("__gap"))
    closing = left.groupBy(F.col("__source").alias("__c")).agg(F.min(F.struct("__off", "__key")).getField("__key").alias("__close_key"))
    edges = edges.join(closing, F.col("__source").eqNullSafe(F.col("__c")), "left").select(F.col("__source").alias("__e"), "__edge_key", "__close_key")
    return cut(
        goals.join(edges, F.col("__source").eqNullSafe(F.col("__e")), "left").select(
            "__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__epochs", "__edge_key", "__close_key"
        )
    )


def with_plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns that ``sources`` (one row a source, already written) has for their source.

    Broadcast up to ``BROADCAST_SOURCES`` rows; beyond that joined by source and a salt, so
    that a source with a third of the rows is spread over ``N_SALTS`` tasks.
    """
    other = sources.withColumnRenamed("__source", "__p")
    same = F.col("__source").eqNullSafe(F.col("__p"))
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(other), same).drop("__p")
    salted = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(N_SALTS - 1))))
    of_row = rows.withColumn("__rsalt", F.pmod(F.col("__part"), F.lit(N_SALTS)))
    return of_row.join(salted, same & (F.col("__rsalt") == F.col("__salt"))).drop("__p", "__salt", "__rsalt")


def times() -> Column:
    """How often the mix takes a row that has its source's plan."""
    chosen = (F.col("__key") < F.col("__edge_key")) | F.coalesce(F.col("__key") == F.col("__close_key"), F.lit(False))
    chosen = chosen & (F.col("__size") > 0)
    return F.col("__epochs") + F.coalesce(chosen, F.lit(False)).cast("long")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, taken, source and times (``taken`` is ``times * size``)."""
    own = docs.select(id_col, *dict.fromkeys(c for c in (text_col, source_col) if c != id_col))
    rows = drawn(own, id_col, text_col, source_col, weight, seed)
    rows = cut(rows.select(F.col(id_col).alias("__id"), "__source", "__size", "__key", "__bin", "__part"))
    sources = plan(rows, weights=weights, share=share, most=most)
    return (
        with_plan(rows, sources)
        .withColumn("times", times())
        .select(
            F.col("__id").alias(id_col),
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            (F.col("times") * F.col("__size")).cast("long").alias("taken"),
            F.col("__source").alias("source"),
            "times",
        )
    )


def mixed_rows(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its ``times`` says, with its own columns.

    Texts are not shuffled: a row is decided by its own draw and its source's plan.
    """
    rows = drawn(docs, id_col, text_col, source_col, weight, seed)
    narrow = cut(rows.select("__source", "__size", "__key", "__bin", "__part"))
    sources = plan(narrow, weights=weights, share=share, most=most)
    return (
        with_plan(rows, sources)
        .withColumn("__times", times())
        .where("__times > 0")
        .withColumn("__epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
        .select(*docs.columns)
    )
