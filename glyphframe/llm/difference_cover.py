"""Suffix array by a distributed difference cover modulo 3.

The suffixes at places 1 and 2 modulo 3 are the sample.  Their triples are sorted and named; if names repeat, the
sequence of names (those of places 1, then those of places 2) is sorted the same way, recursively.  The
remaining suffixes are sorted by their first symbol and the rank of the next suffix, and merged: against places 1 by
(symbol, rank of the next), against places 2 by (symbol, symbol, rank of the one after).  All sorts are range
partitions; ranks are positions, computed without gathering rows in one task.

``repeated_starts`` then compares the prefixes of neighbours in that order: where they are equal, all but the earliest start repeat.

A sequence of at most ``SMALL`` symbols is sorted on the driver: that is the recursion's end.

``op7_suffixes`` does not use it on whole tables, for its cost (see the README).  Neither symbols nor places may be null; symbols
are positive.  An empty sequence gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphframe.llm.common import cut

SMALL = 2000


def positions(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with 1-based positions in the order of ``keys``, which tell its rows apart."""
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    sizes = ordered.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ordered.withColumn("__part", F.shiftright("__at", 33)).join(offsets, "__part").withColumn(name, F.col("__before") + within).drop("__at", "__part", "__before")


def _ahead(rows: DataFrame, value: str, most: int) -> DataFrame:
    """(pos, v0, ..., v``most``): the values at a place and at the next ones; null past the end."""
    spread = rows.select(F.explode(F.array(*[F.struct((F.col("pos") - k).alias("pos"), F.lit(k).alias("k"), F.col(value).alias("v")) for k in range(most + 1)])).alias("x"))
    return spread.select("x.*").groupBy("pos").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(most + 1)])


def _small(text: DataFrame) -> DataFrame:
    symbols = [r["c"] for r in text.orderBy("pos").collect()]
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    return text.sparkSession.createDataFrame([(i, k) for k, i in enumerate(order, 1)], "pos long, place long")


def suffix_places(text: DataFrame) -> DataFrame:
    """From (pos, c), places 0 to n - 1, to (pos, place): the place of each suffix among all, from 1."""
    text = cut(text.select(F.col("pos").cast("long").alias("pos"), F.col("c").cast("long").alias("c")))
    n = text.count()
    if n <= SMALL:
        return _small(text)
    zero = lambda c: F.coalesce(c, F.lit(0))
    mod = F.pmod("pos", F.lit(3))
    triples = cut(_ahead(text, "c", 2).where("pos >= 0").select("pos", *[zero(F.col(f"v{k}")).alias(f"v{k}") for k in range(3)]))
    sample = triples.where(mod > 0)
    if n % 3 == 1:  # keeps the last triple of places 1 apart from the first of places 2
        sample = sample.unionByName(text.sparkSession.createDataFrame([(n, 0, 0, 0)], "pos long, v0 long, v1 long, v2 long"))
    names = positions(sample.select("v0", "v1", "v2").distinct(), ["v0", "v1", "v2"], "name")
    named = cut(sample.join(names, ["v0", "v1", "v2"]).select("pos", "name"))
    firsts = named.where(mod == 1).count()
    if names.count() < named.count():
        inner = suffix_places(named.select(F.when(mod == 1, F.floor(F.col("pos") / 3)).otherwise(firsts + F.floor(F.col("pos") / 3)).alias("pos"), F.col("name").alias("c")))
        back = F.when(F.col("pos") < firsts, F.col("pos") * 3 + 1).otherwise((F.col("pos") - firsts) * 3 + 2)
        ranks = cut(inner.select(back.alias("pos"), F.col("place").alias("r")))
    else:
        ranks = named.withColumnRenamed("name", "r")
    ranks = ranks.where(F.col("pos") < n).withColumn("r", F.col("r") - int(n % 3 == 1))
    near = _ahead(ranks, "r", 2).select("pos", *[zero(F.col(f"v{k}")).alias(f"r{k}") for k in range(3)])
    rows = cut(triples.join(near, "pos", "left").na.fill(0).withColumn("m", mod))
    one = positions(rows.where("m < 2").select("pos", "m", "v0", "r1"), ["v0", "r1", "m"], "p")
    two = positions(rows.where("m <> 1").select("pos", "m", "v0", "v1", "r2"), ["v0", "v1", "r2", "m"], "p")
    own0 = positions(rows.where("m = 0").select("pos", "v0", "r1"), ["v0", "r1"], "q")
    own1 = positions(rows.where("m = 1").select("pos", "r0"), ["r0"], "q")
    own2 = positions(rows.where("m = 2").select("pos", "r0"), ["r0"], "q")
    merged = (
        one.where("m = 0").select("pos", F.col("p").alias("p1")).join(two.where("m = 0").select("pos", F.col("p").alias("p2")), "pos").join(own0.select("pos", "q"), "pos")
    ).select("pos", (F.col("p1") + F.col("p2") - F.col("q")).alias("place"))
    for side, own, m in ((one, own1, 1), (two, own2, 2)):
        part = side.where(F.col("m") == m).select("pos", "p").join(own.select("pos", "q", "r0"), "pos")
        merged = merged.unionByName(part.select("pos", (F.col("r0") + F.col("p") - F.col("q")).alias("place")))
    return cut(merged)


def prefixes(text: DataFrame, length: int, block: int = 4096) -> DataFrame:
    """(pos, prefix): the ``length`` symbols from each place on, of places that have so many; read in blocks that overlap by one block."""
    if length > block:
        raise ValueError("a prefix must fit into a block.")
    at = F.floor(F.col("pos") / block)
    symbols = F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"])
    blocks = cut(text.groupBy(at.alias("b")).agg(symbols.alias("own")))
    after = blocks.select((F.col("b") - 1).alias("b"), F.col("own").alias("after"))
    both = blocks.join(after, "b", "left").select("b", F.size("own").alias("n"), F.concat("own", F.coalesce("after", F.array().cast("array<long>"))).alias("all"))
    rows = both.select("b", "all", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).where(F.col("i") + length <= F.size("all"))
    return rows.select((F.col("b") * block + F.col("i")).alias("pos"), F.slice("all", F.col("i") + 1, length).alias("prefix"))


def repeated_starts(text: DataFrame, length: int) -> DataFrame:
    """(pos): places from (pos, c) whose next ``length`` symbols also start at a smaller place.

    Neighbours in suffix order are compared; a run of equal prefixes begins where one differs from its neighbour before.
    """
    places = cut(suffix_places(text).join(prefixes(text, length), "pos"))
    before = places.select((F.col("place") + 1).alias("place"), F.col("prefix").alias("last"))
    # suffixes too short for a prefix may lie between, but never between two equal prefixes
    marked = places.join(before, "place", "left").select("pos", "place", F.when(F.col("last").isNull() | (F.col("last") != F.col("prefix")), F.col("place")).alias("start"))
    part = F.floor(F.col("place") / 100_000)
    marked = cut(marked.withColumn("part", part))
    firsts = marked.groupBy("part").agg(F.max("start").alias("most"))
    carried = firsts.select(F.col("part").alias("p"), F.max("most").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    upto = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    runs = marked.join(F.broadcast(carried), F.col("part") == F.col("p")).withColumn("run", F.coalesce(F.max("start").over(upto), F.col("carry")))
    earliest = runs.groupBy(F.col("run").alias("r")).agg(F.min("pos").alias("first"))
    return runs.join(earliest, F.col("run") == F.col("r")).where("pos > first").select("pos")
