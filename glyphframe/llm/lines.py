"""Line dedup by distinct-site spread.

Lines that stand on many sites are boilerplate.  A HyperLogLog sketch of its sites is kept for
each line hash and merged by aggregation, first within each task.  Lines whose estimate is
near the threshold get an exact distinct count; then boilerplate lines are removed from all
documents.

Only hashes are shuffled for counting, 24 bytes a line, or a sketch.  A line on a third of all rows is
one sketch.  Boilerplate lines are few: while their counted number is within ``BROADCAST_ROWS``,
their hashes are broadcast and texts stay where they are; beyond that the places of removed lines
are joined with the texts.

Lines are compared without white space at their ends; lines without a word are kept and never
counted.  Edge cases: a null text has no lines and stays null; an empty one stays empty; a null
site counts as a site of its own.  Repeated rows keep their number.  Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.common import cut
from glyphframe.llm.decontaminate import row_key

LEAST_SITES = 10
LG_K = 10
#: Estimates within this share of the threshold are counted exactly.
MARGIN = 0.25
BROADCAST_ROWS = 500_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def hashes(line: Column) -> list[Column]:
    """Two hashes of a line: 128 bits in all."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def spread_lines(lines: DataFrame, least_sites: int) -> DataFrame:
    """Hashes (h1, h2) of the lines (h1, h2, site) that are on ``least_sites`` sites or more."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"))
    low, high = least_sites * (1 - MARGIN), least_sites * (1 + MARGIN)
    likely = cut(sketches.where(F.col("about") >= low))
    near = likely.where(F.col("about") <= high).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n"))
    return likely.where(F.col("about") > high).select("h1", "h2").unionByName(exact.where(F.col("n") >= least_sites).select("h1", "h2"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """Per row of ``docs``: (id, text, n_lines, n_removed), text without boilerplate lines."""
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000null")).alias("site"))
    own = own.select("__id", "__text", "site", *row_key(F.col("__id"), F.col("__text")))
    split = own.select("site", "__h1", "__h2", F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
    split = split.select("site", "__h1", "__h2", "pos", trimmed(F.col("line")).alias("line")).where("line <> ''")
    hashed = split.select("site", "__h1", "__h2", "pos", *hashes(F.col("line")))
    common = cut(spread_lines(hashed.select("site", "h1", "h2"), least_sites))
    if common.count() <= BROADCAST_ROWS:
        return _scan(docs, common, id_col, text_col)
    found = hashed.join(common, ["h1", "h2"])
    places = cut(found.groupBy(F.col("__h1").alias("__r1"), F.col("__h2").alias("__r2")).agg(F.collect_set("pos").alias("__gone")))
    lines = F.split("__text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("__gone", i))
    return own.join(places, (F.col("__h1") == F.col("__r1")) & (F.col("__h2") == F.col("__r2")), "left").select(
        F.col("__id").alias(id_col),
        F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def _scan(docs: DataFrame, common: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Removal where the texts are, with the hashes of at most ``BROADCAST_ROWS`` lines broadcast."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = docs.sparkSession.sparkContext.broadcast(frozenset((r["h1"], r["h2"]) for r in common.collect()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = xxhash.xxh64_intdigest(b"line", 42)
        first_only = {h1 for h1, _ in gone.value}
        signed = lambda h: h - (1 << 64) if h >> 63 else h

        def removed(line: str) -> bool:
            data = line.strip(" \t\n\x0b\x0c\r").encode()
            if not data:
                return False
            h1 = signed(xxhash.xxh64_intdigest(data, 42))
            return h1 in first_only and (h1, signed(xxhash.xxh64_intdigest(data, second))) in gone.value

        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for x in batch.column(1):
                text = x.as_py()
                rows = [] if text is None else text.split("\n")
                kept = [r for r in rows if not removed(r)]
                texts.append(None if text is None else "\n".join(kept))
                n_lines.append(len(rows))
                n_removed.append(len(rows) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["id", "text", "n_lines", "n_removed"])

    out = own.mapInArrow(scan, f"id {own.schema['id'].dataType.simpleString()}, text string, n_lines bigint, n_removed bigint")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_removed")
