"""SimHash near duplicates, linked by Golay-code fuzzy hashing.

A fingerprint has a bit for each bit position that is set in over half of the hashes of a
text's word shingles.  Texts link when their fingerprints differ in at most ``RADIUS`` bits, and
groups are what links connect.

A fingerprint is cut into three segments of at most 23 bits.  With two errors at least one
segment has none, so each segment in turn is taken as it is, together with each Golay index
of the next segment, which two errors leave in common.  That gives a fingerprint 3 to 18
keys of 34 bits or so; fingerprints with a common key are compared.

Only distinct fingerprints take part, so a group of copies is one entry.  Keys with up to
``CAP`` fingerprints compare these with each other.  Fingerprints of larger keys take another
way with the same result: each meets the 64 fingerprints one bit away, and two fingerprints
within two bits always have one of these (or themselves) in common, while any two that meet
are within two bits; no pairs are made there.

Edge cases: a null or empty text has fingerprint 0 and links like any other.  A null id is
never a component id unless its group has no other.  Repeated rows appear as often as they
come.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.llm import golay
from glyphframe.llm.common import UPPER, cut
from glyphframe.llm.graph import components

BITS, RADIUS, SEED = 64, 2, 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))
CAP = 16
#: Texts above this many bytes are read in pieces.
PIECE = 1 << 22
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_SPACE = b" \t\n\x0b\x0c\r"
_BYTE_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], dtype=np.int64)


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a list for every ``PIECE`` bytes or so."""
    if len(data) <= PIECE:
        yield data.translate(_LOWER).split()
        return
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[start:end].translate(_LOWER).split()
        start = end


def shingle_hashes(data: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included; of the whole sequence if it is shorter."""
    digest, tail, seen = xxhash.xxh64_intdigest, [], False
    for words in pieces(data):
        words = tail + words
        if len(words) >= k:
            joined = b" ".join(words)
            ends, at = [], -1
            for w in words:
                at += len(w) + 1
                ends.append(at)
            starts = [0] + [e + 1 for e in ends[: len(words) - k]]
            seen = True
            yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])], dtype=np.uint64)
            tail = words[len(words) - k + 1 :] if k > 1 else []
        else:
            tail = words
    if not seen and tail:
        yield np.array([digest(b" ".join(tail), SEED)], dtype=np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bit ``i`` is 1 if it is set in over half of all hashes."""
    votes, n = np.zeros((8, 8), dtype=np.int64), 0
    lane = np.arange(8, dtype=np.int64) << 8
    for hashes in parts:
        by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + lane).ravel(), minlength=2048)
        votes += by_byte.reshape(8, 256) @ _BYTE_BITS
        n += len(hashes)
    bits = (votes.ravel() * 2 > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def fingerprint(data: bytes | None, k: int) -> int:
    """The fingerprint of a text's shingles of ``k`` words, repeats included."""
    return majority(shingle_hashes(data or b"", k))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text, as a signed long."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), k) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return own.mapInArrow(scan, f"id {id_type}, fp bigint")


@F.arrow_udf(T.ArrayType(T.LongType()))
def fuzzy_keys(fps: pa.Array) -> pa.Array:
    """Keys of fingerprints: a segment as it is, with each Golay index of the next segment."""
    words = fps.to_numpy(zero_copy_only=False).view(np.uint64)
    parts = [((words >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    keys = []
    for i, exact in enumerate(parts):
        index = golay.indices(parts[(i + 1) % 3])
        head = (i << 22 | exact)[:, None] << 12
        keys.append(np.where(index >= 0, head | index, -1))
    table = np.concatenate(keys, axis=1)
    offsets = np.concatenate([[0], np.cumsum((table >= 0).sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[table >= 0]))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints (fp) that are within ``RADIUS`` bits."""
    keyed = cut(fps.select("fp", F.explode(fuzzy_keys("fp")).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    few = shared.where(F.col("n") <= CAP).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    pairs = few.select("fps", F.explode("fps").alias("a")).select(
        "a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= RADIUS))).alias("b")
    )
    many = shared.where(F.col("n") > CAP).select("fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = many.select("fp", F.explode(near).alias("z"))
    # at most 65 fingerprints are within one bit of z
    stars = met.groupBy("z").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select("a", F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """From (id, fp) to (id, fp, component_id): the smallest id that links reach."""
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(links(distinct))
    linked = distinct.join(roots, F.col("fp") == F.col("vertex")).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = distinct.join(linked.join(least, "root").select(F.col("fp").alias("lfp"), "component_id"), F.col("fp") == F.col("lfp"), "left")
    known = known.select(F.col("fp").alias("kfp"), F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(known, F.col("fp") == F.col("kfp")).select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """Per row of ``docs``: (id, fp, component_id)."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col, k=k))
    return groups(prints)
