"""Removal of repeated byte strings, exact to the byte.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document of
smaller id, or in the same document further to the front.

A suffix array over all bytes, built by a distributed difference cover, first sorts two
thirds of all suffixes as triples: 16 bytes for a row of which there are 0.67 for a byte of text.
The README has what that takes; it is several times the disk that the whole operator may
use.  So another method is used, which keeps no order of suffixes: strings are brought together by content and
told apart by hashes that are compared byte by byte.

* Every string of ``LENGTH`` bytes has an anchor, the run of ``K`` bytes in it with the least hash
  (leftmost first).  Equal strings have equal anchors, so they meet in one class.  Neighbouring
  strings mostly share an anchor, so there is one for every 40 bytes or so.
* Classes with one occurrence have no repeated string and go no further; nothing but hashes
  and places is shuffled for that.
* For the other anchors the bytes around them, which hold all their strings, are brought
  together; equal surroundings are merged before the shuffle, keeping the earliest place.
* In each class all strings of ``LENGTH`` bytes are put in the order of a 64-bit hash and their place; neighbours of equal hash
  are compared byte by byte.  The first of equal ones is the earliest; the others are repeats.

Classes of more than ``CLASS_ROWS`` different surroundings or ``CLASS_BYTES`` (a frequent phrase, or text that repeats itself) are not
brought into one task: their strings are aggregated by a hash of 128 bits to the earliest place.

Edge cases: a null or empty text has no bytes.  Rows of one id are one document: of rows with
different texts the starts are compared, and equal rows repeat nothing of each other.  A null
id is smaller than all others.  Ids are integers.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.common import Scratch, sliced

LENGTH, K = 100, 16
GRAMS = LENGTH - K + 1
#: Positions of a text that are hashed at a time.
PIECE = 1 << 18
#: Different surroundings of an anchor that one task may get.
CLASS_ROWS = 20_000
#: Bytes of surroundings of an anchor that one task may get.
CLASS_BYTES = 1 << 25
#: Bytes of surroundings that are sorted at a time.
CHUNK = 1 << 21
BROADCAST_ROWS = 100_000
#: Texts whose surroundings are handed on at a time.
ROWS = 1000
NO_ID = -(1 << 63)
_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def byte_values() -> np.ndarray:
    """256 numbers of 64 bits, by a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64)) * _M[0]
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def doubled(x: np.ndarray, width: int, salt: int) -> np.ndarray:
    """From hashes of ``width`` bytes to hashes of twice as many."""
    return ((x[:-width] ^ (x[:-width] >> np.uint64(29))) * _M[salt]) + x[width:]


def gram_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``K`` bytes."""
    x, width = values[data], 1
    while width < K:
        x = doubled(x, width, 1)
        width *= 2
    return (x ^ (x >> np.uint64(32))) * _M[2]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(x) - width + 1
    full = -(-len(x) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def anchors(data: bytes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts, whether it is several) for the anchors of all strings of a text."""
    whole = np.frombuffer(data, dtype=np.uint8)
    hashes, firsts, numbers, several = [], [], [], []
    low = np.uint64((1 << 24) - 1)
    for at in range(0, len(whole) - LENGTH + 1, PIECE):
        own = whole[at : at + PIECE + LENGTH - 1]
        h = gram_hashes(own, values)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), GRAMS)
        place = (least & low).astype(np.int64)
        own_hash = h[place]
        # neighbouring anchors with the same bytes (text that repeats itself) count as one
        begins = np.flatnonzero(np.concatenate([[True], own_hash[1:] != own_hash[:-1]]))
        hashes.append(own_hash[begins])
        firsts.append(begins + at)
        ends = np.append(begins[1:], len(own_hash))
        numbers.append(ends - begins)
        several.append(place[ends - 1] != place[begins])
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(numbers), np.concatenate(several)


def eights(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    x, shift = buffer.astype(np.uint64), 1
    while shift < 8:
        x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
        shift *= 2
    return x


_OFFSETS = (*range(0, LENGTH - 8, 8), LENGTH - 8)


def prefix_hashes(words: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the ``LENGTH`` bytes at places."""
    h = np.zeros(len(at), dtype=np.uint64)
    for offset in _OFFSETS:
        h = (h ^ words[at + offset]) * _M[salt]
        h ^= h >> np.uint64(31)
    return h


def starts_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of surroundings in one buffer: places of all strings, which surroundings they are in, and where in these."""
    numbers = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(sizes)), numbers)
    inside = np.arange(int(numbers.sum())) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    return inside + np.repeat(np.cumsum(sizes) - sizes, numbers), which, inside


def earliest(ids: np.ndarray, places: np.ndarray, surroundings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (which surroundings, first start in them, number) of strings that stand nowhere earlier."""
    buffer = np.frombuffer(b"".join(surroundings), dtype=np.uint8)
    at, which, inside = starts_of(np.array([len(s) for s in surroundings], dtype=np.int64))
    words = eights(buffer)
    keys = prefix_hashes(words, at, 1)
    order = np.lexsort((places[which] + inside, ids[which], keys))
    a, b = at[order[:-1]], at[order[1:]]
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = a[same], b[same]
    equal = np.ones(len(same), dtype=bool)
    for offset in _OFFSETS:
        equal &= words[a + offset] == words[b + offset]
    first = np.ones(len(at), dtype=bool)
    first[order[1:][same[equal]]] = False
    hits = np.flatnonzero(first)
    begins = np.flatnonzero((np.diff(hits, prepend=-2) != 1) | (np.diff(which[hits], prepend=-1) != 0))
    return which[hits[begins]], inside[hits[begins]], np.diff(begins, append=len(hits))


def marked(size: int, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Places that runs (start, number) cover."""
    step = np.bincount(starts, minlength=size + 1) - np.bincount(starts + numbers, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def removed_mask(size: int, spans: tuple[np.ndarray, np.ndarray], firsts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bytes that lie in a repeat: strings that start in ``spans`` but not in ``firsts``, both as (starts, numbers)."""
    repeat = marked(size, *spans) & ~marked(size, *firsts)
    total = np.cumsum(repeat)
    total[LENGTH:] -= total[:-LENGTH].copy()
    return total > 0


def _lists(column: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs: where each row's list begins (and the last ends), and the fields of all."""
    if column.null_count == len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), [np.zeros(0, dtype=np.int64) for _ in names]
    values = column.values
    return column.offsets.to_numpy().astype(np.int64), [values.field(values.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _scan_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values = byte_values()
    for batch in batches:
        ids, marks, out = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
        for i, x in enumerate(batch.column(2)):
            h, first, n, several = anchors(x.as_py() or b"", values)
            if len(h):
                out.append((h, np.full(len(h), ids[i]), np.full(len(h), marks[i]), first, n, 1 + several))
        if out:
            columns = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0].view(np.int64)), pa.array(columns[1]), *(pa.array(c.astype(np.int32)) for c in columns[2:])], names=["h", "id", "mark", "start", "n", "times"]
            )


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=5)
    for batch in batches:
        packed = [packer.compress(x.as_py() or b"") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "mark", "packed"])


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        at, (h, starts, numbers) = _lists(batch.column(3), "h", "start", "n")
        for low in range(0, len(ids), ROWS):
            high = min(low + ROWS, len(ids))
            around = []
            for i in range(low, high):
                data = _unpacked(packed[i].as_py())
                a, b = starts[at[i] : at[i + 1]], starts[at[i] : at[i + 1]] + numbers[at[i] : at[i + 1]] + (LENGTH - 1)
                around += [data[x:y] for x, y in zip(a.tolist(), b.tolist())]
            own, sizes = slice(at[low], at[high]), np.diff(at[low : high + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[own]), pa.array(np.repeat(ids[low:high], sizes)), pa.array(np.repeat(marks[low:high], sizes)), pa.array(starts[own]), pa.array(around, pa.binary())],
                names=["h", "id", "mark", "start", "around"],
            )


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by class: runs of strings that stand nowhere earlier."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([r[1] for r in rows], dtype=np.int64)
        starts = np.array([r[3] for r in rows], dtype=np.int64)
        which, inside, n = earliest(ids, starts, [r[4] for r in rows])
        marks = np.array([r[2] for r in rows], dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[which]), pa.array(marks[which]), pa.array((starts[which] + inside).astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "mark", "start", "n"]
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= CHUNK and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield flush(held)


def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of surroundings, by a hash of 128 bits; long surroundings in pieces."""

    def pieces() -> Iterator[tuple]:
        for batch in sliced(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for off in range(0, len(row[4]) - LENGTH + 1, PIECE):
                    yield (*row[:3], row[3] + off, row[4][off : off + PIECE + LENGTH - 1])

    def parts() -> Iterator[list[tuple]]:
        held, size = [], 0
        for piece in pieces():
            held.append(piece)
            size += len(piece[4])
            if size >= PIECE:
                yield held
                held, size = [], 0
        if held:
            yield held

    for part in parts():
        buffer = np.frombuffer(b"".join(r[4] for r in part), dtype=np.uint8)
        place, which, inside = starts_of(np.array([len(r[4]) for r in part], dtype=np.int64))
        words = eights(buffer)
        ids, marks, starts = (np.array([r[i] for r in part], dtype=np.int64) for i in (1, 2, 3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(prefix_hashes(words, place, s).view(np.int64)) for s in (1, 2)] + [pa.array(ids[which]), pa.array(marks[which].astype(np.int32)), pa.array((starts[which] + inside).astype(np.int32))],
            names=["g1", "g2", "id", "mark", "start"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, out = batch.column(1), []
        at, spans = _lists(batch.column(2), "start", "n")
        first_at, firsts = _lists(batch.column(3), "start", "n")
        for i in range(batch.num_rows):
            data = _unpacked(packed[i].as_py())
            if at[i] == at[i + 1]:
                out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            own = tuple(x[at[i] : at[i + 1]] for x in spans)
            gone = removed_mask(len(data), own, tuple(x[first_at[i] : first_at[i + 1]] for x in firsts))
            kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
            out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    text = F.col(text_col).cast("binary")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), (F.coalesce(F.crc32(text), F.lit(0)) - F.lit(1 << 31)).cast("int").alias("mark"), text.alias("text"))
    found = own.where(F.octet_length("text") >= LENGTH).mapInArrow(_scan_anchors, "h bigint, id bigint, mark int, start int, n int, times int")
    shared = found.groupBy(F.col("h").alias("sh")).agg(F.sum("times").alias("c")).where("c > 1").select("sh")
    active = found.drop("times").join(shared, F.col("h") == F.col("sh"), "left_semi")
    scratch = Scratch(docs.sparkSession)
    spans = scratch.stored(active.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n", "h")).alias("spans")), "spans")
    packed = own.mapInArrow(_compress, "id bigint, mark int, packed binary")
    around = packed.join(spans, ["id", "mark"]).select("id", "mark", "packed", "spans").mapInArrow(_surroundings, "h bigint, id bigint, mark int, start int, around binary")
    place = F.min(F.struct("id", "start", "mark")).alias("p")
    different = around.groupBy("h", "around").agg(place).select("h", F.col("p.id").alias("id"), F.col("p.mark").alias("mark"), F.col("p.start").alias("start"), "around")
    different = scratch.stored(different, "different")
    heavy = scratch.stored(different.groupBy(F.col("h").alias("hh")).agg(F.count("*").alias("c"), F.sum(F.octet_length("around")).alias("b")).where((F.col("c") > CLASS_ROWS) | (F.col("b") > CLASS_BYTES)).select("hh"), "heavy")
    n_heavy = heavy.count()
    marked = F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy
    on = F.col("h") == F.col("hh")
    light = different.join(marked, on, "left_anti") if n_heavy else different
    run = "id bigint, mark int, start int, n int"
    firsts = light.repartition("h").sortWithinPartitions("h").select("h", "id", "mark", "start", "around").mapInArrow(_first_runs, run)
    if n_heavy:
        single = different.join(marked, on, "left_semi").select("h", "id", "mark", "start", "around").mapInArrow(_single_strings, "g1 bigint, g2 bigint, id bigint, mark int, start int")
        lone = single.groupBy("g1", "g2").agg(place).select("p.id", "p.mark", "p.start", F.lit(1).alias("n"))
        firsts = firsts.unionByName(lone)
    firsts = scratch.stored(firsts.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n")).alias("firsts")), "firsts")
    scratch.discard("different")
    whole = packed.join(spans.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n")))), ["id", "mark"], "left")
    whole = whole.join(firsts, ["id", "mark"], "left").select("id", "packed", "spans", "firsts")
    out = whole.mapInArrow(_digest, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    return out.select(known.alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")
