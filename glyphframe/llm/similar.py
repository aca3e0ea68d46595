"""Groups of texts whose five-word shingles are at least 80 % the same; no link is lost.

Links are found in three steps, and every candidate is verified on the whole shingle sets:

1. SimHash: fingerprints of the shingles within two bits, found by Golay-code keys (``simhash.links``).  That connects
   close copies, however many there are, with one comparison a text or so.
2. What two bits cannot tell, a prefix filter finds, exactly: all distinct shingles of a text are put in one order, rare ones
   first.  Of a text with ``n`` shingles the first ``n - ceil(0.8 n) + 1`` are its keys; two texts with a similarity of
   ``LEAST`` have a key in common.  Keys of up to ``CAP`` texts give their pairs.  Two bounds tell most of the unlike ones:
   with ``o = ceil(4 (na + nb) / 9)`` shingles in common at the least, the first common key must have ``o`` shingles left from it
   on in both, and the text whose last key comes first may have only so many keys that the other one does not have.
3. Keys with more texts are dense.  Their members are compared with a centre, another one in each of ``ROUNDS`` rounds, which
   joins a cluster without making its pairs: first the member that has the fewest shingles before the key (edits make
   shingles that are rare, so that is the least edited one), then any.  Then all pairs of a dense key that are not connected yet and within
   the first bound are compared, so that no pair is left out.

Pairs that links have connected already are never made or compared.  In the rounds a text is compared with one
candidate at a time, so a cluster costs about one comparison a member.

The order comes from counts of all shingles of all texts in 2^20 buckets by hash (4 MB at any size of the corpus).  It decides
about speed only: any order finds all pairs.

Equal texts are one entry from the start.  Edge cases: null and empty texts have no words and are one group, like any equal
texts.  Rows of equal id and text are equal rows; one of them stays.  Texts of under five words are one shingle.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from glyphframe.llm.common import Scratch, cut, sliced
from glyphframe.llm.decontaminate import row_key
from glyphframe.llm.graph import components
from glyphframe.llm.simhash import links as near_prints
from glyphframe.llm.simhash import majority, pieces

SHINGLE, LEAST = 5, 0.8
CAP, ROUNDS = 64, 2
BUCKET_BITS, CHUNK_BITS, SPREAD = 20, 12, 64
BROADCAST_ROWS = 1_000_000
#: Links that the driver connects (16 bytes each); more of them are connected in rounds of shuffles, with the same result.
DRIVER_LINKS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes) -> tuple[int, np.ndarray]:
    """(hash of the word sequence, distinct hashes of the shingles in order of size)."""
    content, parts = xxhash.xxh3_64(), []
    for words in pieces(data):
        if words:
            content.update(b" ".join(words) + b" ")
            parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
    c = content.intdigest()
    h = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    if len(h) < SHINGLE:
        return c, np.array([c], dtype=np.uint64)
    n = len(h) - SHINGLE + 1
    x = h[:n].copy()
    for i in range(1, SHINGLE):
        x = (x ^ (x >> np.uint64(29))) * _MIX + h[i : i + n]
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return c, np.unique(x ^ (x >> np.uint64(29)))


def least_common(n: int) -> int:
    """Shingles that a text of ``n`` shingles has in common with a text as similar as ``LEAST``."""
    return (4 * n + 4) // 5


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def keys_of(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order of (rank of the bucket, hash): those that a text as similar must have one of."""
    return s[np.lexsort((s, rank[bucket(s)]))[: len(s) - least_common(len(s)) + 1]]


def scanned(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(rows (id, h1, h2, c, n, fp), rank by bucket) of rows (id, h1, h2, text), in one scan.

    Each task counts its shingles by bucket; the counts are rows of the same table, in chunks, and are added up in two levels.
    """
    kind = own.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(1 << BUCKET_BITS, dtype=np.int64), ["id", "h1", "h2", "c", "n", "fp", "chunk", "part", "counts"]
        mark, id_type = 0, None
        for batch in sliced(batches):
            got = [shingles(x.as_py() or b"") for x in batch.column(3)]
            if not got:
                continue
            id_type = batch.schema.field(0).type
            c = np.array([g[0] for g in got], dtype=np.uint64).view(np.int64)
            fp = np.array([majority([g[1]]) for g in got], dtype=np.uint64).view(np.int64)
            np.add.at(counts, np.concatenate([bucket(g[1]) for g in got]), 1)
            mark ^= int(c[0])
            columns = [pa.array(c), pa.array([len(g[1]) for g in got], pa.int64()), pa.array(fp)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, *(pa.nulls(len(c), t) for t in (pa.int32(), pa.int32(), pa.binary()))], names=names)
        chunks = counts.reshape(-1, 1 << CHUNK_BITS)
        used = np.flatnonzero(chunks.any(axis=1))
        if len(used):
            none = [pa.nulls(len(used), t) for t in (id_type, *[pa.int64()] * 5)]
            parts = pa.array(np.full(len(used), mark % SPREAD, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), parts, pa.array([chunks[i].tobytes() for i in used], pa.binary())], names=names)

    def total(table: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("counts"))
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([added.tobytes()], pa.binary())})

    everything = scratch.stored(own.mapInArrow(scan, f"id {kind}, h1 bigint, h2 bigint, c bigint, n bigint, fp bigint, chunk int, part int, counts binary"), "scanned")
    added = everything.where("chunk is not null").select("chunk", "part", "counts")
    for by in (["chunk", "part"], ["chunk"]):
        added = added.groupBy(*by).applyInArrow(total, "chunk int, counts binary")
    counts = np.zeros((1 << (BUCKET_BITS - CHUNK_BITS), 1 << CHUNK_BITS), dtype=np.int64)
    for x in added.collect():
        counts[x["chunk"]] = np.frombuffer(x["counts"], dtype=np.int64)
    return everything.where("chunk is null").select("id", "h1", "h2", "c", "n", "fp"), ranks(counts.ravel())


def ranks(counts: np.ndarray) -> np.ndarray:
    """0 for buckets that may hold only rare shingles, else one more than the logarithm of what exceeds the usual count."""
    usual = np.median(counts)
    excess = np.maximum(counts - usual - 4 * np.sqrt(usual + 1), 0)
    return np.ceil(np.log2(excess + 1)).astype(np.uint8)


def keyed(own: DataFrame, rank: np.ndarray) -> DataFrame:
    """(c, n, keys) of the distinct texts of rows (id, h1, h2, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [shingles(x.as_py() or b"") for x in batch.column(0)]
            c = np.array([g[0] for g in got], dtype=np.uint64).view(np.int64)
            keys = [keys_of(g[1], rank).view(np.int64) for g in got]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array([len(g[1]) for g in got], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["c", "n", "keys"])

    rows = own.select(F.col("text").cast("binary").alias("text")).mapInArrow(scan, "c bigint, n bigint, keys array<bigint>")
    return rows.groupBy("c").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def _sized(a: Column, b: Column) -> Column:
    """Whether the sizes of two sets allow for a similarity of ``LEAST``."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _common(na: Column, nb: Column) -> Column:
    """Least number of shingles in common."""
    return F.ceil((na + nb) * 4 / 9 - 1e-6)


def _room(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether enough shingles are left from a common key on for it to be the first one."""
    return F.least(na - pa_, nb - pb) >= _common(na, nb)


def _pairs_of_few(few: DataFrame, dense: DataFrame) -> DataFrame:
    """Pairs (a, b) of small keys (c, n, pos, key, root) within both bounds; dense keys count as if they were common.

    ``ra`` and ``rb`` tell how much of a and b stands before their first common key.
    """
    blocks = few.groupBy("key").agg(F.collect_list(F.struct("c", "n", "pos", "root")).alias("all"))
    one = blocks.select("all", F.explode("all").alias("x"))
    later = lambda y: (y["c"] > F.col("x.c")) & (y["root"] != F.col("x.root")) & _sized(y["n"], F.col("x.n"))
    pairs = one.select("x", F.explode(F.filter("all", later)).alias("y"))
    room = _room(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    pairs = pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), room.alias("room"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.max("room").alias("room"), *[(F.min(f"p{x}") / F.col(f"n{x}")).alias(f"r{x}") for x in "ab"]).where("room")
    more = dense.groupBy("c").agg(F.count("*").alias("d"))
    pairs = pairs.join(more.select(F.col("c").alias("a"), F.col("d").alias("da")), "a", "left").join(more.select(F.col("c").alias("b"), F.col("d").alias("db")), "b", "left")
    most = F.col("k") + F.least(F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0)))
    enough = _common(F.col("na"), F.col("nb")) + 1 - F.greatest(F.ceil(F.col("na") * 4 / 5 - 1e-6), F.ceil(F.col("nb") * 4 / 5 - 1e-6))
    return pairs.where(most >= enough).select("a", "b", "ra", "rb")


def _drawn(pairs: DataFrame, turn: int) -> DataFrame:
    """One pair for each text that has a less edited partner: that with the least edited (then the most edited) of these."""
    a, b = F.struct(F.col("ra").alias("r"), F.col("a").alias("c")), F.struct(F.col("rb").alias("r"), F.col("b").alias("c"))
    first = (F.col("ra") < F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b")))
    sides = pairs.select(F.when(first, a).otherwise(b).alias("low"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("c"))
    one = sides.groupBy("c").agg((F.max("low") if turn % 2 else F.min("low")).getField("c").alias("x"))
    return one.select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b"))


class Sets:
    """Shingle sets of distinct texts, made from the texts for the pairs that are compared."""

    def __init__(self, own: DataFrame, contents: DataFrame):
        self.own, self.contents = own, contents

    def of(self, pairs: DataFrame) -> DataFrame:
        """(c, s) of all texts in ``pairs``; a text goes through Python where it is."""
        members = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        wanted = cut(self.contents.join(members, "c").select("c", F.col("first.h1").alias("w1"), F.col("first.h2").alias("w2")))
        few = wanted.count() <= BROADCAST_ROWS
        texts = self.own.join(F.broadcast(wanted) if few else wanted, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                sets = [shingles(x.as_py() or b"")[1].view(np.int64) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["c", "s"])

        return texts.select("c", F.col("text").cast("binary").alias("text")).mapInArrow(scan, "c bigint, s array<bigint>")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the written ``pairs`` (a, b) whose sets are as similar as ``LEAST``."""
        sets = self.of(pairs).groupBy("c").agg(F.first("s").alias("s"))  # equal rows give a set each
        a, b = sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return cut(pairs.join(a, "a").join(b, "b").where(both * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b"))


def _printed(contents: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are equal or within two bits: each text with one of its fingerprint, these with each other."""
    prints = cut(contents.groupBy("fp").agg(F.min("c").alias("rep")))
    equal = contents.join(prints, "fp").where("c <> rep").select(F.col("rep").alias("a"), F.col("c").alias("b"))
    near = near_prints(prints.select("fp"))
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(prints.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    return cut(equal.unionByName(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))).distinct())


def _rooted(rows: DataFrame, vertex: str, roots: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of a vertex."""
    own = roots.select(F.col("vertex").alias("__v"), F.col("root").alias("__r"))
    return rows.join(own, F.col(vertex) == F.col("__v"), "left").withColumn(name, F.coalesce("__r", vertex)).drop("__v", "__r")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs that are not connected."""
    return _rooted(_rooted(pairs, "a", roots, "root_a"), "b", roots, "root_b").where("root_a <> root_b").select(*pairs.columns)


def _placed(dense: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (c, n, pos, key, root) of dense keys, without the keys all of whose members are connected."""
    placed = _rooted(dense.drop("root"), "c", roots, "root")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    return cut(placed.join(open_keys, "key"))


def _star(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of the members of a dense key with a centre."""
    order = F.col("pos") / F.col("n") if turn == 0 else F.xxhash64(F.lit(turn), "c").cast("double")
    centres = placed.groupBy("key").agg(F.min(F.struct(order.alias("u"), "c", "n", "pos", "root")).alias("x"))
    far = (F.col("root") != F.col("x.root")) & _sized(F.col("n"), F.col("x.n")) & _room(F.col("n"), F.col("pos"), F.col("x.n"), F.col("x.pos"))
    return placed.join(centres, "key").where(far).select(F.least("c", "x.c").alias("a"), F.greatest("c", "x.c").alias("b"))


def _all_pairs(placed: DataFrame) -> DataFrame:
    """All pairs of dense keys that are not connected and within the first bound."""
    x, y = (placed.select("key", *[F.col(k).alias(f"{k}_{i}") for k in ("c", "n", "pos", "root")]) for i in (0, 1))
    far = (F.col("root_0") < F.col("root_1")) & _sized(F.col("n_0"), F.col("n_1")) & _room(F.col("n_0"), F.col("pos_0"), F.col("n_1"), F.col("pos_1"))
    return x.join(y, "key").where(far).select(F.least("c_0", "c_1").alias("a"), F.greatest("c_0", "c_1").alias("b"))


def all_links(own: DataFrame, contents: DataFrame, rank: np.ndarray, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of contents as similar as ``LEAST`` that connect all such pairs."""
    sets = Sets(own, contents)
    links = sets.verified(_printed(contents))
    keys = scratch.stored(keyed(own, rank), "keyed").select("c", "n", F.posexplode("keys").alias("pos", "key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = scratch.stored(keys.join(counts, "key"), "shared")
    roots = components(links, at_driver=DRIVER_LINKS)
    rooted = _rooted(shared, "c", roots, "root")
    dense = rooted.where(F.col("m") > CAP)
    pairs = cut(_pairs_of_few(rooted.where(F.col("m") <= CAP), dense))
    dense = cut(dense.select("c", "n", "pos", "key"))
    scratch.discard("keyed", "shared")
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        placed = _placed(dense, roots)
        one = pairs.select("a", "b").unionByName(_all_pairs(placed)) if last else _drawn(pairs, turn).unionByName(_star(placed, turn))
        tries = cut(one.distinct())
        if tries.isEmpty():
            continue
        links = links.unionByName(sets.verified(tries))
        if last:
            break
        roots = components(links, at_driver=DRIVER_LINKS)
        pairs = cut(_apart(pairs.join(tries, ["a", "b"], "left_anti"), roots))
    return links


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, h1, h2, g1, g2); h1 and h2 tell rows apart, g1 and g2 are those of the group's first row."""
    own = docs.select(F.col(id_col).alias("id"), *[k.alias(n) for k, n in zip(row_key(F.col(id_col), F.col(text_col)), ("h1", "h2"))], F.col(text_col).cast("binary").alias("text"))
    scratch = Scratch(docs.sparkSession)
    rows, rank = scanned(own, scratch)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")).alias("first")
    contents = cut(rows.groupBy("c").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp")))
    roots = components(all_links(own, contents, rank, scratch), at_driver=DRIVER_LINKS)
    linked = contents.join(roots, F.col("c") == F.col("vertex")).select("c", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("group_first"))
    known = contents.select("c", "first").join(linked.join(least, "root").select(F.col("c").alias("lc"), "group_first"), F.col("c") == F.col("lc"), "left")
    known = known.select(F.col("c").alias("kc"), F.coalesce("group_first", "first").alias("g"))
    return rows.join(known, F.col("c") == F.col("kc")).select("id", "h1", "h2", F.col("g.h1").alias("g1"), F.col("g.h2").alias("g2"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row (by id) of each group; texts are shuffled only if there are equal rows."""
    found = cut(groups(docs, id_col=id_col, text_col=text_col))
    others = found.where((F.col("h1") != F.col("g1")) | (F.col("h2") != F.col("g2"))).select(F.col("h1").alias("__o1"), F.col("h2").alias("__o2")).distinct()
    others = cut(others)
    h1, h2 = row_key(docs[id_col], docs[text_col])
    kept = docs.join(F.broadcast(others) if others.count() <= BROADCAST_ROWS else others, (h1 == F.col("__o1")) & (h2 == F.col("__o2")), "left_anti")
    equal = found.where((F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    if equal.isEmpty():
        return kept
    marked = kept.withColumn("__k1", h1).withColumn("__k2", h2)
    return marked.dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
