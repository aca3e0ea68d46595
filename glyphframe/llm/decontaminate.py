"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are hashed in runs of ``K``; of every ``WINDOW - K + 1`` neighbouring hashes the least is
kept.  A run of ``WINDOW`` words that two texts share has the same hashes in both, hence the
same least one, so joining the kept hashes of documents and benchmark misses no shared run.
Each joined hash is then extended to all windows that contain it, and these are compared
word by word.  Items of fewer than ``WINDOW`` words are one window each; for these, and only
if there are any, documents are probed with all runs of that length.

Documents are read once for the hashes; a second time only those with a joined hash are
split into words again.  The benchmark's side is broadcast while its counted size is within
``BROADCAST_ROWS``, else joined by shuffling.  Sets of items are handled as classes (all windows
with the same items are one class), so a passage of many items in many documents does not
multiply.

Edge cases: a null or empty text has no words and is not contaminated; items without words
are never found; an item without id counts as the empty id.  Repeated rows keep their
number.  Empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.common import cut, let, lower_ascii

K = 5
WINDOW = 13
#: What lies between words: anything in ASCII but digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 500_000
PROBES = "array<struct<len:int,pos:int,h:bigint>>"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), GAP), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a hint to broadcast it if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _probes(w: Column, n: Column, lengths: list[int], window: int, k: int) -> Column:
    """Probes (len, pos, h) of words ``w``, ``n`` of them."""
    gram = lambda i, size: F.xxhash64(*[F.get(w, i + j) for j in range(size)])
    place = lambda v: v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

    def winnowed(grams: Column) -> Column:
        # the upper half of a hash beside its place: the least of these is the least hash, leftmost first
        ranked = F.transform(grams, lambda h, i: h.bitwiseAND(F.lit(-1 << 32)).bitwiseOR(i.cast("long")))
        starts = F.sequence(F.lit(1), n - window + 1)
        least = let(ranked, lambda r: F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(r, i, window - k + 1)))))
        return F.transform(least, lambda v: F.struct(F.lit(window).alias("len"), place(v).alias("pos"), F.get(grams, place(v)).alias("h")))

    none = F.array().cast(PROBES)
    out = F.when(n >= window, let(F.transform(F.sequence(F.lit(0), n - k), lambda i: gram(i, k)), winnowed)).otherwise(none)

    def every(size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(F.lit(size).alias("len"), i.cast("int").alias("pos"), gram(i, size).alias("h")))
        return F.when(n >= size, runs).otherwise(none)

    return F.concat(out, *map(every, lengths)) if lengths else out


def _text(w: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(w, at + 1, length), " ")


class Benchmark:
    """Probes, windows and item classes of a benchmark table."""

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__item"), words(F.col(text_col)).alias("__words"))
        rows = cut(rows.where(F.size("__words") > 0))
        n = F.size("__words")
        self.lengths = sorted(r["n"] for r in rows.where(n < window).select(n.alias("n")).distinct().collect())
        # a short item is its own probe
        found = rows.select(let(F.col("__words"), lambda w: _probes(w, F.size(w), [], window, k)).alias("p"))
        probes = found.select(F.explode("p").alias("p")).select("p.len", "p.h")
        for m in self.lengths:
            whole = F.xxhash64(*[F.get("__words", F.lit(j)) for j in range(m)])
            probes = probes.unionByName(rows.where(n == m).select(F.lit(m).alias("len"), whole.alias("h")))
        self.probes = cut(probes.distinct())
        self.n_probes = self.probes.count()
        length = F.least(n, F.lit(window))
        windows = let(F.col("__words"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - length), lambda i: _text(w, i, length)))
        per_item = cut(rows.select("__item", length.alias("len"), F.explode(F.array_distinct(windows)).alias("window")).distinct())
        classes = per_item.groupBy("len", "window").agg(
            F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64("__item")), F.bit_xor(F.xxhash64(F.lit("class"), "__item"))).alias("class")
        )
        self.windows = cut(classes)
        self.n_windows = self.windows.count()
        one = self.windows.groupBy(F.col("class").alias("c")).agg(F.min(F.struct("len", "window")).alias("w"))
        self.class_items = one.join(per_item, (one["w.len"] == per_item["len"]) & (one["w.window"] == per_item["window"])).select(F.col("c").alias("class"), "__item")


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Hits of a benchmark in documents: (id, __h1, __h2, copies, n_words, starts, n_hit, n_items, items_sha256).

    One row for each distinct (id, text), which __h1 and __h2 identify; ``copies`` is how many
    rows it stands for.  ``starts`` has the (start, len) of every window found.
    """
    bench = Benchmark(items, item_id_col, item_text_col, window, k)
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    key = row_key(F.col("__id"), F.col("__text"))
    own = own.select("__id", *key, "__text")
    scan = let(words(F.col("__text")), lambda w: F.struct(F.size(w).alias("n"), _probes(w, F.size(w), bench.lengths, window, k).alias("probes")))
    probed = own.select("__id", "__h1", "__h2", scan.alias("__s"))
    probed = probed.select("__id", "__h1", "__h2", F.col("__s.n").alias("__n"), F.posexplode_outer("__s.probes").alias("__i", "__p"))
    known = bench.probes.select(F.col("len").alias("__klen"), F.col("h").alias("__kh"))
    joined = probed.select("__id", "__h1", "__h2", "__n", "__i", F.col("__p.len").alias("__len"), F.col("__p.pos").alias("__pos"), F.col("__p.h").alias("__h")).join(
        _small(known, bench.n_probes), (F.col("__h") == F.col("__kh")) & (F.col("__len") == F.col("__klen")), "left"
    )
    per_doc = cut(
        joined.groupBy("__h1", "__h2").agg(
            F.min("__id").alias("__id"),
            F.max("__n").alias("n_words"),
            F.sum((F.coalesce(F.col("__i"), F.lit(0)) == 0).cast("long")).alias("copies"),
            F.collect_set(F.when(F.col("__kh").isNotNull(), F.struct(F.col("__len").alias("len"), F.col("__pos").alias("pos")))).alias("__cand"),
        )
    )
    hit = per_doc.where(F.size("__cand") > 0).select(F.col("__h1").alias("__c1"), F.col("__h2").alias("__c2"), "__cand")
    n_cand = hit.agg(F.coalesce(F.sum(F.size("__cand") + 4), F.lit(0))).first()[0]
    texts = own.join(_small(hit, n_cand), (F.col("__h1") == F.col("__c1")) & (F.col("__h2") == F.col("__c2")))


    def tries(w: Column) -> Column:
        """(start, len, window) of all windows that contain a candidate."""
        around = F.transform(
            "__cand",
            lambda c: F.when(
                c["len"] == window,
                F.transform(
                    F.sequence(F.greatest(F.lit(0), c["pos"] - (window - k)), F.least(c["pos"], F.size(w) - window)),
                    lambda s: F.struct(s.alias("start"), F.lit(window).alias("len")),
                ),
            ).otherwise(F.array(F.struct(c["pos"].alias("start"), c["len"].alias("len")))),
        )
        return F.transform(F.array_distinct(F.flatten(around)), lambda a: F.struct(a["start"].alias("start"), a["len"].alias("len"), _text(w, a["start"], a["len"]).alias("window")))

    tried = texts.select("__h1", "__h2", F.explode(let(words(F.col("__text")), tries)).alias("w"))
    tried = tried.select("__h1", "__h2", F.col("w.start").alias("start"), F.col("w.len").alias("len"), F.col("w.window").alias("window"))
    found = (
        tried.join(_small(bench.windows, bench.n_windows), ["len", "window"])
        .groupBy("__h1", "__h2")
        .agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("starts"), F.array_sort(F.collect_set("class")).alias("classes"))
    )
    found = cut(found.withColumn("n_hit", covered(F.col("starts"))).withColumn("combo", F.array_join("classes", ",")))
    combos = found.select("combo", "classes").distinct().select("combo", F.explode("classes").alias("class"))
    digests = (
        combos.join(bench.class_items, "class")
        .groupBy("combo")
        .agg(F.array_sort(F.collect_set("__item")).alias("ids"))
        .select("combo", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    found = found.join(digests, "combo").select(F.col("__h1").alias("__f1"), F.col("__h2").alias("__f2"), "starts", "n_hit", "n_items", "items_sha256")
    return per_doc.join(found, (F.col("__h1") == F.col("__f1")) & (F.col("__h2") == F.col("__f2")), "left").select(
        F.col("__id").alias(id_col),
        "__h1",
        "__h2",
        "copies",
        F.col("n_words").cast("long").alias("n_words"),
        "starts",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
    )


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Two hashes that tell rows of different id or text apart; never null."""
    known = F.coalesce(text, F.lit("\u0000null"))
    return [F.xxhash64(F.lit("row"), id_col, known).alias("__h1"), F.xxhash64(known, id_col, F.lit("key")).alias("__h2")]


def covered(starts: Column) -> Column:
    """Words that sorted windows (start, len) cover, each once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, w: F.struct(
        F.greatest(acc["end"], w["start"] + w["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), w["start"] + w["len"] - F.greatest(acc["end"], w["start"]))).alias("n"),
    )
    return F.aggregate(starts, zero, step, lambda acc: acc["n"].cast("long"))


def is_contaminated() -> Column:
    """At least one hit, and a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row a document: (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    id_col = options.get("id_col", "doc_id")
    found = find(docs, items, **options).withColumn("contaminated", is_contaminated())
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold benchmark text: none that stays has a whole window of an item.

    A window of ``window`` words is reason enough, however long the document.  Items of fewer
    words may be common phrases, so these count only if hits are a twentieth of the words.
    """
    found = find(docs, items, id_col=id_col, text_col=text_col, **options)
    passage = F.coalesce(F.exists("starts", lambda s: s["len"] == options.get("window", WINDOW)), F.lit(False))
    bad = cut(found.where(passage | is_contaminated()).select(F.col("__h1").alias("__b1"), F.col("__h2").alias("__b2")))
    h1, h2 = row_key(docs[id_col], docs[text_col])
    return docs.join(_small(bad, bad.count()), (h1 == F.col("__b1")) & (h2 == F.col("__b2")), "left_anti")
