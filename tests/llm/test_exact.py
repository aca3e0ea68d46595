"""Operators with exact results, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphframe.llm import decontaminate, difference_cover, golay, graph, lines, mixing, sharding, simhash, suffixes
from tests_llm_data import clashing, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


def corpus(seed=1, n=60):
    """Texts with copies, edits, shared passages, nulls and empties."""
    r = random.Random(seed)
    shared = prose(r, 40)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            text = prose(r, r.randrange(5, 200))
        elif kind == 1:
            text = out[r.randrange(len(out))][1]
        elif kind == 2:
            words = (out[r.randrange(len(out))][1] or "x").split()
            words[r.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif kind == 3:
            text = f"{prose(r, 20)}\n{shared}\n{prose(r, 20)}"
        else:
            text = prose(r, 3)
        out.append((i, text, "en", f"s{r.randrange(5)}"))
    out += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, "  \n", "en", None), (n + 3, None, "en", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


# Sharding


def test_shards_are_even_and_gapless(docs):
    placed, slot_map = sharding.place(docs, 4, n_slots=256)
    rows = placed.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in rows)
    for shard in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    by_id = {r["doc_id"]: r for r in rows}
    for i, text, *_ in corpus():
        data = (text or "").encode()
        assert (by_id[i]["size"], by_id[i]["text_crc32"]) == (len(data) + 16, zlib.crc32(data))


def test_shards_of_repeated_and_clashing_rows(spark, docs):
    twice = docs.unionByName(docs.where("doc_id < 5"))
    rows = sharding.place(clashing(twice), 3, n_slots=64)[0].collect()
    assert len(rows) == docs.count() + 5
    for shard in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert sharding.place(docs.where("false"), 3)[0].count() == 0
    kept = sharding.with_shard(clashing(docs), 3)
    assert kept.count() == docs.count() and {"text", "shard", "virtual_slot"} <= set(kept.columns)


def test_maps_are_versioned_and_growth_moves_only_in(spark, tmp_path):
    r = random.Random(3)
    sizes = [r.randrange(1, 5000) for _ in range(512)]
    first = sharding.SlotMap.initial(512, 8)
    second = first.rebalanced(sizes)
    loads = second.loads(sizes)
    assert (first.version, second.version) == (0, 1) and max(loads) - min(loads) <= 5
    moved = sum(a != b for a, b in zip(first.shard_of, second.shard_of))
    assert moved < 512 / 2
    third = second.grown(sizes)
    assert all(b in (a, 8) for a, b in zip(second.shard_of, third.shard_of)) and third.n_shards == 9
    assert abs(third.loads(sizes)[8] - sum(sizes) / 9) <= max(sizes)
    for m in (first, second, third):
        m.store(spark, str(tmp_path / "maps"))
    assert sharding.load_map(spark, str(tmp_path / "maps"), 1) == second


# Mixing


def filled(sizes, weights, share, most):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixture(docs):
    got = mixing.mix(docs).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in corpus()}
    assert {r["doc_id"]: r["size"] for r in got} == words
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = filled(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST_EPOCHS)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in sizes), (taken, want)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixture_edges(docs, monkeypatch):
    rows = mixing.mixed_rows(clashing(docs))
    times = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    found = Counter(r["doc_id"] for r in rows.collect())
    assert found == Counter({k: v for k, v in times.items() if v})
    assert rows.columns == clashing(docs).columns
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("text is null")).agg(F.sum("taken")).first()[0] == 0
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == want


# Decontamination


def contaminated(rows, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = find(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, ids = find(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    ids |= found
                    hit.update(range(k, k + m))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [None, 0])
def test_benchmark_passages(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    r = random.Random(5)
    passages = [prose(r, 30) for _ in range(6)]
    items = list(enumerate(passages)) + [(6, passages[0]), (7, "Short item words"), (8, "one"), (9, None), (10, ""), (None, passages[5])]
    rows = []
    for i in range(40):
        text = prose(r, r.randrange(0, 120))
        if i % 3 == 0:
            p = passages[r.randrange(6)].split()
            a = r.randrange(10)
            text += " " + " ".join(p[a : a + r.randrange(11, 18)]) + " " + prose(r, 10)
        if i % 7 == 0:
            text += " SHORT item, words"
        if i % 11 == 0:
            text = "to " * 40 + text
        rows.append((i, text))
    rows += [(50, None), (51, ""), (52, "one"), (1, "Short ITEM words"), (53, passages[2]), (53, passages[2])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(clashing(docs), bench)
    assert sorted(map(tuple, got.collect()), key=repr) == contaminated(rows, items)
    left = decontaminate.decontaminate(docs, bench)
    passages_only = [x for x in items if len((x[1] or "").split()) >= 13]
    bad = Counter(x[0] for x in contaminated(rows, items) if x[5]) | Counter(x[0] for x in contaminated(rows, passages_only) if x[2])
    assert Counter(x["doc_id"] for x in left.collect()) == Counter(x[0] for x in rows) - bad
    again = decontaminate.find(left, spark.createDataFrame(passages_only, "item_id long, text string"))
    assert again.where("n_hit > 0").count() == 0
    assert decontaminate.report(docs.where("false"), bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("n_hit > 0").count() == 0


# Lines


@pytest.mark.parametrize("bound", [500_000, -1])
def test_lines(spark, monkeypatch, bound):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", bound)
    r = random.Random(2)
    common = [f"line {i}" for i in range(12)]
    rows = []
    for i in range(80):
        text = "\n".join([*(c + " " * r.randrange(2) for c in common if r.random() < 0.3), f"own {i}", "", *common[:1]])
        rows.append((i, text, "en", f"s{r.randrange(9)}" if i % 10 else None))
    rows += [(90, None, "en", "s0"), (91, "", "en", "s0"), (0, "line 0", "en", "s0"), (0, "line 0", "en", "s0")]
    for least in (4, 8, 9):
        spread = {}
        for _, t, _, src in rows:
            for x in (t or "").split("\n"):
                if x.strip(" \t\n\x0b\x0c\r"):
                    spread.setdefault(x.strip(" \t\n\x0b\x0c\r"), set()).add(src)
        gone = {x for x, sites in spread.items() if len(sites) >= least}
        want = []
        for i, t, *_ in rows:
            own = [] if t is None else t.split("\n")
            kept = [x for x in own if x.strip(" \t\n\x0b\x0c\r") not in gone]
            want.append((i, None if t is None else "\n".join(kept), len(own), len(own) - len(kept)))
        got = lines.dedup_lines(clashing(spark.createDataFrame(rows, DOCS)), least_sites=least)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert lines.dedup_lines(spark.createDataFrame(rows, DOCS).where("false")).count() == 0


# SimHash


def slow_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    votes = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def slow_components(edges, vertices):
    up = {v: v for v in vertices}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {v: find(v) for v in vertices}


def test_golay_indices_are_shared():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 23, 3000)
    for flips in (0, 1, 2):
        b = a.copy()
        for row in range(len(b)):
            for bit in r.choice(23, flips, replace=False):
                b[row] ^= 1 << int(bit)
        for x, y in zip(golay.indices(a), golay.indices(b)):
            assert set(x[x >= 0]) & set(y[y >= 0])
    sizes = (golay.indices(np.arange(1 << 12)) >= 0).sum(axis=1)
    assert set(sizes) == {1, 6}


@pytest.mark.parametrize("cap", [16, 2, 0])
def test_links_within_two_bits(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "CAP", cap)
    r = random.Random(4)
    prints = {r.getrandbits(64) for _ in range(40)}
    for f in list(prints)[:12]:
        for _ in range(12):
            prints.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.choice((0, 1 << r.randrange(64)))))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = slow_components([tuple(x) for x in found.collect()], signed)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    want = slow_components(near, signed)
    assert got == want and len(set(want.values())) < len(signed)


def test_simhash_groups(spark, docs):
    got = {r["id"]: r for r in simhash.near_duplicates(clashing(docs)).collect()}
    prints = {i: slow_print(t) for i, t, *_ in corpus()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(near, ids)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    r = random.Random(8)
    text = prose(r, 500)
    for piece in (64, 7, 1):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode(), 3) == slow_print(text)


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    got = {x["vertex"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = slow_components(edges, {v for e in edges for v in e})
    assert got == {v: root for v, root in want.items() if v in got} and {v for v in want if want[v] != v} <= set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_connected_on_the_driver(spark):
    """The same components as by rounds, without their plans."""
    r = random.Random(16)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1060)] + [(r.randrange(-400, 0), r.randrange(-400, 0)) for _ in range(220)] + [(5, 5), (7, 6), (5000, 5000)]
    r.shuffle(edges)
    table = spark.createDataFrame(edges, "a long, b long")
    want = slow_components(edges, {v for a, b in edges if a != b for v in (a, b)} | {5000})
    for at_driver, most in ((0, 1000), (len(edges), 12)):
        spark.sparkContext.setJobGroup(f"edges-{at_driver}", "")
        found = graph.components(table, at_driver=at_driver)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found.columns == ["vertex", "root"] and len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"edges-{at_driver}")) <= most
        got = found.collect()
        assert len(got) == len(want) - 1 and {x["vertex"]: x["root"] for x in got} | {5000: 5000} == want
    assert graph.components(table.where("a = b"), at_driver=9).count() == 0


# Repeated strings


def slow_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            part = data[k : k + 100]
            if part in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rows", "size", "piece"), [(20_000, 1 << 25, 1 << 18), (1, 1 << 25, 300), (20_000, 200, 150)])
def test_repeats(spark, monkeypatch, rows, size, piece):
    monkeypatch.setattr(suffixes, "CLASS_ROWS", rows)
    monkeypatch.setattr(suffixes, "CLASS_BYTES", size)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "CHUNK", 2000)
    r = random.Random(9)
    texts = [(i, t) for i, t, *_ in corpus(7, 40)]
    texts += [(100, "ab" * 300), (101, "ab" * 120), (102, "x" * 99), (103, "x" * 100), (104, "x" * 101), (105, prose(r, 900)), (106, "xyz1 " * 60), (107, prose(r, 40) + "q1 " * 50), (None, texts[0][1])]
    got = suffixes.remove_repeats(clashing(spark.createDataFrame(texts, "doc_id long, text string")))
    assert sorted(map(tuple, got.collect()), key=repr) == slow_repeats(texts)
    again = spark.createDataFrame(texts + texts[:1], "doc_id long, text string")
    assert suffixes.remove_repeats(again).count() == len(texts) + 1
    assert suffixes.remove_repeats(again.where("false")).count() == 0


@pytest.mark.parametrize("text", ["banana" * 5, "abcabcabd" + "mississippi" * 3, "zyxwvutsrqponm", "aaaaaaaaaaaaaaaa", "ab" * 8 + "c"])
def test_suffix_array(spark, monkeypatch, text):
    monkeypatch.setattr(difference_cover, "SMALL", 9)
    df = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text)], "pos long, c long")
    got = {r["pos"]: r["place"] for r in difference_cover.suffix_places(df).collect()}
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert got == {i: k for k, i in enumerate(order, 1)}
    assert difference_cover.suffix_places(df.where("false")).count() == 0


@pytest.mark.parametrize(("text", "length"), [("banana" * 5, 4), ("abcabcabd" + "mississippi" * 3, 5), ("aaaaaaaaaaaaaaaa", 3), ("zyxwvutsrqponm", 2), ("abcd" * 3 + "bcd", 3)])
def test_neighbours_in_suffix_order(spark, monkeypatch, text, length):
    monkeypatch.setattr(difference_cover, "SMALL", 9)
    df = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text)], "pos long, c long")
    got = {r["pos"] for r in difference_cover.repeated_starts(df, length).collect()}
    assert got == {i for i in range(len(text) - length + 1) if text.find(text[i : i + length]) < i}
    blocks = {r["pos"]: "".join(map(chr, r["prefix"])) for r in difference_cover.prefixes(df, length, 7).collect()}
    assert blocks == {i: text[i : i + length] for i in range(len(text) - length + 1)}
