"""Trained operators, near-duplicate groups and the pipeline."""

import math
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphframe.llm import language, licence, linear, quality, rules, similar
from tests_llm_data import clashing, prose  # noqa: F401


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts of which those with symbols, or a part of symbols, are bad."""
    r = random.Random(1)
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        text = "\n".join(prose(r, r.randrange(8, 30)) + "." for _ in range(r.randrange(3, 12)))
        if not good:
            parts = text.split("\n")
            k = r.randrange(len(parts))
            parts[k:] = [x.replace(" ", "*** ") for x in parts[k:]] * 3
            text = "\n".join(parts)
        rows.append((i, text, "en", "s"))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    return docs, spark.createDataFrame(marks, "doc_id long, quality int").cache(), rows, dict(marks)


def test_quality(spark, labelled):
    docs, marks, rows, truth = labelled
    train = marks.where(~quality.held_out(F.col("doc_id")))
    assert {r[0] for r in train.select("doc_id").collect()} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 != 1}
    model = quality.train(docs, train)
    extra = spark.createDataFrame([(900, None), (901, ""), (902, "x" * 100_000), (None, "hello there")], "doc_id long, text string")
    got = quality.score(clashing(docs.select("doc_id", "text").unionByName(extra)), model).collect()
    scores = {r["id"]: r["score"] for r in got}
    assert len(got) == 404 and all(0 <= x <= 1 for x in scores.values()) and scores[900] == scores[901]
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((scores[i] >= 0.5) == truth[i] for i in held) >= 0.95 * len(held)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in truth if scores[i] >= 0.5}
    assert quality.train(docs, marks.where("quality = 1")) == 1.0 and quality.train(docs, marks.where("false")) == 0.5
    assert quality.score(docs, 0.25).first()["score"] == 0.25
    assert quality.score(docs.where("false"), model).count() == 0


def test_quality_gradients():
    r = np.random.default_rng(0)
    n = quality.Network.start(3)
    texts, y = [quality.blocks(bytes(r.integers(32, 127, 400, dtype=np.uint8))) for _ in range(3)], np.array([0.0, 1.0, 1.0])
    grad = n.gradients(texts, y)

    def loss():
        n._tables = None
        p = np.array([n.score(bytes(t[:400])) for t in texts])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("out", "hidden", "bias", "filter"):
        flat, g = n.w[name].ravel(), grad[name].ravel()
        k = int(np.abs(g).argmax())
        old, step = flat[k], 1e-3
        flat[k] = old + step
        up = loss()
        flat[k] = old - step
        down = loss()
        flat[k] = old
        assert abs((up - down) / (2 * step) - g[k]) < 0.1 * abs(g[k]) + 1e-3


def slow_score(n, data):
    """The network as plain convolutions over overlapping chunks."""
    steps = max(2, -(-len(data) // quality.STEP))
    padded = data + b"\0" * (steps * quality.STEP + quality.WIDTH - len(data))
    features = []
    for at in range(0, (steps - 1) * quality.STEP, quality.STEP):
        windows = [padded[i : i + quality.WIDTH] for i in range(at, at + quality.CHUNK)]
        z = [sum(n.w["embed"][b] @ n.w["filter"][j] for j, b in enumerate(w)) for w in windows]
        chunk = np.maximum(np.max(z, axis=0) + n.w["bias"], 0)
        features.append(np.maximum(chunk @ n.w["hidden"] + n.w["hidden_bias"], 0))
    logit = np.max(features, axis=0) @ n.w["out"] + n.w["out_bias"][0] + n.prior
    return 1 / (1 + np.exp(-logit))


def test_quality_scores_against_brute_force(spark, monkeypatch):
    n = quality.Network.start(5)
    n.prior = 0.3
    texts = ["", "a", "short text", "x" * 255, "y" * 256, "z" * 257, "Über öl " * 90, "tab\tline\n" * 40]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for piece in (64, 1):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert all(abs(n.score(t.encode()) - slow_score(n, t.encode())) < 1e-5 for t in texts)
    got = {r["id"]: r["score"] for r in quality.score(docs, n).collect()}
    assert all(abs(got[i] - slow_score(n, t.encode())) < 1e-5 for i, t in enumerate(texts)) and got[8] == got[0]
    by_column = docs.select("doc_id", quality.probability(n, F.col("text")).alias("p")).collect()
    assert {r["doc_id"]: r["p"] for r in by_column} == got


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


def test_rules(spark, labelled, monkeypatch):
    docs, marks, rows, truth = labelled
    model = rules.train(docs, marks)
    extra = [(900, None), (901, ""), (902, " \n\t\n"), (903, "a b c " * 40), (904, "é ü\n" * 60), (905, "x|y " * 10 + "\nx|y\nx|y")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["id"]: r for r in rules.evaluate(clashing(table), model).collect()}
    texts = {i: t for i, t, *_ in rows} | dict(extra)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert all(tuple(got[i][n] for n in names) == slow_counts(t) for i, t in texts.items())
    assert all(not r["kept"] for r in got.values() if r["base_failed"])
    free = [i for i in truth if not got[i]["base_failed"] and truth[i]]
    assert sum(got[i]["kept"] for i in free) >= 0.98 * len(free)
    mostly_bad = [i for i in truth if not truth[i] and not got[i]["base_failed"] and texts[i].count("***") > 0.8 * got[i]["n_words"]]
    assert not any(got[i]["kept"] for i in mostly_bad)
    assert all(r["kept"] != r["base_failed"] for r in rules.evaluate(docs, rules.Crf.flat()).collect())
    monkeypatch.setattr(rules, "PIECE", 16)
    assert rules.repeated_words(b"a b c a b c d") == (7, 6)


def test_viterbi_is_best():
    r = np.random.default_rng(2)
    model = rules.Crf(r.normal(size=(2, rules.N_FEATURES)), r.normal(size=(2, 2)))
    for n in (1, 2, 6):
        x = r.normal(size=(n, rules.N_FEATURES))
        u = x @ model.unary.T
        score = lambda y: sum(u[i, y[i]] for i in range(n)) + sum(model.step[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max((tuple(int(b) for b in f"{k:0{n}b}") for k in range(1 << n)), key=score)
        assert tuple(model.viterbi(x)) == best


def test_crf_learns_transitions():
    r = np.random.default_rng(3)
    xs, ys = [], []
    for _ in range(60):
        y = np.repeat(r.integers(0, 2, 4), 5)
        x = np.zeros((20, rules.N_FEATURES))
        x[:, 0], x[:, 1] = 1, y + r.normal(0, 0.8, 20)
        xs.append(x)
        ys.append(y)
    model = rules.Crf.flat().fit(xs, ys)
    right = np.mean([np.mean(model.viterbi(x) == y) for x, y in zip(xs, ys)])
    alone = np.mean([np.mean((x[:, 1] > 0.5) == y) for x, y in zip(xs, ys)])
    assert right > alone + 0.05


def test_language(spark):
    r = random.Random(4)
    syllables = {"aa": ["ka", "ki", "ku", "ko"], "bb": ["str", "sch", "ung", "heit"], "cc": ["ção", "lho", "nha", "õe"]}
    word = lambda k: "".join(r.choice(syllables[k]) for _ in range(r.randrange(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(r.randrange(3, 40))), k) for i in range(240) for k in [list(syllables)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id % 2 = 0"))
    extra = spark.createDataFrame([(900, None, None), (901, "", "aa"), (902, "123 !?", "aa"), (903, "kaki " * 300_000, "aa")], "doc_id long, text string, lang string")
    got = {x["id"]: x for x in language.identify(clashing(docs.unionByName(extra)), model).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows) >= 0.98 * len(rows)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language.train(docs.where("false")).predict("text") == ("und", 0.0)
    assert language.train(docs.where("lang = 'aa'")).predict("kaki") == ("aa", 1.0)


def slow_grams(text):
    """Hashed n-grams, one at a time."""
    mask, mix = (1 << 32) - 1, [int(x) for x in language._MIX]
    c = [ord(x) if x.isalpha() or unicodedata.category(x)[0] == "M" else 32 for x in "".join(y.replace("\u03a3", "\u03c3").lower() for y in text)]
    out = Counter()
    for i in range(len(c)):
        h = c[i] * mix[0] & mask
        grams = [h]
        for k, m in ((1, mix[1]), (2, mix[2])):
            if i + k < len(c):
                h = ((h ^ h >> 15) * m + c[i + k] * mix[0]) & mask
                grams.append(h)
        out.update(((g ^ g >> 16) * mix[1] & mask) >> (32 - language.BITS) for g in grams)
    return out


def test_pieces_count_as_the_whole(monkeypatch):
    for text in ("Héllo wörld, " * 20, "", "a", "ΟΔΟΣ. İstanbul «9» e\u0301—x " * 9, "ab"):
        want = slow_grams(text)
        for piece in (1 << 20, 50, 3, 1):
            monkeypatch.setattr(language, "PIECE", piece)
            got = language.counts(text)
            assert {i: int(got[i]) for i in np.flatnonzero(got)} == want, (text[:20], piece)


def test_language_against_brute_force(spark):
    """Scores from the counts by loops over the features."""
    rows = [(i, ("der und die " if i % 2 else "the and of ") * (1 + i % 5) + f"x{i}", "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {x["id"]: x for x in language.identify(docs, model).collect()}
    for i, text, _ in rows:
        tfidf = {k: (1 + math.log(n)) * model.idf[k] for k, n in slow_grams(text).items()}
        norm = math.sqrt(sum(v * v for v in tfidf.values()))
        logits = [sum(v / norm * model.weights[k, j] for k, v in tfidf.items()) / model.temperature for j in range(2)]
        top = max(logits)
        p = [math.exp(x - top) for x in logits]
        best = p.index(max(p))
        assert got[i]["lang_pred"] == model.classes[best] and abs(got[i]["score"] - p[best] / sum(p)) < 1e-9


def test_temperature_and_penalty():
    r = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(400):
        y = int(r.integers(0, 2))
        noise = int(r.integers(2, 50))
        rows.append((np.array([y, noise]), np.array([1.0, 1.0])))
        labels.append(y if r.random() < 0.8 else 1 - y)
    model = linear.SparseSoftmax(50, ["a", "b"], l1=4.0).fit(rows, labels)
    w = model.weights()
    assert (w[2:] == 0).mean() > 0.5 and w[0, 0] > w[0, 1]
    p = np.mean([linear.softmax((v @ w[i]) / model.temperature).max() for i, v in rows])
    assert 0.65 < p < 0.95


def test_licences(spark):
    r = random.Random(6)
    notices = {
        "apache": "Licensed under the Apache License, Version 2.0.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "mit": "Released under the MIT License.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        "all-rights-reserved": "All rights reserved.",
        "": "The version of the license that you may use is reserved for the public.",
    }
    rows = [(i, f"{prose(r, 30)}\n{notices[k]}\n{prose(r, 5)}", k) for i in range(36) for k in [list(notices)[i % 6]]]
    rows += [(90, None, ""), (91, "", ""), (92, notices["mit"] + "\n" + notices["gpl"], "gpl,mit")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = {x["id"]: x for x in licence.scan(clashing(docs), licence.train(docs)).collect()}
    assert {i: got[i]["families"] for i, *_ in rows} == {i: k for i, _, k in rows}
    assert got[92]["n_licence"] == 2 and got[90]["n_paragraphs"] == 0
    assert licence.train(None).scan(notices["mit"])[2] == "mit"
    assert licence.scan(docs.where("false"), licence.train(docs.where("false"))).count() == 0


def test_wrapped_and_long_licences(spark):
    scanner = licence.train(None)
    isc = "Permission to use, copy, modify, and/or distribute this\nsoftware for any\npurpose with or without fee is hereby granted"
    assert scanner.scan(isc)[:3] == (1, 1, "isc")
    assert scanner.scan(isc.replace("\n", "\n\n"))[1] == 0
    assert scanner.scan(f"some words\nhere {isc}\nand more\n\nAll rights reserved.")[1:3] == (2, "all-rights-reserved,isc")
    assert scanner.scan("Released under\nthe MIT\nLicense\nReleased under the Apache License 2.0")[2] == "apache,mit"
    assert scanner.scan("plain words " * 50_000 + "\nReleased under the MIT License")[:3] == (2, 1, "mit")
    assert scanner.scan("the license of the public terms\nis a general matter\nof permission")[1] == 0
    family, p = scanner.classify(["nothing", "like", "it"])
    assert family == licence.UNKNOWN and 0 < p < 1
    assert all(any(len(w) >= licence.LONG_WORD for w in licence.words_of(t)) for v in licence.TEMPLATES.values() for t in v)
    rows = [(1, isc), (1, isc), (2, None)]
    got = licence.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()
    assert sorted((x["id"], x["n_licence"]) for x in got) == [(1, 1), (1, 1), (2, 0)]


def test_licence_scores_against_brute_force():
    """Probabilities from all n-grams by loops, and cover by counting."""
    scanner = licence.train(None)
    for text in ("Released under the MIT License", "licensed under the GNU Lesser General Public License, version 2.1 or so", "All wrongs reserved"):
        words = licence.words_of(text)
        grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        found = [scanner.weights[g] for g in grams if g in scanner.weights]
        logits = list(scanner.bias)
        for pairs in found:
            for k, w in pairs:
                logits[k] += w / math.sqrt(len(found))
        e = [math.exp(x / scanner.temperature) for x in logits]
        family, p = scanner.classify(words)
        assert scanner.classes[e.index(max(e))] == family and abs(max(e) / sum(e) - p) < 1e-9
        if family != licence.UNKNOWN:
            best = 0.0
            for t in licence.TEMPLATES[family]:
                own = licence.words_of(t)
                all_ = {" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)}
                best = max(best, len(all_ & grams) / len(all_))
            assert abs(scanner.confirmed(family, words) - best) < 1e-12


def similarity(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("cap", [64, 6, 2])
def test_similar_groups(spark, monkeypatch, cap):
    monkeypatch.setattr(similar, "CAP", cap)
    r = random.Random(7)
    rows, i = [], 0
    for _ in range(12):
        own = prose(r, 200, 5000).split()
        rows.append((i := i + 1, " ".join(own)))
        for _ in range(8):
            edited = list(own)
            for k in r.sample(range(200), 3):
                edited[k] = f"new{r.randrange(9999)}"
            rows.append((i := i + 1, " ".join(edited)))
    rows += [(i := i + 1, prose(r, 150, 5000)) for _ in range(30)]
    rows += [(500, rows[0][1]), (501, rows[0][1].translate(str.maketrans("w", "W"))), (502, None), (503, ""), (504, "a b"), (505, "a b"), (505, "a b"), (506, "a c")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = similar.one_of_each(docs)
    ids = sorted(x["doc_id"] for x in kept.collect())
    firsts = [1 + 9 * g for g in range(12)]
    assert kept.columns == docs.columns
    assert set(firsts) <= set(ids) and set(range(109, 139)) <= set(ids)
    assert not [x for x in ids if x < 109 and x not in firsts]
    assert [x for x in ids if x >= 500] == [502, 504, 506]
    assert similar.one_of_each(docs.where("false")).count() == 0


@pytest.mark.parametrize(("cap", "rounds"), [(64, 4), (2, 1), (2, 0)])
def test_similar_groups_against_brute_force(spark, monkeypatch, cap, rounds):
    """Edited, cut and extended copies, texts that share most of a passage, and chains: all links, and no others."""
    monkeypatch.setattr(similar, "CAP", cap)
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    r, texts = random.Random(13), []
    passage = prose(r, 60, 900)
    for _ in range(40):
        base = (passage + " " + prose(r, r.randrange(1, 40), 900) if r.random() < 0.5 else prose(r, r.randrange(5, 120), 900)).split()
        texts.append(" ".join(base))
        for _ in range(r.randrange(5)):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"e{r.randrange(99)}"
            a, b = r.randrange(1 + len(words) // 12), r.randrange(1 + len(words) // 12)
            texts.append(" ".join(words[a : len(words) - b] + prose(r, r.randrange(4), 900).split()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and up[i] != up[j]:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    ids = {}
    for x in similar.groups(docs).collect():
        ids.setdefault((x["g1"], x["g2"]), []).append(x["id"])
    assert sorted(map(sorted, ids.values())) == sorted([k for k, u in enumerate(up) if u == root] for root in set(up))
    assert len(ids) < 0.8 * len(texts)


def test_shingle_order_covers_all_texts(spark):
    r = np.random.default_rng(5)
    counts = r.poisson(30, 1 << similar.BUCKET_BITS)
    counts[7] = 900
    rank = similar.ranks(counts)
    assert rank[7] >= 9 and (rank > 0).mean() < 0.01
    s = np.unique(r.integers(0, 1 << 62, 100).astype(np.uint64) << np.uint64(2))
    rank[similar.bucket(s[:1])] = 12
    keys = similar.keys_of(s, rank)
    assert len(keys) == len(s) - similar.least_common(len(s)) + 1 and s[0] not in keys


def test_similar_chains(spark):
    """Each text of a chain resembles only its neighbours, and many share their keys."""
    r, rows = random.Random(11), []
    for g in range(2):
        words = prose(r, 200, 5000).split()
        for k in range(15):
            rows.append((100 * g + k, " ".join(words)))
            for at in (5, 70, 135):
                words[at + 4 * k] = f"new{g}x{k}x{at}"
    assert similarity(rows[0][1], rows[1][1]) >= 0.8 > similarity(rows[0][1], rows[2][1])
    kept = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 100]


def test_similar_shortened(spark):
    """Copies without their tail, at a similarity of 0.8 to 0.83."""
    r, rows = random.Random(12), []
    for g in range(80):
        words = prose(r, 200, 5000).split()
        rows += [(g, " ".join(words)), (1000 + g, " ".join(words[: 162 + g % 5]))]
    assert all(0.8 <= similarity(rows[i][1], rows[i + 1][1]) < 0.83 for i in range(0, 160, 2))
    kept = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(80))


def test_pipeline(spark, tmp_path, labelled):
    docs, marks, rows, truth = labelled
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[1][1].split("\n")[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table, last = docs, None
    for name, stage in corpus_pipeline.STAGES:
        last, table = table, stage(spark, table, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(table.columns) == set(docs.columns), name
    assert {"doc_id", "text", "shard"} <= set(table.columns)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in last.collect())


def test_stages_take_any_rows(spark, tmp_path, labelled):
    docs, marks, rows, truth = labelled
    marks.unionByName(spark.createDataFrame([(None, 1), (3, None), (3, 0)], "doc_id long, quality int")).write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))  # the mixture's weights come from a classifier of all documents
    spark.createDataFrame([(1, "some words"), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(None, None, None, None), (1000, None, "en", "s"), (1001, "", None, None), (1002, "long words " * 30_000, "en", "s"), (1003, "a b c", "en", "s"), (1003, "a b c", "en", "s"), (None, "x y", "en", None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
    table = clashing(docs.limit(30).unionByName(odd))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, table, str(tmp_path))
        assert set(out.columns) >= set(table.columns) - {"shard"} and out.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == table.columns, name
        assert stage(spark, table.where("false"), str(tmp_path)).count() == 0, name
    name, stage = corpus_pipeline.STAGES[0]
    whole = clashing(docs.unionByName(odd))
    assert stage(spark, whole, str(tmp_path)).columns == whole.columns
    assert stage(spark, whole.where("false"), str(tmp_path)).count() == 0


def test_quality_tables_are_made_in_place():
    """A worker holds the tables of a model once, not twice while they are made."""
    network = quality.Network.start()
    single = np.einsum("be,jef->jbf", network.w["embed"], network.w["filter"]).astype(np.float32)
    tracemalloc.start()
    tables = network.tables()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.25 * tables.nbytes and tables.shape == (quality.WIDTH // 2, 65536, quality.FILTERS)
    for j in range(quality.WIDTH // 2):
        assert (tables[j].reshape(256, 256, -1) == single[2 * j][:, None, :] + single[2 * j + 1][None, :, :]).all()
