"""The registered queries of the corpus operators: columns, types and laws of their results, and their SQL."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from glyphframe.llm import queries
from tests_llm_data import prose

COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_lines": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_suffixes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_licences": "doc_id bigint, n_paragraphs bigint, n_licence bigint, families string, score double",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls, empties, repeated rows and a very long text; half of them in one source."""
    r, path = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    passage, rows = prose(r, 30), []
    for i in range(240):
        text = "\n".join(prose(r, r.randrange(4, 30)) + "." for _ in range(r.randrange(1, 8)))
        if i % 4 == 0:
            text = text.replace(" ", "** ") + "\ncommon line"
        if i % 9 == 0:
            text += "\n" + passage + "\nReleased under the MIT License"
        if i % 10 == 9:
            text = rows[-1][1]
        rows.append((i, text, ["en", "de", None][i % 3], "big" if i % 2 else f"s{i % 24}"))
    rows += [(900, None, "en", None), (901, "", None, "big"), (902, "word " * 60_000, "en", "big"), (903, "a\nb", "de", "s1"), (903, "a\nb", "de", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars").write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i % 4 > 0), 0) for i in range(0, 240) if i % 5] + [(900, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "common"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: queries.QUERIES[name](spark, tables[0]).cache() for name in queries.QUERIES}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(results, tables, name):
    got = {f.name: f.dataType.simpleString() for f in results[name].schema}
    want = dict(c.split() for c in COLUMNS[name].split(", "))
    assert {k: got.get(k) for k in want} == want
    assert Counter(r["doc_id"] for r in results[name].collect()) == Counter(r[0] for r in tables[1])


def test_held_out_and_scores(results):
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    for r in results["op1_quality"].collect():
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    for r in results["op9_language"].collect():
        assert r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und")
    undecided = {r["doc_id"] for r in results["op9_language"].collect() if r["lang_pred"] == "und"}
    assert undecided == {900, 901}


def test_shards(results, tables):
    rows = results["op2_sharding"].collect()
    sizes = {i: len((t or "").encode()) + 16 for i, t, *_ in tables[1]}
    assert all(r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["size"] == sizes[r["doc_id"]] and r["grown_shard"] is None for r in rows)
    for shard in range(40):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_mixture_targets(results, tables):
    rows = results["op3_mixing"].collect()
    total = sum(len((t or "").split()) for _, t, *_ in tables[1])
    by_source = {(r["source"], r["source_size"], r["target"]) for r in rows}
    assert sum(x[1] for x in by_source) == total == sum(r["size"] for r in rows)
    assert abs(sum(x[2] for x in by_source) - min(1.5 * total, 2 * total)) < 1e-6 * total
    assert all(x[2] <= 2 * x[1] + 1e-9 for x in by_source) and all(r["taken"] <= 2 * r["size"] for r in rows)


def test_draw_follows_the_classifier(spark, tables, results):
    """Of the source that is drawn from, the taken documents have the better scores."""
    scores = {r["doc_id"]: r["score"] for r in results["op1_quality"].collect()}
    rows = [r for r in results["op3_mixing"].collect() if r["size"]]
    part = [r for r in rows if r["times"] != min(x["times"] for x in rows if x["source"] == r["source"])]
    rest = [r for r in rows if r not in part and any(x["source"] == r["source"] for x in part)]
    mean = lambda x: sum(scores[r["doc_id"]] for r in x) / max(1, len(x))
    assert part and rest and mean(part) >= mean(rest) - 0.1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(results, tables, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    r = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(results[name].columns)
    # the SQL of lines tells documents by id; repeated rows are for brute force
    once = results[name].where("doc_id <> 903 and doc_id <> 900").select(*names).collect()
    assert sorted(map(tuple, once)) == sorted(x for x in r.fetchall() if x[names.index("doc_id")] not in (900, 903))


def test_pipeline_stages_against_plain_code(spark, tables, results):
    """What each stage does to the documents that it gets, told by the queries and by plain code."""
    path, rows = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, path)
    accepted = {r["doc_id"] for r in results["op1_quality"].collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in good.collect()} == accepted and good.columns == docs.columns
    clean = stages["benchmark decontamination"](spark, docs, path)
    found = {r["doc_id"] for r in results["op4_decontamination"].collect() if r["contaminated"]}
    passage = spark.read.parquet(f"{path}/benchmark.parquet").where("item_id = 1").first()["text"].split()
    windows = {" ".join(passage[i : i + 13]) for i in range(len(passage) - 12)}
    held = {i for i, t, *_ in rows if any(w in " ".join((t or "").split()) for w in windows)}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, *_ in rows} - found - held and held
    mixed = Counter(r["doc_id"] for r in stages["mixing sources to target weights"](spark, docs, path).collect())
    times = Counter()
    for r in results["op3_mixing"].collect():
        times[r["doc_id"]] += r["times"]
    assert mixed == +times
    placed = stages["sharding"](spark, docs, path)
    assert placed.count() == len(rows) and set(placed.columns) >= {*docs.columns, "shard"}
