"""Every registered query of the string engine: DuckDB must agree where there is SQL for it."""

from pathlib import Path

import pytest

from glyphframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in catalog.ORACLE_SQL:
        r = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted((tuple(norm(x[i]) for i in order) for x in r.fetchall()), key=repr)


def test_flagship_has_all_titles(spark, tmp_path):
    rows = [(i, "en" if i % 2 else "de", f"Text {i} of words") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["lang"]: x["titles"].split(" / ") for x in catalog.flagship(spark, str(tmp_path)).collect()}
    assert {k: len(v) for k, v in got.items()} == {"en": 15, "de": 15}
    assert got["en"][-1].startswith("Text 29")
