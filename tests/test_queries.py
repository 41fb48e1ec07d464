"""Every registered query against its SQL, on a small fixture: 40 documents, and the other tables as they are at the smallest scale."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from kmerloom.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """Folder of the fixture, and DuckDB with its tables."""
    c, folder = duckdb.connect(), tmp_path_factory.mktemp("tables")
    for t in TABLES:
        rows = f"select * from '{DATA}/{t}.parquet'" + (" order by doc_id limit 40" if t == "documents" else "")
        c.execute(f"copy ({rows}) to '{folder}/{t}.parquet' (format parquet)")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) if isinstance(v, str) else v for v in r) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_query(spark, small, name):
    folder, con = small
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
def test_hash_values_of_both_tables(spark, small):
    folder, con = small
    got = catalog.QUERIES["hash_values"](spark, folder).toPandas()
    want = con.execute("select r_name from region union all select n_name from nation").fetchall()
    assert sorted(got["name"]) == sorted(n for n, in want)


def test_catalog_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
