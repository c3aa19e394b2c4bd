"""Every registered query against its DuckDB oracle on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from cohortlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# the catalog's own queries; optional subpackages test theirs
catalog.load_all()
QUERIES = {k: f for k, f in entry.queries().items() if k in catalog.QUERIES}
ORACLES = {k: s for k, s in entry.oracle_sql().items() if k in catalog.ORACLES}


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, (int, float)):
        return (1, "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}")
    return (2, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    cols = sdf.columns
    srows = sdf.collect()
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    drows = res.fetchall()
    si = sorted(range(len(cols)), key=lambda i: cols[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = sorted(tuple(_norm(r[i]) for i in si) for r in srows)
    b = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["subject", "visit", "visit_age", "negative_valence_score", "priority",
                          "label", "error_sum"]


def test_entry_module_loads_by_path():
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_by_path", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    qs, sql = mod.queries(), mod.oracle_sql()
    assert set(catalog.QUERIES) <= set(qs) and set(sql) <= set(qs) and set(catalog.ORACLES) <= set(sql)
