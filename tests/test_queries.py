"""Every registered query against its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from underlay.plans import registry

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(str(row[i]) for i in order) for row in cursor.fetchall())
    assert Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) == want
    assert want or name in ("char_raw_silence", "ocr_unextractable")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
