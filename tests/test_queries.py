"""The catalogue's queries, side by side with their SQL."""

import math
import os

import pytest

from brindle.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "NULL" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v)
    return [names[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        want = canonical([d[0] for d in found.description], found.fetchall())
        assert canonical(df.columns, rows) == want
