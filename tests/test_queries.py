"""Every registered query against its SQL twin on a small scale."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

from tokensieve.plans import registry  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return format(round(v, 5) + 0.0, ".5f")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    rel = duck.sql(registry.oracles()[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    want = sorted([plain(x[have.index(c)]) for c in cols] for x in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
