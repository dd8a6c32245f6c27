"""Every registered query against its SQL on the smallest sample."""

import duckdb
import pytest

from tidepool.plans import oracles, queries

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def values(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    if name in oracles.oracle_sql():
        want = duck.execute(oracles.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)
    else:
        assert len(got) > 0
