"""Every query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from voxloom.plans.catalog import CATALOG

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    part = frame[cols].astype(object)
    return cols, sorted(map(tuple, part.where(frame[cols].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.oracle])
def test_equals_sql(spark, duck, sf_dir, name):
    q = CATALOG[name]
    assert rows(q.run(spark, sf_dir).toPandas()) == rows(duck.execute(q.oracle).fetchdf())


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if not q.oracle])
def test_runs(spark, sf_dir, name):
    assert CATALOG[name].run(spark, sf_dir).count() > 0
