"""Every registered query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from sitewatch import registry_streams as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, duck, sf_dir, name):
    ours = registry.QUERIES[name](spark, sf_dir)
    theirs = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    by = sorted(names)
    a = sorted(tuple(cell(r[c]) for c in by) for r in ours.collect())
    b = sorted(tuple(cell(r[names.index(c)]) for c in by) for r in theirs.fetchall())
    assert a == b
