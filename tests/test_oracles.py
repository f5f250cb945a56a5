"""Every registered query with an oracle equals DuckDB on the smallest tables."""

import duckdb
import pytest

from loomgraph.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(values):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in values), key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert rows(tuple(r[c] for c in order) for r in df.collect()) == rows(tuple(r[names.index(c)] for c in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_the_comparison_sees_small_differences():
    assert rows([(1, 0.5)]) != rows([(1, 0.501)])


def test_entry_imports(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
