"""Every registered query that has SQL against it, as the driver does."""

import duckdb
import pytest

import __spark_entry__ as entry

# the optional operators have tests of their own
NAMES = sorted(n for n in entry.core.oracle_sql())
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in "events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con



@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = duck.execute(entry.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in got.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    key = lambda r: [str(v) for v in r]
    cols = sorted(kinds)
    want = [dict(zip(kinds, r)) for r in got.fetchall()]
    assert sorted([tuple(near(r[c]) for c in cols) for r in df.collect()], key=key) == sorted([tuple(near(r[c]) for c in cols) for r in want], key=key)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
