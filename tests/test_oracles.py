"""Every query that SQL expresses against DuckDB, on the smallest tables."""

import duckdb
import pytest

from cindersift.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, db, name):
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    ran = db.execute(plans.ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = sorted(tuple(shown(r[names.index(c)]) for c in cols) for r in ran.fetchall())
    assert sorted(tuple(shown(r[c]) for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    plans.QUERIES[name](spark, SF).collect()
