"""repository_listing where balances end in a half: whole numbers as SQL's cast makes them, by the query's own SQL."""

import duckdb

from cindersift.plans import queries as plans


def test_halves_as_in_sql(spark, tmp_path):
    rows = [(1, 0, 2.5), (2, 0, 2.0), (3, 0, 3.5), (4, 0, -2.5), (5, 0, -2.0), (6, 0, None), (7, 1, 0.5), (8, 1, 0.0), (9, 1, -0.5)]
    spark.createDataFrame(rows[::-1], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.execute(plans.ORACLES["repository_listing"]).fetchall())
    assert sorted((r.id, r.position) for r in plans.QUERIES["repository_listing"](spark, str(tmp_path)).collect()) == want
