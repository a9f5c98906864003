"""Rows that an order leaves tied come out the same on every run, and as in the SQL where that settles them."""

import duckdb

from evistrata import registry


def test_listed_in_table_order(spark, tmp_path):
    con = duckdb.connect()
    path = f"{tmp_path}/lineitem.parquet"
    con.sql(f"COPY (SELECT i // 4 AS l_orderkey, 7 AS l_partkey, 1 AS l_linenumber, (90 - i % 4 * 20)::DOUBLE AS l_quantity, 'R' AS l_returnflag FROM range(400) r(i)) TO '{path}'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    got = {tuple(r) for r in registry.QUERIES["positive_listing"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(registry.ORACLE["positive_listing"]).fetchall()) and (0, "7(line=1, qty=90); 7(line=1, qty=70); 7(line=1, qty=50); 7(line=1, qty=30)") in got


def test_top_ties_repeat(spark, tmp_path):
    """Equal price and line: the other columns of the result decide, however the rows are ordered."""
    rows = [(o, 1, p, "NAR"[(o + p) % 3], 5.0) for o in range(20) for p in range(6)]
    found = []
    for i, order in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: r[2] * 5 % 6))):
        spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        found.append([{tuple(r) for r in registry.QUERIES[q](spark, f"{tmp_path}/{i}").collect()} for q in ("top3_per_group", "false_positive_topk")])
    assert found[0] == found[1] == found[2]
    assert {r[2] for r in found[0][0]} == {0, 1, 2}
