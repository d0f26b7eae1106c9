"""Sums of lines against the SQL, on lines of one order that lie far apart."""

import duckdb
import numpy as np

from shoalgrid.plans import table_queries, terrain_queries


def test_ranks_of_copied_orders_are_those_of_the_sql(spark, tmp_path):
    """Six copies of every order, whose lines are dealt over four files: equal sums stay equal, so ranks agree."""
    con = duckdb.connect()
    con.execute("SET threads = 1")  # in several threads the sums, and with them the ranks, change from run to run
    for name, key, of in (("orders", "o_orderkey", "orders"), ("customer", "c_custkey", "customer"), ("lineitem", "l_orderkey", "orders")):
        (tmp_path / f"{name}.parquet").mkdir()
        source = "'/root/testdata/sf0.001/{}.parquet'"
        copies = f"SELECT t.* REPLACE ({key} + i * (SELECT count(*) FROM {source.format(of)}) AS {key}) FROM {source.format(name)} t, range(6) r(i)"
        con.execute(f"CREATE TABLE copies AS SELECT *, row_number() OVER (ORDER BY hash(copies)) % 4 AS part FROM ({copies}) copies")
        for k in range(4):
            con.execute(f"COPY (SELECT * EXCLUDE part FROM copies WHERE part = {k}) TO '{tmp_path}/{name}.parquet/part-{k}.parquet' (FORMAT parquet)")
        con.execute(f"DROP TABLE copies; CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(table_queries.SQL["engineered"]).fetchall())
    got = sorted(map(tuple, table_queries.engineered(spark, str(tmp_path)).collect()))
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want)) == 0


def test_differences_on_a_border_fall_as_in_the_sql(spark, tmp_path):
    """Cells whose difference from their surroundings lies midway between two integers: the last bit of the sum decides."""
    g = np.random.default_rng(2)
    cents = g.integers(10**5, 10**7, (70, 100))
    ring = [(y, x) for y in range(-3, 4) for x in range(-3, 4) if 1 <= x * x + y * y <= 9]
    for r in range(3, 67, 7):
        for c in range(3, 97, 7):
            cents[r + 3, c] += -sum(int(cents[r + y, c + x]) for y, x in ring) % len(ring)
            cents[r, c] = sum(int(cents[r + y, c + x]) for y, x in ring) // len(ring) + 50_650 * (2 * int(g.integers(1, 20)) - 1)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    rows = ", ".join(f"({k}, {x / 100})" for k, x in enumerate(cents.ravel().tolist()))
    con.execute(f"CREATE TABLE orders AS SELECT k AS o_orderkey, CAST(p AS DOUBLE) AS o_totalprice FROM (VALUES {rows}) t(k, p)")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, o_totalprice AS l_extendedprice FROM orders")
    for name in ("orders", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    want = sorted(con.execute(terrain_queries.SQL["position_legacy"]).fetchall())
    got = sorted(map(tuple, terrain_queries.position_legacy(spark, str(tmp_path)).collect()))
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want)) == 0


def test_zones_of_equal_means_are_ordered_as_in_the_sql(spark, tmp_path):
    """Eight copies of one block of zones: their means are equal only if their cells are added in one order."""
    g = np.random.default_rng(6)
    prices = np.tile(g.integers(10**5, 10**7, 1000) / 100, 8).tolist()
    con = duckdb.connect()
    con.execute("SET threads = 1")
    rows = ", ".join(f"({k}, {p})" for k, p in enumerate(prices))
    con.execute(f"CREATE TABLE orders AS SELECT k AS o_orderkey, CAST(p AS DOUBLE) AS o_totalprice FROM (VALUES {rows}) t(k, p)")
    con.execute("CREATE TABLE lineitem AS SELECT o_orderkey AS l_orderkey, o_totalprice AS l_extendedprice FROM orders")
    for name in ("orders", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    want = sorted(con.execute(table_queries.SQL["zone_order"]).fetchall())
    dealt = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # a zone's cells come from several tasks, as in large tables
    for k, v in dealt.items():
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, table_queries.zone_order(spark, str(tmp_path)).collect()))
    finally:
        for k in dealt:
            spark.conf.unset(k)
    assert len(got) == len(want) == 80
    assert sum(a != b for a, b in zip(got, want)) == 0
