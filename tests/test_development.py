"""Trends whose slope, direction, next value or consistency lies on an edge: the last bit decides, as in the SQL."""

import duckdb
import pytest

from pitchflow.plans.catalogue import ORACLES, QUERIES

#: Values of a player's matches in order; a zero takes no part, but its match counts.
EDGES = {
    "direction": [[3.6, 10.2, 24.2, 20.6, 1.4], [31.8, 11.1, 27.2, 15.0, 35.9], [20.8, 0.6, 20.6, 12.3, 35.7, 12.7, 0.8], [28.9, 9.5, 3.2, 2.3, 1.8, 6.4, 37.4]],
    "slope": [[37.1, 24.5, 34.5, 13.9, 7.7, 15.6, 0.0, 9.1, 20.8, 36.3], [15.8, 3.6, 34.8, 0.0, 21.9, 2.5, 37.6, 23.0, 6.4, 38.6], [37.5, 21.1, 21.5, 0.0, 11.8, 11.2, 30.5, 30.4, 6.5, 36.8]],
    "others": [[25.4, 39.0], [38.7, 38.7], [12.3], [0.0, 5.0, 0.0, 7.5], list(range(1, 17)), [0.1 * k for k in range(399, 360, -1)]],
}


@pytest.mark.parametrize("kind", EDGES)
def test_edges(spark, tmp_path, kind):
    rows = [(p, 1000 * p + k, f"2020-01-{k + 1:02d}" if k < 28 else f"2020-02-{k - 27:02d}", 1000.0 * v + 0.5) for p, own in enumerate(EDGES[kind]) for k, v in enumerate(own)]
    con = duckdb.connect()
    con.execute("CREATE TABLE o (c BIGINT, k BIGINT, d VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO o VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY (SELECT k AS o_orderkey, c AS o_custkey, 'O' AS o_orderstatus, v AS o_totalprice, CAST(d AS TIMESTAMP) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM o) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    names = ["player_id", "n", "slope", "r2", "direction", "next", "consistency"]
    ours = sorted(tuple(r[c] for c in names) for r in QUERIES["a31_development"](spark, str(tmp_path)).collect())
    theirs = con.sql(ORACLES["a31_development"]).df()[names].sort_values("player_id")
    assert ours == [tuple(r) for r in theirs.itertuples(index=False)] and len(ours) >= 3
