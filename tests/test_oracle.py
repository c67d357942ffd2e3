"""Every registered query against its DuckDB SQL on the smallest data."""

import math
import os
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest

from checks import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


def cell(value, kind):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if kind == "d":
        return f"{float(value) + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(bool(value)) if kind == "b" else str(int(value)) if kind == "i" else str(value)


def rows(frame, cols):
    kinds = [c.split(":") for c in sorted(cols.split())]
    values = [frame[name].tolist() for name, _ in kinds]
    return sorted("|".join(cell(v, k) for v, (_, k) in zip(row, kinds)) for row in zip(*values))


@pytest.mark.parametrize("name", list(registry.ENTRIES))
def test_matches_sql(spark, duck, name):
    cols, _, sql = registry.ENTRIES[name]
    ours = registry.run(name, spark, SF).toPandas()
    if sql is None:
        assert list(ours.columns) == [c.split(":")[0] for c in cols.split()]
        return
    theirs = duck.execute(registry.oracle(name)).fetchdf()
    assert rows(ours, cols) == rows(theirs, cols)


@pytest.mark.parametrize("name, want", [("entry_clusters", {(1, 0): 3, (1, 1): 1, (2, 0): 1}),
                                        ("entry_clusters_unfolded", {(1, 0): 1, (1, 1): 2, (2, 0): 1})])
def test_clusters_of_times_folded_and_as_they_are(spark, name, want):
    held = [(1, 0, 1, 0.300, 100), (1, 0, 2, 0.305, 1_003_700), (1, 0, 3, 0.295, 180_007_300), (1, 0, 4, 0.300, 400_007_301),
            (1, 1, 1, 0.500, 199_000), (1, 1, 2, 0.500, 201_000), (2, 0, 1, 0.400, 500), (2, 0, 2, 0.400, None)]
    df = spark.createDataFrame([(*r, f"w{r[2]}", 1.0) for r in held], "market_id long, outcome_index int, trader_id long, avg_price double, opened_ts long, wallet string, size_usd double")
    cols, fn, sql = registry.ENTRIES[name]
    con = duckdb.connect()
    con.execute("create table holders (market_id bigint, outcome_index int, trader_id bigint, avg_price double, opened_ts bigint)")
    con.executemany("insert into holders values (?, ?, ?, ?, ?)", held)
    ours, theirs = registry.conform(fn(SimpleNamespace(holders=df)), cols).collect(), con.execute(sql).fetchall()
    assert {tuple(r[:2]): r[2] for r in ours} == {r[:2]: r[2] for r in theirs} == want
