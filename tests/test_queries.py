"""Every registered query against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright import plans
from tilewright.plans import tiles
from tilewright.plans.common import tiled

REGISTERED = plans.registered()


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def canonical(df):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x == int(x) else x

    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTERED.items() if sql])
def test_matches_oracle(spark, sf, oracle, name):
    query, sql = REGISTERED[name]
    got, expected = query(spark, sf).toPandas(), oracle.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTERED.items() if not sql])
def test_runs_without_oracle(spark, sf, name):
    df = REGISTERED[name][0](spark, sf)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["normalise_grouped", "normalise_quantile_map"])
def test_near_ties_of_tile_means(spark, tmp_path, monkeypatch, name):
    """Tiles of the same values in another order, against one thread of the oracle, which adds in order of
    ``pos``. Rows may come to the mean in any order, as from aggregates that had to spill."""
    c, d = duckdb.connect(), str(tmp_path)
    c.sql("set threads = 1")
    c.sql(f"copy (select i as event_id, make_timestamp(1704067200000000 + i * 1000000) as ts, i % 3 as user_id, 'view' as event_type, ((hash(i) % 5) * 61.13 + 0.07)::double as value from range(12000) t(i)) to '{d}/events.parquet'")
    c.sql(f"create view events as select * from '{d}/events.parquet'")
    query, sql = REGISTERED[name]
    expected = canonical(c.sql(sql).df())
    assert canonical(query(spark, d).toPandas()) == expected
    monkeypatch.setattr(tiles, "tiled", lambda *a: tiled(*a).repartition(7).sortWithinPartitions(F.xxhash64("event_id")))
    assert canonical(query(spark, d).toPandas()) == expected
