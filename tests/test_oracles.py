"""Every query with SQL gives the rows DuckDB gives."""

import math
import os

import duckdb
import pytest

from strandline.plans.queries import ORACLES, QUERIES


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(_value(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
