import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from runstore.plans import catalogue
from runstore.sources.store import settings


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert got
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in cursor.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_replay_of_runs_of_several_files(spark, sf_dir):
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):  # so that a run is a file for each part of the shuffle, as large ones are
        got = catalogue.QUERIES["ingest_replayed"](spark, sf_dir)
        assert len(got.inputFiles()) > 8
        assert sorted(got.collect()) == sorted(catalogue.QUERIES["live_view"](spark, sf_dir).select("key", "value").collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
