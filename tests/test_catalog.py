"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from cuemill.plans import catalog, registered

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registered().QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in catalog.TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6g}" if abs(float(x)) < 1e15 else str(int(x))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()[:19]
    return str(x)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_best_stream_of_many_parts(spark, tmp_path):
    """Keys beyond 100,000, and equal widths."""
    spark.read.parquet(f"{FOLDER}/part.parquet").selectExpr("*", "explode(array(0L, 99950L, 1000000L)) AS more").selectExpr("* EXCEPT (p_partkey, more)", "p_partkey + more AS p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.QUERIES["t19_best_stream"](spark, str(tmp_path)).select("video_id", "kind", "url").collect()
    want = con.sql(catalog.ORACLES["t19_best_stream"]).select("video_id", "kind", "url").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and max(r["url"] for r in got) >= 1000000


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
