"""Every registered keyspace query against DuckDB on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from keyloom import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, con, small_dir, name):
    df = Q.queries()[name](spark, small_dir)
    r = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(x[columns.index(c)]) for c in df.columns) for x in r.fetchall()), key=repr)
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=repr) == want


def test_catalog(spark, small_dir):
    assert Q.queries()["q_command_catalog"](spark, small_dir).count() == 196


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_spark():
    """Registering the queries needs no session."""
    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)


def test_hot_keys_of_a_flat_log(spark, small_dir, tmp_path):
    """More keys than the sketch tracks, none of them hot: the counts are those of the SQL; null is a key too."""
    from keyloom.plans import stats

    c = duckdb.connect()
    c.execute(
        f"copy (select i as event_id, TIMESTAMP '2024-01-01' as ts, if(i % 9000 = 5, null, i % 30000) as user_id, 'view' as event_type,"
        f" 1.0::DOUBLE as value, '' as props from range(40000) r(i)) to '{tmp_path}/events.parquet' (format parquet)"
    )
    for t, d in (("events", tmp_path), ("customer", small_dir), ("conversations", small_dir)):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(c.execute(Q.oracle_sql()["q_hotkeys_approx"]).fetchall())
    got = Q.queries()["q_hotkeys_approx"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
    rows = [(f"k{i}",) for i in range(400)] * 2 + [("hot",)] * 50 + [(None,)] * 20
    log = spark.createDataFrame(rows, "key string")
    for buckets in (1, 64, 65_536):  # whatever a key shares its bucket with
        top = stats.hotkeys_counted(log, 4, tracked=16, buckets=buckets).collect()
        assert [tuple(r) for r in top] == [("hot", 50), (None, 20), ("k0", 2), ("k1", 2)]
    assert stats.hotkeys_counted(log.limit(0), 4).collect() == []
    assert len(stats.hotkeys_counted(log.where("key = 'hot'"), 4).collect()) == 1
