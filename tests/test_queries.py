"""Every query of the reference's own operators against its SQL in DuckDB on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from strata.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}")
    return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_incremental_counts_of_several_files(spark, tmp_path):
    """Pairs that come in many files of the table are counted in all of them."""
    from strata.streaming import events

    rows = [(u, kind) for u in range(7) for kind in "ab" for _ in range(3 + u)]
    table = spark.createDataFrame(rows, "user_id long, event_type string")
    path = f"{tmp_path}/events.parquet"
    table.repartition(4).write.parquet(path)
    assert {(r.user_id, r.event_type, r.n) for r in events.incremental_counts(spark, path).collect()} == set((*k, n) for k, n in Counter(rows).items())
    found = f"{tmp_path}/found"
    pairs = lambda rows: rows.select("user_id", "event_type").distinct()
    events.incremental(events.stream_of(spark, path), pairs, ["user_id", "event_type"], found, f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(found).count() == len(set(rows))


def test_entry_file_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    for gone in ("corpus_pipeline", "strata.llm", "strata.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
