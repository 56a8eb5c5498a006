from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 150 and df.columns[:2] == ["symbol", "trading_date"]


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ret_1' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})


def canon(rows, names):
    cols = sorted(names)
    one = lambda x: "null" if x is None or x != x else repr(round(float(x), 6) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(one(r[names.index(c)]) for c in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in "events lineitem".split():
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    df, sql = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert canon(df.collect(), df.columns) == canon(sql.fetchall(), list(sql.columns))


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    """19.77 / 6.4 - 1 and the like lie by a half of the last digit, give or take the last bit."""
    pairs = [(6.4, 19.77), (6.4, 217.07), (32.0, 163.17), (1.28, 1.01), (50.0, 0.0), (0.0, 3.5)]
    rows = [(user, f"2024-01-0{day + 1} 00:00:0{user}", pair[day], "view") for user, pair in enumerate(pairs) for day in range(2)]
    spark.createDataFrame(rows, "user_id long, ts string, value double, event_type string").selectExpr("user_id", "cast(ts AS timestamp_ntz) AS ts", "value", "event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df, sql = queries.QUERIES["builtin_factors_by_user"](spark, str(tmp_path)), c.sql(queries.ORACLES["builtin_factors_by_user"])
    assert canon(df.collect(), df.columns) == canon(sql.fetchall(), list(sql.columns))
