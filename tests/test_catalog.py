"""Catalogued queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_hit_rate", "a01_panel_brand", "a03_calendar_check", "a18_profile", "b01_direction_targets", "b10_sudden_drops", "c02_direction_lags",
         "c09_stale_run", "c11_signed_run", "c14_downside_features", "c31_available_rate", "d02_pct_rank", "e02_peer_features"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_can_be_read_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    made = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert made.returncode == 0, made.stderr[-500:]
    assert int(made.stdout.split()[-2]) >= 250
