"""Windows of the event log against their SQL, on times that fall near a window's end."""

import datetime as dt

import duckdb
import pytest

from sparkfolio.plans import registry

from .conftest import rows

TIMES = ["2024-01-01 23:59:59.4", "2024-01-01 23:59:59.5", "2024-01-01 23:59:59.600001", "2024-01-02 11:59:59.5", "2024-01-02 00:00:00", "2024-01-01 23:59:58.5", "1969-12-31 23:59:50", "1969-12-30 12:00:00.3", None]


@pytest.mark.parametrize("name", ["windows_tumbling", "windows_sliding"])
def test_events_near_the_end_of_a_window(spark, tmp_path, name):
    made = [(k, dt.datetime.fromisoformat(t) if t else None, "ab"[k % 2], k + 0.25) for k, t in enumerate(TIMES * 2)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", made)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    assert rows(df) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall(), key=repr)
