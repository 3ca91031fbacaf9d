"""Registered queries against their SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from watchwell.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

CHEAP = (
    "brute_force_alerts", "lockout_alerts", "baseline_daily", "baseline_user_hours", "baseline_distributions", "minute_metrics", "service_buckets",
    "bucket_changes", "normalize_rejected", "normalize_stats", "service_metrics", "service_browse", "profile_columns", "profile_delays", "risk_scores", "pseudonyms", "append_events", "replay_check",
)


def cells(frame):
    plain = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    names = sorted(frame.columns)
    rows = [tuple(None if v is None or str(v) == "<NA>" or (isinstance(v, float) and math.isnan(v)) else plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None)]
    return names, sorted(rows, key=repr)


@pytest.mark.parametrize("name", CHEAP)
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = catalog.queries()[name](spark, str(DATA)).toPandas()
    want = db.sql(catalog.oracle_sql()[name]).df()
    assert cells(got) == cells(want)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
