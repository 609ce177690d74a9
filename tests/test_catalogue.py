"""The registered queries have the columns of their oracles, and some their rows."""

import math

import duckdb
import pytest

from skygauge.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["physics_counts_by_station", "cleaned_dataset", "fusion_rules_only", "kalman_summary", "health_metrics", "alert_recurrence_over_log", "alerts_by_rules", "health_from_kalman", "kalman_with_references", "fusion_with_detectors", "drift_evaluation_without_noise", "thermo_derived", "stream_hourly_counts", "stream_kalman_late", "stream_alert_log", "channel_summary_by_days", "quality_roll_up", "tracking_export"])
def test_query_matches_oracle(spark, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    db.execute(f"CREATE TABLE o AS {ORACLES[name]}")
    db.execute(f"CREATE TABLE s AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = sorted(r[0] for r in db.execute("DESCRIBE o").fetchall())
    assert columns == sorted(r[0] for r in db.execute("DESCRIBE s").fetchall())
    names = ", ".join(f'"{c}"' for c in columns)
    assert db.execute(f"SELECT count(*) FROM o").fetchall() == db.execute("SELECT count(*) FROM s").fetchall()
    assert db.execute(f"SELECT count(*) FROM (SELECT {names} FROM o EXCEPT ALL SELECT {names} FROM s)").fetchall()[0][0] == 0


def test_thermo_derived_has_every_reading(spark):
    out = {(r.station_id, r.row_id): r.es for r in QUERIES["thermo_derived"](spark, SF).collect()}
    rows = [(r.station_id, r.row_id, r.temperature) for r in QUERIES["readings"](spark, SF).collect()]
    odd = [(s, i, t) for s, i, t in rows if t is not None and t <= -100]
    assert len(out) == len(rows) and odd
    for s, i, t in odd:
        assert out[s, i] == pytest.approx(6.112 * math.exp(17.67 * t / (t + 243.5)), rel=1e-9)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 32
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_parts_of_a_stream_are_bounded(spark, monkeypatch):
    from skygauge.plans import catalogue
    from skygauge.sources import readings

    df = readings.from_events(spark, SF)
    assert len(catalogue._parts(df)) == 3
    monkeypatch.setattr(catalogue, "PART_ROWS", 100)
    parts = catalogue._parts(df)
    assert len(parts) == 10 and sum(p.count() for p in parts) == df.count()
    assert len(catalogue._parts(df, shortest=5 * 86_400_000_000)) == 5
