from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import dashboard as db
from faultline.operators import incidents as inc
from faultline.operators import services as sv
from faultline.schemas import INCIDENT_EVENTS, INCIDENTS, SERVICES, STATUS_CHANGES
from helpers import AS_OF, BASE, as_of, events


def incident(key, severity, status, start=0, services=("a",), title="t", root="a", summary="s"):
    return (key, title, severity, status, BASE + timedelta(minutes=start), None, list(services), root, 0.5, summary)


def incidents(spark, *rows):
    return spark.createDataFrame(list(rows), INCIDENTS)


def recent(spark, rows):
    """Events placed so that second 0 is 15 minutes before AS_OF."""
    shift = AS_OF - timedelta(minutes=15) - BASE
    return events(spark, [(s + shift.total_seconds(), *rest) for s, *rest in rows])


def services(spark, *names):
    return spark.createDataFrame([(n, "application", "HEALTHY", 0.0, 0) for n in names], SERVICES)


def test_service_types(spark):
    names = ["user-db", "api-gateway", "NGINX", "stripe", "my-aws", "orders", "postgres-gateway"]
    df = events(spark, [(0, n, "INFO", "m", None) for n in names])
    got = {r["name"]: r["type"] for r in sv.discovered_services(df).collect()}
    assert got == {
        "user-db": "database", "api-gateway": "gateway", "NGINX": "gateway", "stripe": "external", "my-aws": "external",
        "orders": "application", "postgres-gateway": "database",
    }


def test_register_keeps_known_rows(spark):
    known = spark.createDataFrame([("a", "external", "CRITICAL", 5.0, 2)], SERVICES)
    df = events(spark, [(0, "a", "INFO", "m", None), (1, "b", "INFO", "m", None)])
    rows = [tuple(r) for r in sv.list_services(sv.register_services(df, known)).collect()]
    assert rows == [("a", "external", "CRITICAL", 5.0, 2), ("b", "application", "HEALTHY", 0.0, 0)]


def test_error_rate_window_and_rounding(spark):
    rows = [(0, "a", "ERROR", "m", None)] + [(1, "a", "INFO", "m", None)] * 31 + [(-1, "a", "ERROR", "m", None)] * 9
    got = sv.recent_error_rates(recent(spark, rows), as_of()).collect()
    assert [(r["total"], r["errors"], r["error_rate"]) for r in got] == [(32, 1, 3.12)]


@pytest.mark.parametrize(
    "errors,total,severity,status",
    [(1, 10, None, "CRITICAL"), (1, 50, None, "DEGRADED"), (1, 51, None, "HEALTHY"), (0, 9, "HIGH", "CRITICAL"),
     (0, 9, "LOW", "DEGRADED"), (0, 0, "MEDIUM", "DEGRADED"), (0, 0, None, "HEALTHY")],
)
def test_status(spark, errors, total, severity, status):
    rows = [(1, "a", "ERROR" if i < errors else "INFO", "m", None) for i in range(total)] or [(-9999, "a", "INFO", "m", None)]
    inc_rows = [incident("i", severity, "INVESTIGATING")] if severity else [incident("i", "CRITICAL", "CLOSED")]
    timeline = spark.createDataFrame([], INCIDENT_EVENTS)
    health = sv.compute_service_health(services(spark, "a"), recent(spark, rows), incidents(spark, *inc_rows), timeline, as_of())
    assert health.first()["status"] == status


def test_health_counts_plain_anomalies_of_the_last_hour(spark):
    kinds = [("anomaly", 59), ("anomaly", 61), ("critical_error", 5), ("anomaly", 1)]
    timeline = spark.createDataFrame(
        [("i", AS_OF - timedelta(minutes=m), "a", "ERROR", "m", k, 3) for k, m in kinds], INCIDENT_EVENTS
    )
    inc_df = incidents(spark, incident("i", "LOW", "OPEN", services=("a_b",)))
    health = sv.compute_service_health(services(spark, "a", "axb"), recent(spark, [(0, "a", "INFO", "m", None)]), inc_df, timeline, as_of())
    got = {r["name"]: (r["anomaly_count"], r["status"]) for r in health.collect()}
    # Names match whole, so an underscore is no wildcard.
    assert got == {"a": (2, "HEALTHY"), "axb": (0, "HEALTHY")}


def test_search_order_and_filters(spark):
    df = incidents(
        spark,
        incident("1", "LOW", "OPEN", 9), incident("2", "CRITICAL", "RESOLVED", 8), incident("3", "HIGH", "INVESTIGATING", 1),
        incident("4", "HIGH", "OPEN", 5, title="Redis Down"), incident("5", "ODD", "OPEN", 7, summary="about REDIS"),
    )
    assert [r["run_id"] for r in inc.search_incidents(df).collect()] == ["4", "3", "1", "5", "2"]
    assert [r["run_id"] for r in inc.search_incidents(df, search="redis").collect()] == ["4", "5"]
    assert [r["run_id"] for r in inc.search_incidents(df, "OPEN", "HIGH").collect()] == ["4"]
    assert [r["run_id"] for r in inc.search_incidents(df, search="r_dis d%").collect()] == ["4"]
    assert inc.get_incident(df, "3").count() == 1


def test_status_changes_keep_the_latest(spark):
    df = incidents(spark, incident("1", "LOW", "OPEN"), incident("2", "LOW", "OPEN"), incident("3", "LOW", "OPEN"))
    t = datetime(2026, 8, 20)
    changes = spark.createDataFrame(
        [("1", "INVESTIGATING", t, 1), ("1", "RESOLVED", t + timedelta(hours=1), 2),
         ("2", "CLOSED", t, 3), ("2", "OPEN", t, 4)], STATUS_CHANGES
    )
    got = {r["run_id"]: (r["status"], r["end_time"]) for r in inc.apply_status_changes(df, changes).collect()}
    assert got == {"1": ("RESOLVED", t + timedelta(hours=1)), "2": ("OPEN", None), "3": ("OPEN", None)}


def test_health_score_is_clamped(spark):
    many = incidents(spark, *[incident(str(i), "CRITICAL", "OPEN") for i in range(9)])
    none = many.limit(0)
    assert db.health_score(many, services(spark, "a")).first()[0] == 10.0
    assert db.health_score(none, services(spark, "a")).first()[0] == 100.0
    some = incidents(spark, incident("1", "HIGH", "OPEN"), incident("2", "LOW", "INVESTIGATING"), incident("3", "CRITICAL", "CLOSED"))
    sick = spark.createDataFrame([("a", "x", "CRITICAL", 0.0, 0), ("b", "x", "DEGRADED", 0.0, 0)], SERVICES)
    assert db.health_score(some, sick).first()[0] == 73.0


def test_severity_tables(spark):
    df = incidents(spark, incident("1", "HIGH", "OPEN"), incident("2", "HIGH", "CLOSED"))
    assert {r["severity"]: r["count"] for r in inc.severity_distribution_filled(df).collect()} == {"CRITICAL": 0, "HIGH": 2, "MEDIUM": 0, "LOW": 0}


def test_timeline_edges(spark):
    now = datetime(2026, 9, 1, 12, 2, 30)
    stamps = [now - timedelta(hours=1), now - timedelta(hours=1, seconds=1), now, now + timedelta(minutes=2), now + timedelta(minutes=3)]
    df = events(spark, [((s - BASE).total_seconds(), "a", "ERROR", "m", None) for s in stamps])
    rows = db.error_rate_timeline(df, F.lit(now)).orderBy("timestamp").collect()
    assert len(rows) == 13 and rows[0]["timestamp"] == datetime(2026, 9, 1, 11)
    assert [r["total_count"] for r in rows] == [1] + [0] * 11 + [2]
    assert rows[0]["rate"] == 100.0 and rows[1]["rate"] == 0.0


def test_status_word(spark):
    quiet = incidents(spark, incident("1", "LOW", "CLOSED"))
    busy = incidents(spark, incident("1", "LOW", "OPEN"))
    ev = events(spark, [(0, "a", "INFO", "m", None)])
    sick = spark.createDataFrame([("a", "x", "CRITICAL", 0.0, 0)], SERVICES)
    assert tuple(db.totals(sick, quiet, ev).first()) == (1, 0, 1, "OPERATIONAL")
    assert db.totals(sick, busy, ev).first()["status_word"] == "CRITICAL DEGRADATION"
    assert db.totals(services(spark, "a"), busy, ev).first()["status_word"] == "DEGRADED TELEMETRY"
