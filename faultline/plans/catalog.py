"""Registered queries: every operator over the whole driver tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions import text, time
from faultline.functions.staging import scratch, stage
from faultline.operators import anomalies as an
from faultline.operators import buckets as bk
from faultline.operators import clusters as cl
from faultline.operators import dashboard as db
from faultline.operators import extract as ex
from faultline.operators import incidents as inc
from faultline.operators import root_cause as rc
from faultline.operators import services as sv
from faultline.operators.forest import forest_outliers
from faultline.plans import stored
from faultline.sources import readers
from faultline.sources import tables as tb
from faultline.sources.sinks import run_registry
from faultline.sources.store import Store
from faultline.streaming import live

MINUTES, Z = 60, 2.0
_CODE_OF_MESSAGE = "nullif(regexp_extract(message, '\\b(4\\d{2}|5\\d{2})\\b', 1), '')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: presentable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def presentable(df: DataFrame) -> DataFrame:
    """Timestamps without zone and doubles at six places, so that engines can be compared."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c, 6)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def _buckets(spark, sf, daily=False, hits=False):
    return bk.bucket_counts(tb.log_events(spark, sf, daily), MINUTES, hits)


def _anomalies(spark, sf, daily=False):
    return an.detect_anomalies(_buckets(spark, sf, daily), Z)


def codes(df: DataFrame) -> DataFrame:
    return df.withColumn("reason_codes", F.array_join("reason_codes", ","))


class DailyRuns:
    """Incident tables of the daily runs, without sample messages."""

    def __init__(self, spark, sf):
        # The raw logs are read once; everything below works on their counters.
        buckets = stage(_buckets(spark, sf, True, True), "buckets")
        self.found = stage(an.detect_anomalies(buckets, Z), "anomalies")
        self.scores = rc.score_services(self.found, rc.service_hints(buckets))
        self.roots = rc.pick_root(self.scores)
        # Samples have a query of their own; evidence text is checked without them.
        bare = self.found.withColumn("sample_messages", F.array().cast("array<string>"))
        self.evidence = rc.evidence_chain(bare, self.roots)
        self.incidents = inc.build_incidents(self.roots, self.evidence)
        self.timeline = inc.incident_timeline(self.evidence)
        self.current = inc.apply_status_changes(self.incidents, tb.status_changes(spark, sf))


def flat(incidents: DataFrame) -> DataFrame:
    return incidents.withColumn("affected_services", F.array_join("affected_services", ","))


# ---------------------------------------------------------------- bucket series


@query("bucket_counts", "SELECT * FROM buckets")
def _(spark, sf):
    return _buckets(spark, sf)


@query(
    "service_baselines",
    "SELECT run_id, service_name, n_buckets, first_bucket, round(mean_errors, 6) AS mean_errors, "
    "round(std_errors, 6) AS std_errors, round(mean_logs, 6) AS mean_logs, round(std_logs, 6) AS std_logs FROM stats",
)
def _(spark, sf):
    return bk.baselines(_buckets(spark, sf)).drop("max_critical", "max_5xx")


def _rule(code: str):
    def run(spark, sf):
        hits = _anomalies(spark, sf).where(F.array_contains("reason_codes", code))
        return hits.select("service_name", "timestamp", "error_count", "total_logs", "z_errors", "z_logs")

    return run


_RULE_SQL = (
    "SELECT service_name, bucket AS timestamp, error_count, total_logs, round(z_errors, 6) AS z_errors, "
    "round(z_logs, 6) AS z_logs FROM rules WHERE {}"
)
query("error_spikes", _RULE_SQL.format("r1"))(_rule("error_spike"))
query("volume_spikes", _RULE_SQL.format("r2"))(_rule("volume_spike"))
query("critical_buckets", _RULE_SQL.format("r3"))(_rule("critical"))
query("http_5xx_buckets", _RULE_SQL.format("r4"))(_rule("http_5xx"))

_ANOMALY_COLUMNS = [
    "run_id", "service_name", "timestamp", "total_logs", "error_count", "critical_count", "status_5xx_count",
    "mean_errors", "std_errors", "z_errors", "z_logs", "confidence", "reason_codes",
]
_ANOMALY_SQL = (
    "SELECT run_id, service_name, bucket AS timestamp, total_logs, error_count, critical_count, status_5xx_count, "
    "round(mean_errors, 6) AS mean_errors, round(std_errors, 6) AS std_errors, round(z_errors, 6) AS z_errors, "
    "round(z_logs, 6) AS z_logs, round(confidence, 6) AS confidence, reason_codes FROM {}anomalies"
)


@query("anomalies_rules", _ANOMALY_SQL.format(""))
def anomalies_rules(spark, sf):
    return codes(_anomalies(spark, sf)).select(*_ANOMALY_COLUMNS)


@query("anomalies_daily", _ANOMALY_SQL.format("d_"))
def _(spark, sf):
    return codes(_anomalies(spark, sf, True)).select(*_ANOMALY_COLUMNS)


@query(
    "anomalies_baseline",
    """SELECT b.service_name, b.bucket AS timestamp, b.error_count FROM buckets b
    JOIN (SELECT service_name, avg(error_count) AS m, stddev_pop(error_count) AS s FROM d_buckets
          WHERE run_id < '2024-01-11' GROUP BY ALL) h ON h.service_name = b.service_name
    WHERE s > 0 AND round((error_count - m) / s, 9) > 2.0""",
)
def _(spark, sf):
    """Spikes against a stored baseline: the first ten days."""
    past = bk.baselines(_buckets(spark, sf, True).where("run_id < '2024-01-11'").withColumn("run_id", F.lit("past")))
    hits = an.detect_anomalies(_buckets(spark, sf), Z, historical=past)
    return hits.where(F.array_contains("reason_codes", "error_spike")).select("service_name", "timestamp", "error_count")


@query(
    "anomaly_samples",
    f"""SELECT service_name, timestamp, string_agg(message, ' | ' ORDER BY grp, line_no) AS samples FROM (
      SELECT *, min(grp) OVER (PARTITION BY service_name, timestamp) AS best,
        row_number() OVER (PARTITION BY service_name, timestamp ORDER BY grp, line_no) AS rn FROM (
        SELECT a.service_name, a.bucket AS timestamp, l.line_no, l.message,
          CASE WHEN l.level IN ('WARNING', 'ERROR', 'CRITICAL') THEN 0 ELSE 1 END AS grp
        FROM anomalies a JOIN logs l ON l.service_name = a.service_name
          AND l.ts BETWEEN a.bucket - INTERVAL {MINUTES} MINUTE AND a.bucket + INTERVAL {MINUTES} MINUTE))
    WHERE rn <= 3 AND grp = best GROUP BY ALL""",
)
def _(spark, sf):
    rows = an.anomaly_samples(_anomalies(spark, sf), tb.log_events(spark, sf), MINUTES)
    return rows.select("service_name", "timestamp", F.array_join("sample_messages", " | ").alias("samples"))


@query(
    "anomalies_forest",
    """SELECT service_name, bucket AS timestamp, round(greatest(CASE WHEN r1 THEN least(0.95, 0.4 + 0.15 * z_errors) ELSE 0 END,
        CASE WHEN r2 THEN least(0.90, 0.3 + 0.12 * z_logs) ELSE 0 END, CASE WHEN r3 THEN 0.85 ELSE 0 END,
        CASE WHEN r4 THEN 0.90 ELSE 0 END, CASE WHEN r6 THEN 0.75 ELSE 0 END), 6) AS confidence,
      concat_ws(',', CASE WHEN r1 THEN 'error_spike' END, CASE WHEN r2 THEN 'volume_spike' END, CASE WHEN r3 THEN 'critical' END,
        CASE WHEN r4 THEN 'http_5xx' END, CASE WHEN r6 THEN 'isolation_forest' END) AS reason_codes
    FROM (SELECT r.*, o.bucket IS NOT NULL AND (error_count > mean_errors OR total_logs > mean_logs) AS r6
      FROM rules r LEFT JOIN f_outliers o ON o.run_id = r.run_id AND o.service_name = r.service_name AND o.bucket = r.bucket)
    WHERE r1 OR r2 OR r3 OR r4 OR r6""",
)
def _(spark, sf):
    """Rules and isolation forest together."""
    buckets = stage(_buckets(spark, sf), "buckets")
    found = an.detect_anomalies(buckets, Z, outliers=forest_outliers(buckets))
    return codes(found).select("service_name", "timestamp", "confidence", "reason_codes")


@query(
    "stream_error_rate",
    """SELECT window_start, service_name, count(*) AS total_logs,
      count(*) FILTER (WHERE level IN ('WARNING', 'ERROR', 'CRITICAL')) AS error_count,
      round_even(count(*) FILTER (WHERE level IN ('WARNING', 'ERROR', 'CRITICAL')) / count(*) * 100.0, 2) AS error_rate
    FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM logs)
    WHERE window_start + INTERVAL 5 MINUTE <= (SELECT now - INTERVAL 10 MINUTE FROM clock) GROUP BY window_start, service_name""",
)
def _(spark, sf):
    """The events table as a stream, run to its end; windows behind the watermark are final."""
    return _run_out(spark, live.stream_error_rate(tb.stream_log_events(spark, sf)))


def _run_out(spark, results: DataFrame) -> DataFrame:
    """What a stream over a finished folder gives once it has read it all."""
    root = scratch(spark, "stream")
    run = (
        results.writeStream.format("parquet").outputMode("append")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "stream_health",
    """SELECT w AS window_start, w + INTERVAL 15 MINUTE AS window_end, service_name, count(*) AS total_logs,
      count(*) FILTER (WHERE level IN ('WARNING', 'ERROR', 'CRITICAL')) AS error_count, count(*) FILTER (WHERE level = 'CRITICAL') AS critical_count,
      count(*) FILTER (WHERE status_code BETWEEN 500 AND 599) AS status_5xx_count,
      round_even(count(*) FILTER (WHERE level IN ('WARNING', 'ERROR', 'CRITICAL')) / count(*) * 100.0, 2) AS error_rate
    FROM (SELECT *, date_trunc('minute', ts) - to_minutes(unnest(range(15))) AS w FROM logs)
    WHERE w + INTERVAL 15 MINUTE <= (SELECT now - INTERVAL 10 MINUTE FROM clock) GROUP BY w, service_name""",
)
def _(spark, sf):
    """Trailing health from minute counters, two windows one behind the other."""
    return _run_out(spark, live.stream_health(tb.stream_log_events(spark, sf)))


@query(
    "stream_anomalies",
    f"""SELECT bucket AS window_start, service_name, total_logs, error_count,
      concat_ws(',', CASE WHEN r1 THEN 'error_spike' END, CASE WHEN r2 THEN 'volume_spike' END, CASE WHEN r3 THEN 'critical' END, CASE WHEN r4 THEN 'http_5xx' END) AS reason_codes
    FROM rules WHERE (r1 OR r2 OR r3 OR r4) AND bucket + INTERVAL {MINUTES} MINUTE <= (SELECT max(bucket) FROM buckets) - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    """The rules on a stream, against the baselines of the stored series."""
    past = stage(bk.baselines(_buckets(spark, sf)), "baselines")
    return codes(_run_out(spark, live.stream_anomalies(tb.stream_log_events(spark, sf), past, Z, MINUTES)))


@query(
    "stream_events",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, service_name, level, count(*) AS n, count(*) FILTER (WHERE {_CODE_OF_MESSAGE} IS NOT NULL) AS coded FROM logs GROUP BY ALL""",
)
def _(spark, sf):
    """A folder of log files, tailed through the line rules; counted once all of it has been read."""
    files = scratch(spark, "files")
    tb.write_daily_files(tb.log_events(spark, sf, True), files, "text")
    events = _run_out(spark, live.stream_events(spark, f"{files}/*"))
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    return events.groupBy(day, "service_name", "level").agg(F.count("*").alias("n"), F.count("status_code").alias("coded"))


# ---------------------------------------------------------------- root cause and incidents


@query("service_first_seen", "SELECT run_id, service_name, first_ts, first_bucket FROM d_first")
def _(spark, sf):
    return rc.first_seen(_anomalies(spark, sf, True))


@query("root_cause_scores", "SELECT run_id, service_name, first_ts, first_bucket, later_services, score FROM d_scores")
def _(spark, sf):
    return DailyRuns(spark, sf).scores


@query(
    "root_cause",
    """SELECT l.run_id, coalesce(likely_root_cause, 'Unknown') AS likely_root_cause, coalesce(confidence, 0.0) AS confidence,
      coalesce(summary, 'No anomalies detected to evaluate root cause.') AS summary
    FROM (SELECT DISTINCT run_id FROM d_logs) l LEFT JOIN d_narrated n ON n.run_id = l.run_id""",
)
def _(spark, sf):
    runs = tb.log_events(spark, sf, True).select("run_id").distinct()
    return rc.root_cause(runs, DailyRuns(spark, sf).roots)


@query(
    "evidence_chain",
    "SELECT run_id, ts AS timestamp, service_name, level, round(confidence, 6) AS confidence, reason_codes, "
    "is_root AS is_root_cause_indicator FROM d_evidence",
)
def _(spark, sf):
    d = DailyRuns(spark, sf)
    keyed = d.found.select("run_id", "timestamp", "service_name", "reason_codes")
    return codes(d.evidence.join(keyed, ["run_id", "timestamp", "service_name"])).select(
        "run_id", "timestamp", "service_name", "level", "confidence", "reason_codes", "is_root_cause_indicator"
    )


_INCIDENT_SQL = "run_id, title, severity, status, start_time, end_time, affected AS affected_services, root_cause, confidence, summary"


@query(
    "incidents_daily",
    f"SELECT {_INCIDENT_SQL} FROM (SELECT *, 'OPEN' AS status, CAST(NULL AS TIMESTAMP) AS end_time FROM d_titled)",
)
def _(spark, sf):
    return flat(DailyRuns(spark, sf).incidents)


@query(
    "incident_timeline",
    "SELECT run_id, ts AS timestamp, service_name, level, event_type, importance FROM d_timeline",
)
def _(spark, sf):
    return DailyRuns(spark, sf).timeline.drop("message")


@query(
    "incident_search",
    f"""SELECT {_INCIDENT_SQL} FROM d_current WHERE status = 'OPEN' AND severity = 'CRITICAL'
    AND (title ILIKE '%CACHE%' OR summary ILIKE '%CACHE%' OR root_cause ILIKE '%CACHE%')""",
)
def _(spark, sf):
    return flat(inc.search_incidents(DailyRuns(spark, sf).current, "OPEN", "CRITICAL", "CACHE"))


@query("incident_status_latest", f"SELECT {_INCIDENT_SQL} FROM d_current")
def _(spark, sf):
    return flat(DailyRuns(spark, sf).current)


@query(
    "incidents_with_events",
    """SELECT c.run_id, c.title, c.severity, c.status, t.ts AS event_time, t.service_name, t.level AS event_level,
      t.event_type, t.importance FROM d_current c LEFT JOIN d_timeline t ON t.run_id = c.run_id""",
)
def _(spark, sf):
    d = DailyRuns(spark, sf)
    return inc.incidents_with_events(d.current, d.timeline).select(
        "run_id", "title", "severity", "status", "event_time", "service_name", "event_level", "event_type", "importance"
    )


# ---------------------------------------------------------------- services and dashboard


class Health(DailyRuns):
    def __init__(self, spark, sf):
        super().__init__(spark, sf)
        self.events = tb.log_events(spark, sf, True)
        self.as_of = F.lit(tb.latest_time(spark, sf))
        self.services = sv.discovered_services(self.events)
        self.health = sv.compute_service_health(self.services, self.events, self.current, self.timeline, self.as_of)


@query(
    "service_registry",
    "SELECT name, type, 'HEALTHY' AS status, 0.0::DOUBLE AS error_rate, 0::BIGINT AS anomaly_count FROM services",
)
def _(spark, sf):
    known = sv.discovered_services(tb.log_events(spark, sf).where("level = 'CRITICAL'"))
    return sv.list_services(sv.register_services(tb.log_events(spark, sf), known))


@query(
    "new_services_anti",
    """SELECT name, type FROM services WHERE name NOT IN (SELECT service_name FROM logs
    GROUP BY service_name HAVING sum(status_code) % 2 = 0)""",
)
def _(spark, sf):
    events = tb.log_events(spark, sf)
    known = events.groupBy("service_name").agg((F.sum("status_code") % 2).alias("odd")).where("odd = 0")
    return sv.new_services(events, known.select(F.col("service_name").alias("name"))).select("name", "type")


@query(
    "events_per_service_type",
    "SELECT s.type AS service_type, count(*) AS n FROM logs l LEFT JOIN services s ON s.name = l.service_name GROUP BY ALL",
)
def _(spark, sf):
    events = tb.log_events(spark, sf)
    joined = sv.attach_services(events, sv.discovered_services(events))
    return joined.groupBy("service_type").agg(F.count("*").alias("n"))


@query("service_error_rate_15m", "SELECT service_name, total, errors, error_rate FROM rates")
def _(spark, sf):
    return sv.recent_error_rates(tb.log_events(spark, sf, True), F.lit(tb.latest_time(spark, sf)))


@query("service_health", "SELECT name, type, status, error_rate, anomaly_count FROM health")
def _(spark, sf):
    return Health(spark, sf).health


@query("severity_distribution", "SELECT severity, count(*) AS count FROM d_current GROUP BY severity")
def _(spark, sf):
    return inc.severity_distribution(DailyRuns(spark, sf).current)


@query(
    "severity_distribution_zero_filled",
    """SELECT l.severity, count(c.run_id) AS count FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) l(severity)
    LEFT JOIN d_current c ON c.severity = l.severity GROUP BY l.severity""",
)
def _(spark, sf):
    return inc.severity_distribution_filled(DailyRuns(spark, sf).current)


@query(
    "system_health_score",
    """SELECT CAST(greatest(10, least(100, 100
      - coalesce((SELECT sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 ELSE 5 END) FROM d_current
                  WHERE status IN ('OPEN', 'INVESTIGATING')), 0)
      - coalesce((SELECT sum(CASE status WHEN 'CRITICAL' THEN 5 WHEN 'DEGRADED' THEN 2 ELSE 0 END) FROM health), 0)
      )) AS DOUBLE) AS system_health_score""",
)
def _(spark, sf):
    h = Health(spark, sf)
    return db.health_score(h.current, h.health)


@query(
    "dashboard_status",
    """SELECT (SELECT count(*) FROM services) AS total_services,
      (SELECT count(*) FROM d_current WHERE status IN ('OPEN', 'INVESTIGATING')) AS active_incidents,
      (SELECT count(*) FROM events) AS total_events,
      CASE WHEN (SELECT count(*) FROM d_current WHERE status IN ('OPEN', 'INVESTIGATING')) = 0 THEN 'OPERATIONAL'
           WHEN (SELECT count(*) FILTER (WHERE status = 'CRITICAL') FROM health) > 0 THEN 'CRITICAL DEGRADATION'
           ELSE 'DEGRADED TELEMETRY' END AS status_word""",
)
def _(spark, sf):
    h = Health(spark, sf)
    return db.totals(h.health, h.current, h.events)


@query(
    "error_rate_timeline",
    f"""SELECT x.t AS timestamp, count(*) FILTER (WHERE l.level IN ('WARNING', 'ERROR', 'CRITICAL')) AS error_count,
      count(l.line_no) AS total_count, CASE WHEN count(l.line_no) = 0 THEN 0.0 ELSE
      round_even(count(*) FILTER (WHERE l.level IN ('WARNING', 'ERROR', 'CRITICAL')) / count(l.line_no) * 100.0, 2) END AS rate
    FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, now - INTERVAL 1 HOUR), now, INTERVAL 5 MINUTE)) AS t,
          now FROM clock) x
    LEFT JOIN logs l ON l.ts >= x.now - INTERVAL 1 HOUR AND time_bucket(INTERVAL 5 MINUTE, l.ts) = x.t GROUP BY x.t""",
)
def _(spark, sf):
    return db.error_rate_timeline(tb.log_events(spark, sf), F.lit(tb.latest_time(spark, sf)))


@query(
    "run_registry",
    """SELECT l.run_id, 'SUCCESS' AS status, l.n AS logs_processed, coalesce(a.n, 0) AS anomalies_detected,
      CASE WHEN a.n IS NULL THEN 0 ELSE 1 END::BIGINT AS incidents_created
    FROM (SELECT run_id, count(*) AS n FROM d_logs GROUP BY run_id) l
    LEFT JOIN (SELECT run_id, count(*) AS n FROM d_anomalies GROUP BY run_id) a ON a.run_id = l.run_id""",
)
def _(spark, sf):
    d = DailyRuns(spark, sf)
    events = tb.log_events(spark, sf, True)
    return run_registry(events.select("run_id").distinct(), events, d.found, d.incidents).select(
        "run_id", "status", "logs_processed", "anomalies_detected", "incidents_created"
    )


# ---------------------------------------------------------------- stored state


@query(
    "analyze_end_to_end",
    """SELECT l.run_id, 'SUCCESS' AS status, l.n AS logs_processed, coalesce(a.n, 0) AS anomalies_detected,
      CASE WHEN a.n IS NULL THEN 0 ELSE 1 END::BIGINT AS incidents_created, t.title, t.severity, t.start_time,
      t.affected AS affected_services, t.root_cause, t.confidence, t.summary, coalesce(a.n, 0) AS evidence_rows, coalesce(e.n, 0) AS root_rows,
      (SELECT count(*) FROM services) AS services
    FROM (SELECT run_id, count(*) AS n FROM d_logs GROUP BY run_id) l LEFT JOIN d_titled t ON t.run_id = l.run_id
    LEFT JOIN (SELECT run_id, count(*) AS n FROM d_anomalies GROUP BY run_id) a ON a.run_id = l.run_id
    LEFT JOIN (SELECT run_id, count(*) AS n FROM d_evidence WHERE is_root GROUP BY run_id) e ON e.run_id = l.run_id""",
)
def _(spark, sf):
    """The events as a folder of log files, one per day; read, analysed, stored, and read back from the store."""
    files = scratch(spark, "logs")
    tb.write_daily_files(tb.log_events(spark, sf, True), files)
    store = Store(spark, scratch(spark, "store"))
    as_of = tb.latest_time(spark, sf)
    stored.analyze_to_store(spark, f"{files}/*", store, as_of, window_minutes=MINUTES, use_forest=False)
    at = store.snapshot()
    per_run = store.read("evidence", at).groupBy("run_id").agg(
        F.count("*").alias("evidence_rows"), F.count_if("is_root_cause_indicator").alias("root_rows")
    )
    events = store.read("log_events", at).groupBy("run_id").agg(F.count("*").alias("stored_events"))
    services = stored.stored_services(store, at).agg(F.count("*").alias("services"))
    runs = store.read("analysis_runs", at).select("run_id", "status", "logs_processed", "anomalies_detected", "incidents_created")
    rows = runs.join(events, "run_id").where("stored_events = logs_processed").join(flat(stored.stored_incidents(store, at)).drop("status"), "run_id", "left")
    rows = rows.join(per_run, "run_id", "left").fillna(0, ["evidence_rows", "root_rows"]).withColumn("services", F.lit(services.first()[0]))
    return rows.drop("stored_events", "end_time").withColumn("run_id", F.regexp_extract("run_id", "day=([0-9-]+)", 1))


def _stored_days(spark, sf, history: bool) -> Store:
    """A store that holds the daily runs, with or without the changes of their status."""
    h = Health(spark, sf)
    events = tb.whole_events(h.events)
    store = Store(spark, scratch(spark, "store"))
    tables = {"log_events": events, "services": h.services, "incidents": h.incidents, "evidence": h.evidence, "incident_events": h.timeline}
    if history:
        tables["status_changes"] = tb.status_changes(spark, sf)
    store.commit([store.stage(name, "days", rows) for name, rows in tables.items()])
    return store


@query(
    "incident_status_set",
    """SELECT 'incident' AS kind, run_id AS name, severity AS detail, status, end_time FROM s_current UNION ALL
    SELECT 'service', name, type, status, NULL FROM s_health""",
)
def _(spark, sf):
    """The first incident is resolved and the last one taken up; incidents and refreshed health."""
    store = _stored_days(spark, sf, history=False)
    now = tb.latest_time(spark, sf)
    first, last = store.read("incidents").agg(F.min("run_id"), F.max("run_id")).first()
    version = store.snapshot().version
    stored.set_incident_status(store, first, "RESOLVED", now, expected=version)
    _, health = stored.set_incident_status(store, last, "INVESTIGATING", now)
    incidents = stored.stored_incidents(store).select(
        F.lit("incident").alias("kind"), F.col("run_id").alias("name"), F.col("severity").alias("detail"), "status", "end_time"
    )
    return incidents.unionAll(health.select(F.lit("service"), "name", "type", "status", F.lit(None).cast("timestamp")))


_PER_CENT = "CASE WHEN count(l.line_no) = 0 THEN 0.0 ELSE round_even(count(*) FILTER (WHERE l.level IN ('WARNING', 'ERROR', 'CRITICAL')) / count(l.line_no) * 100.0, 2) END"


@query(
    "dashboard_all",
    f"""SELECT 'totals' AS section, 'services' AS item, NULL AS label, (SELECT count(*) FROM services)::DOUBLE AS value
    UNION ALL SELECT 'totals', 'incidents', NULL, (SELECT count(*) FROM d_current WHERE status IN ('OPEN', 'INVESTIGATING'))
    UNION ALL SELECT 'totals', 'events', NULL, (SELECT count(*) FROM events)
    UNION ALL SELECT 'totals', 'status', CASE WHEN (SELECT count(*) FROM d_current WHERE status IN ('OPEN', 'INVESTIGATING')) = 0 THEN 'OPERATIONAL'
      WHEN (SELECT count(*) FILTER (WHERE status = 'CRITICAL') FROM health) > 0 THEN 'CRITICAL DEGRADATION' ELSE 'DEGRADED TELEMETRY' END, NULL
    UNION ALL SELECT 'totals', 'score', NULL, greatest(10, least(100, 100
      - coalesce((SELECT sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 ELSE 5 END) FROM d_current WHERE status IN ('OPEN', 'INVESTIGATING')), 0)
      - coalesce((SELECT sum(CASE status WHEN 'CRITICAL' THEN 5 WHEN 'DEGRADED' THEN 2 ELSE 0 END) FROM health), 0)))
    UNION ALL SELECT 'severities', severity, NULL, count(*) FROM d_current GROUP BY severity
    UNION ALL SELECT 'severity_chart', s, NULL, (SELECT count(*) FROM d_current WHERE severity = s) FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) t(s)
    UNION ALL SELECT 'service', name, status, error_rate FROM health
    UNION ALL SELECT 'service_anomalies', name, NULL, anomaly_count FROM health
    UNION ALL SELECT 'timeline', strftime(x.t, '%Y-%m-%d %H:%M'), count(l.line_no)::VARCHAR, {_PER_CENT}
      FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, now - INTERVAL 1 HOUR), now, INTERVAL 5 MINUTE)) AS t, now FROM clock) x
      LEFT JOIN logs l ON l.ts >= x.now - INTERVAL 1 HOUR AND time_bucket(INTERVAL 5 MINUTE, l.ts) = x.t GROUP BY x.t""",
)
def _(spark, sf):
    """All parts of the dashboard, read from the store in one state of it."""
    store = _stored_days(spark, sf, history=True)
    now = tb.latest_time(spark, sf)
    store.commit([], lambda state: [store.stage("service_health", "current", stored.stored_health(store, now, state))])
    d = stored.stored_dashboard(store, now)

    def part(df, section, item, label=None, value=None):
        none = F.lit(None).cast("string")
        of = F.lit(None) if value is None else F.col(value)
        return df.select(F.lit(section).alias("section"), item.alias("item"), (none if label is None else label).alias("label"), of.cast("double").alias("value"))

    totals = d.totals
    rows = part(totals, "totals", F.lit("status"), F.col("status_word"))
    for item, column in (("services", "total_services"), ("incidents", "active_incidents"), ("events", "total_events")):
        rows = rows.unionByName(part(totals, "totals", F.lit(item), value=column))
    parts = [
        part(d.health_score, "totals", F.lit("score"), value="system_health_score"),
        part(d.severities, "severities", F.col("severity"), value="count"),
        part(d.severity_chart, "severity_chart", F.col("severity"), value="count"),
        part(d.service_health, "service", F.col("name"), F.col("status"), "error_rate"),
        part(d.service_health, "service_anomalies", F.col("name"), value="anomaly_count"),
        part(d.timeline, "timeline", F.date_format("timestamp", "yyyy-MM-dd HH:mm"), F.col("total_count").cast("string"), "rate"),
    ]
    for more in parts:
        rows = rows.unionByName(more)
    return rows


# ---------------------------------------------------------------- extraction


def _parsed(spark, sf, shape):
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return ex.extract_lines(tb.raw_lines(spark, sf, shape), as_of)


_SECOND = "date_trunc('second', ts)"
_RAW_LEVEL = (
    "CASE line_no % 8 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'CRITICAL' "
    "WHEN 4 THEN 'DEBUG' WHEN 5 THEN 'INFO' WHEN 6 THEN 'CRITICAL' ELSE 'WARNING' END"
)
# The first 4xx or 5xx number standing alone in the message, its trailing status included.
_BODY = "message || ' status ' || status_code"
_CODE = "CAST(nullif(regexp_extract({}, '\\b(4\\d{{2}}|5\\d{{2}})\\b', 1), '') AS INTEGER)"
_PARSED = ["line_no", "timestamp", "service_name", "level", "message", "status_code", "request_id", "format"]


def _parse_sql(level, message, code, request, form, service="service_name"):
    return (
        f"SELECT line_no, {_SECOND} AS timestamp, {service} AS service_name, {level} AS level, {message} AS message, "
        f"{code} AS status_code, {request} AS request_id, '{form}' AS format FROM logs"
    )


@query(
    "parse_bracket",
    _parse_sql(_RAW_LEVEL, _BODY, _CODE.format(_BODY), "CASE WHEN line_no % 2 = 0 THEN 'req-' || line_no END", "bracket"),
)
def _(spark, sf):
    return _parsed(spark, sf, "bracket").select(*_PARSED)


@query(
    "parse_syslog",
    _parse_sql(
        "level", _BODY + " || ' trace_id=(' || line_no || ')'",
        _CODE.format(f"({_BODY} || ' trace_id=(' || line_no || ')')"), "CAST(line_no AS VARCHAR)", "syslog",
    ),
)
def _(spark, sf):
    return _parsed(spark, sf, "syslog").select(*_PARSED)


@query(
    "parse_json",
    _parse_sql(
        _RAW_LEVEL, _BODY,
        f"CASE line_no % 5 WHEN 0 THEN NULL WHEN 1 THEN {_CODE.format(_BODY)} ELSE status_code END",
        "'r' || line_no", "json",
    ),
)
def _(spark, sf):
    return _parsed(spark, sf, "json").select(*_PARSED)


@query(
    "parse_fallback",
    _parse_sql(
        "level",
        "trim(regexp_replace('- ' || ' pid ' || service_name || '[22] ' || level || ' - ' || " + _BODY
        + ", '(?i)\\b(' || level || ')\\b', '', 'g'), ': []-' || chr(9))",
        _CODE.format("('- ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' pid ' || service_name || '[22] ' || level || ' - ' || " + _BODY + ")"),
        "NULL::VARCHAR", "fallback",
        "coalesce(nullif(lower(regexp_extract(service_name || '[22] ' || message, "
        "'(?i)\\b([a-zA-Z0-9_\\-]+-service|[a-zA-Z0-9_\\-]+-api|gateway|database|auth|payment)\\b', 1)), ''), 'system')",
    ),
)
def _(spark, sf):
    return _parsed(spark, sf, "fallback").select(*_PARSED)


@query(
    "parse_csv",
    f"""SELECT line_no, {_SECOND} AS timestamp, service_name, {_RAW_LEVEL} AS level, message,
      CASE line_no % 3 WHEN 0 THEN {_CODE.format('message')} WHEN 1 THEN status_code END AS status_code,
      NULL::VARCHAR AS request_id, 'csv' AS format FROM logs""",
)
def _(spark, sf):
    e = tb.log_events(spark, sf)
    rows = e.select(
        "run_id",
        "line_no",
        F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss").alias("Created_At"),
        F.col("service_name").alias("APP"),
        tb.one_of(tb.RAW_LEVELS, F.col("line_no")).alias("Severity"),
        F.col("message").alias("text"),
        F.when(F.col("line_no") % 3 == 0, "").when(F.col("line_no") % 3 == 1, F.col("status_code").cast("string"))
        .otherwise("n/a").alias("Code"),
    )
    headers = ["Created_At", "APP", "Severity", "text", "Code"]
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return ex.extract_csv(rows, headers, as_of).select(*_PARSED)


@query(
    "parse_mixed",
    f"""SELECT line_no, {_SECOND} AS timestamp, CASE WHEN line_no % 6 < 5 THEN service_name
        ELSE coalesce(nullif(regexp_extract(service_name || ' | ' || message, '\\b([a-z0-9_\\-]+-service|[a-z0-9_\\-]+-api|gateway|database|auth|payment)\\b', 1), ''), 'system') END AS service_name,
      level, CASE line_no % 6 WHEN 2 THEN 'false' WHEN 5 THEN
        trim(regexp_replace('| ' || service_name || ' | ' || message, '(?i)\\b(' || level || ')\\b', '', 'g'), ': []-' || chr(9)) ELSE message END AS message,
      CASE line_no % 6 WHEN 4 THEN 'r' || chr(30) || line_no END AS request_id,
      CASE line_no % 6 WHEN 1 THEN 'syslog' WHEN 2 THEN 'json' WHEN 3 THEN 'json' WHEN 5 THEN 'fallback' ELSE 'bracket' END AS format FROM logs""",
)
def _(spark, sf):
    """Lines of all kinds in one file: quoted and bare falsy values, dates in words, a separator in an id."""
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")
    parsed = ex.extract_lines(tb.mixed_lines(spark, sf), as_of)
    return parsed.select("line_no", "timestamp", "service_name", "level", "message", "request_id", "format")


@query(
    "parse_dates",
    """SELECT event_id, CASE WHEN event_id % 13 IN (11, 12) THEN date_trunc('minute', ts) WHEN event_id % 13 = 8 THEN date_trunc('millisecond', ts)
      ELSE date_trunc('second', ts) END AS timestamp FROM events""",
)
def _(spark, sf):
    """Dates in thirteen shapes; those without a year are of the year of the newest event."""
    written = tb.dates_as_text(spark, sf)
    return written.select("event_id", time.parse_timestamp(F.col("written"), F.lit(tb.latest_time(spark, sf))).alias("timestamp"))


_READ = ["day", "timestamp", "service_name", "level", "message", "status_code", "format"]


def _read_sql(form, message="message", code="status_code"):
    return (
        f"SELECT run_id AS day, ts AS timestamp, service_name, level, {message} AS message, {code} AS status_code, '{form}' AS format FROM d_logs"
    )


def _read_back(kind: str, reader):
    def run(spark, sf):
        files = scratch(spark, "files")
        tb.write_daily_files(tb.log_events(spark, sf, True), files, kind)
        events = reader(spark, f"{files}/*", F.lit("2030-01-01 00:00:00").cast("timestamp"))
        return events.withColumn("day", F.regexp_extract("run_id", "day=([0-9-]+)", 1)).select(_READ)

    return run


_TWO_LINES = "(message || CASE WHEN line_no % 5 = 0 THEN chr(10) || '\"so it goes\", again' ELSE '' END)"
query("read_text_logs", _read_sql("bracket", code=_CODE.format("message")))(_read_back("text", readers.read_text_logs))
query("read_json_lines", _read_sql("json"))(_read_back("lines", readers.read_text_logs))
query("read_json_array", _read_sql("json"))(_read_back("array", readers.read_json_logs))
query("read_csv_logs", _read_sql("csv", _TWO_LINES))(_read_back("csv", readers.read_csv_logs))


@query("level_normalised", f"SELECT {_RAW_LEVEL} AS level, count(*) AS n FROM logs GROUP BY ALL")
def _(spark, sf):
    raw = tb.one_of(tb.RAW_LEVELS, F.col("line_no"))
    return tb.log_events(spark, sf).groupBy(text.normalize_level(raw).alias("level")).agg(F.count("*").alias("n"))


@query("errors_only", "SELECT line_no, service_name, level FROM logs WHERE level IN ('WARNING', 'ERROR', 'CRITICAL')")
def _(spark, sf):
    e = tb.log_events(spark, sf)
    return e.where(text.is_error(F.col("level"))).select("line_no", "service_name", "level")


@query("infra_services", "SELECT DISTINCT service_name, service_name IN ('database', 'auth-service', 'redis-cache') AS infra FROM logs")
def _(spark, sf):
    names = tb.log_events(spark, sf).select("service_name").distinct()
    return names.select("service_name", text.is_infra_service(F.col("service_name")).alias("infra"))


@query("status_codes", f"SELECT doc_id, {_CODE.format('text')} AS status_code FROM documents")
def _(spark, sf):
    return tb.document_logs(spark, sf).select(
        F.col("line_no").alias("doc_id"), text.extract_status_code(F.col("message")).alias("status_code")
    )


@query(
    "request_ids",
    r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'req-' || event_id
      WHEN 1 THEN '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS request_id FROM events""",
)
def _(spark, sf):
    e = tb.table(spark, sf, "events")
    n = F.col("event_id")
    line = F.concat(
        F.col("event_type"),
        F.when(n % 3 == 0, F.concat(F.lit(' req_id="req-'), n.cast("string"), F.lit('", done')))
        .when(n % 3 == 1, F.concat(F.lit(" at 00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"), F.lit(".")))
        .otherwise(F.lit(" request-id none")),
    )
    return e.select("event_id", text.extract_request_id(line).alias("request_id"))


def _tag_sql() -> str:
    from faultline.functions.fixed import OPERATIONAL_PHRASES

    arms = [
        f"SELECT '{tag}' AS tag, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)({'|'.join(words)})')"
        for tag, words in OPERATIONAL_PHRASES.items()
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(arms) + ") WHERE n > 0"


@query("operational_tags", _tag_sql())
def _(spark, sf):
    return ex.tag_counts(tb.document_logs(spark, sf))


@query("replay_shift", "SELECT event_id AS line_no, ts + INTERVAL 1 DAY AS timestamp FROM events")
def _(spark, sf):
    as_of = tb.latest_time(spark, sf)
    events = tb.log_events(spark, sf).withColumn("ts_defaulted", F.lit(False))
    anchor = F.lit(as_of) - F.make_dt_interval(days=F.lit(1))
    return ex.shift_timeline(events, F.lit(as_of), anchor).select("line_no", "timestamp")


# ---------------------------------------------------------------- message similarity


@query("message_templates", "SELECT doc_id AS line_no, template FROM templates")
def _(spark, sf):
    return cl.with_templates(tb.document_logs(spark, sf)).select("line_no", "template")


@query("tfidf_weights", "SELECT first_line AS node, token, round(weight, 6) AS weight FROM weights")
def _(spark, sf):
    templates = stage(cl.template_table(cl.with_templates(tb.document_logs(spark, sf))), "templates", clean=True)
    return cl.tfidf(templates).select("node", "token", "weight")


# Leaders by plain sequential scan over the templates in input order.
_LEADERS = """
, sim_pairs AS MATERIALIZED (SELECT * FROM pairs),
ordered AS MATERIALIZED (SELECT first_line, row_number() OVER (ORDER BY first_line) AS rn FROM tmpl),
scan AS (
  SELECT 0::BIGINT AS rn, []::BIGINT[] AS leaders
  UNION ALL
  SELECT o.rn, CASE WHEN EXISTS (SELECT 1 FROM sim_pairs p WHERE p.j = o.first_line AND list_contains(s.leaders, p.i))
    THEN s.leaders ELSE list_append(s.leaders, o.first_line) END
  FROM scan s JOIN ordered o ON o.rn = s.rn + 1),
leaders AS MATERIALIZED (SELECT unnest(leaders) AS leader FROM scan WHERE rn = (SELECT count(*) FROM ordered)),
placed AS MATERIALIZED (
  SELECT leader AS first_line, leader, 1.0::DOUBLE AS sim FROM leaders UNION ALL
  SELECT j, min(i), arg_min(sim, i) FROM sim_pairs JOIN leaders ON leader = i
  WHERE j NOT IN (SELECT leader FROM leaders) GROUP BY j),
clustered AS (SELECT leader, first_line, n, template FROM placed JOIN tmpl USING (first_line))
"""


@query("leader_similarity", "{LEADERS} SELECT first_line AS node, leader, round(sim, 6) AS sim FROM placed")
def _(spark, sf):
    templates = cl.template_table(cl.with_templates(tb.document_logs(spark, sf)))
    vectors = cl.term_vectors(stage(templates, "templates", clean=True, codec=cl.CODEC), last=True)
    return cl.leader_assignment(vectors).select("node", "leader", "sim")


@query(
    "message_clusters",
    """{LEADERS} SELECT row_number() OVER (ORDER BY leader) - 1 AS cluster_id, template, count FROM (
      SELECT leader, arg_max(template, n * 1000000000 - first_line) AS template, sum(n)::BIGINT AS count
      FROM clustered GROUP BY leader)""",
)
def _(spark, sf):
    clusters, _ = cl.cluster_messages(tb.document_logs(spark, sf))
    return clusters.select("cluster_id", "template", "count")


@query(
    "message_cluster_assignments",
    """{LEADERS} SELECT t.doc_id AS line_no, dense_rank() OVER (ORDER BY leader) - 1 AS cluster_id
    FROM templates t JOIN clustered c ON c.template = t.template""",
)
def _(spark, sf):
    _, assignments = cl.cluster_messages(tb.document_logs(spark, sf))
    return assignments.select("line_no", "cluster_id")


def oracle_sql() -> dict[str, str]:
    from faultline.plans.oracles import build

    out = {}
    for name, sql in ORACLES.items():
        if sql.startswith("{LEADERS}"):
            head = build("SELECT pairs.i, tmpl.n, templates.template FROM pairs, tmpl, templates")
            out[name] = head[: head.rindex("\nSELECT")] + _LEADERS + sql.removeprefix("{LEADERS}")
        else:
            out[name] = build(sql)
    return out
