"""Incidents built from the evidence, their timeline, search and status changes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import fixed


def severity_weight(severity: Column) -> Column:
    weight = None
    for name, value in fixed.SEVERITY_WEIGHT.items():
        weight = F.when(severity == name, value) if weight is None else weight.when(severity == name, value)
    return weight.otherwise(0)


def is_open(status: Column) -> Column:
    return status.isin(fixed.OPEN_STATUSES)


def build_incidents(roots: DataFrame, evidence: DataFrame) -> DataFrame:
    """One OPEN incident per run with anomalies.

    Evidence stays a table of its own keyed by run (``incident_events``), because the
    anomalies of a run have no upper bound; only the service names are nested.
    """
    level = F.col("level")
    per_run = evidence.groupBy("run_id").agg(
        F.bool_or(level == "CRITICAL").alias("any_critical"),
        F.bool_or(level == "ERROR").alias("any_error"),
        F.bool_or(level == "WARNING").alias("any_warning"),
    )
    n = F.size("services_in_order")
    severity = (
        F.when(F.col("any_critical") | (n >= 3), F.lit("CRITICAL"))
        .when(F.col("any_error") | (n >= 2), F.lit("HIGH"))
        .when(F.col("any_warning"), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
    root = F.col("likely_root_cause")
    title = (
        F.when(
            F.col("severity") == "CRITICAL",
            F.concat(
                F.lit("Critical service degradation starting at "), F.date_format("start_time", "HH:mm"),
                F.lit(" due to "), root, F.lit(" failure"),
            ),
        )
        .when(
            F.col("severity") == "HIGH",
            F.concat(F.lit("High-error spike in "), root, F.lit(" affecting downstream services")),
        )
        .otherwise(F.concat(F.lit("Multiple anomalies detected in "), root))
    )
    return (
        roots.join(per_run, "run_id")
        .withColumn("severity", severity)
        .select(
            "run_id",
            title.alias("title"),
            "severity",
            F.lit("OPEN").alias("status"),
            "start_time",
            F.lit(None).cast("timestamp").alias("end_time"),
            F.array_sort("services_in_order").alias("affected_services"),
            root.alias("root_cause"),
            "confidence",
            "summary",
        )
    )


def incident_timeline(evidence: DataFrame) -> DataFrame:
    """Timeline row of each evidence row."""
    root, serious = F.col("is_root_cause_indicator"), F.col("level").isin("ERROR", "CRITICAL")
    return evidence.select(
        "run_id",
        "timestamp",
        "service_name",
        "level",
        "message",
        F.when(root, F.lit("root_cause_indicator"))
        .when(serious, F.lit("critical_error"))
        .otherwise(F.lit("anomaly"))
        .alias("event_type"),
        F.when(root, 5).when(serious, 4).otherwise(3).alias("importance"),
    )


def search_incidents(
    incidents: DataFrame, status: str | None = None, severity: str | None = None, search: str | None = None
) -> DataFrame:
    """Optional filters, then open first, most severe first, newest first."""
    found = incidents
    if status:
        found = found.where(F.col("status") == status)
    if severity:
        found = found.where(F.col("severity") == severity)
    if search:
        like = f"%{search}%"
        found = found.where(
            F.col("title").ilike(like) | F.col("summary").ilike(like) | F.col("root_cause").ilike(like)
        )
    return found.orderBy(
        F.when(is_open(F.col("status")), 0).otherwise(1),
        severity_weight(F.col("severity")).desc(),
        F.col("start_time").desc(),
        "run_id",
    )


def get_incident(incidents: DataFrame, run_id: str) -> DataFrame:
    return incidents.where(F.col("run_id") == run_id)


def incidents_with_events(incidents: DataFrame, timeline: DataFrame) -> DataFrame:
    """Each incident with its timeline, one row per timeline event (a lone row when it has none)."""
    rows = timeline.select(
        "run_id",
        F.col("timestamp").alias("event_time"),
        "service_name",
        F.col("level").alias("event_level"),
        "message",
        "event_type",
        "importance",
    )
    return incidents.join(rows, "run_id", "left")


def apply_status_changes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Current state after an append-only log of (run_id, status, at, change_id).

    The latest change wins; it is found by aggregation, which keeps one row per incident
    and task before the shuffle however long an incident's history is.
    """
    latest = changes.groupBy("run_id").agg(
        F.max_by(F.struct("status", "at"), F.struct("at", "change_id")).alias("last")
    )
    ended = F.col("last.status").isin(fixed.ENDED_STATUSES)
    changed = F.col("last").isNotNull()
    out = incidents.columns
    return (
        incidents.join(latest, "run_id", "left")
        .withColumn("end_time", F.when(changed, F.when(ended, F.col("last.at"))).otherwise(F.col("end_time")))
        .withColumn("status", F.coalesce("last.status", "status"))
        .select(*out)
    )


def severity_distribution(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity").agg(F.count("*").alias("count"))


def severity_distribution_filled(incidents: DataFrame) -> DataFrame:
    """Counts for the four known severities, zero where none exists."""
    spark = incidents.sparkSession
    labels = spark.createDataFrame([(name,) for name in fixed.SEVERITY_WEIGHT], "severity string")
    known = severity_distribution(incidents.select(F.upper("severity").alias("severity")))
    return labels.join(known, "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("count"))
