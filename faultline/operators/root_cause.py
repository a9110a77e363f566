"""Root-cause scoring per run, evidence rows and the narrative."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from faultline.functions import text

SERIES = ["run_id", "service_name"]

DAY_US = 86_400_000_000

NO_ANOMALIES = "No anomalies detected to evaluate root cause."


def service_hints(buckets: DataFrame) -> DataFrame:
    """What the error logs of a service say, rolled up from counters that carry ``dependency_hits``."""
    return buckets.groupBy(*SERIES).agg(
        (F.sum("critical_count") > 0).alias("has_critical"),
        (F.sum("dependency_hits") > 0).alias("has_dependency_text"),
    )


def hints_from_events(events: DataFrame) -> DataFrame:
    """The same hints read from error logs directly."""
    errors = events.where(text.is_error(F.col("level")))
    return errors.groupBy(*SERIES).agg(
        F.bool_or(text.is_critical(F.col("level"))).alias("has_critical"),
        F.bool_or(text.mentions_dependency(F.col("message"))).alias("has_dependency_text"),
    )


def first_seen(anomalies: DataFrame) -> DataFrame:
    """First anomaly per service; ``first_bucket`` is the service's first active bucket."""
    return anomalies.groupBy(*SERIES).agg(
        F.min("timestamp").alias("first_ts"), F.min("first_bucket").alias("first_bucket")
    )


def later_services(seen: DataFrame) -> DataFrame:
    """(run_id, first_ts) with ``run_start`` and the number of services of ``seen`` that began strictly later.

    Services are counted per instant, and instants per day, so a run of any number of services is
    ordered in rows of instants of one day, and of days: bucket times, few of either.
    """
    day = F.floor(F.unix_micros("first_ts") / DAY_US)
    instants = seen.groupBy("run_id", "first_ts").agg(F.count("*").alias("n")).withColumn("day", day)
    days = instants.groupBy("run_id", "day").agg(F.sum("n").alias("n"), F.min("first_ts").alias("day_start"))
    run = Window.partitionBy("run_id")
    days_after = run.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    days = days.select(
        "run_id", "day", F.coalesce(F.sum("n").over(days_after), F.lit(0)).alias("beyond"), F.min("day_start").over(run).alias("run_start")
    )
    rest_of_day = Window.partitionBy("run_id", "day").orderBy("first_ts").rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.sum("n").over(rest_of_day), F.lit(0)) + F.col("beyond")
    return instants.join(days, ["run_id", "day"]).select("run_id", "first_ts", "run_start", later.alias("later_services"))


def score_services(anomalies: DataFrame, hints: DataFrame) -> DataFrame:
    """Score of every anomalous service."""
    instant = F.unix_micros("first_ts")
    seen = first_seen(anomalies).join(hints, SERIES, "left")
    seen = seen.join(later_services(first_seen(anomalies)), ["run_id", "first_ts"])
    lag_us = instant - F.unix_micros("run_start")
    chronology = (
        F.when(lag_us == 0, 40).when(lag_us <= 60_000_000, 25).when(lag_us <= 180_000_000, 10).otherwise(0)
    )

    def points(cond: Column, n: int) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    score = (
        chronology
        + points(text.is_infra_service(F.col("service_name")), 30)
        + F.col("later_services") * 15
        + points(F.col("has_critical"), 15)
        + points(F.col("has_dependency_text"), 10)
    )
    return seen.select(*SERIES, "first_ts", "first_bucket", "later_services", score.cast("double").alias("score"))


def pick_root(scores: DataFrame) -> DataFrame:
    """One row per run: root cause, confidence, summary and the services in order of appearance."""
    seen_order = F.struct("first_ts", "first_bucket", "service_name")
    rank = F.struct((-F.col("score")).alias("neg"), "first_ts", "first_bucket", "service_name")
    run = scores.groupBy("run_id").agg(
        F.min_by(F.struct("service_name", "score"), rank).alias("root"),
        F.min(seen_order).alias("first"),
        F.array_sort(F.collect_list(seen_order)).alias("seen"),
    )
    names = F.transform("seen", lambda s: s["service_name"])
    root, first = F.col("root.service_name"), F.col("first.service_name")
    confidence = F.bround(F.least(F.lit(0.98), F.greatest(F.lit(0.30), F.col("root.score") / 110.0)), 2)

    def quoted(name: Column) -> Column:
        return F.concat(F.lit("`"), name, F.lit("`"))

    direct = F.concat(
        F.lit("Incident began directly in the "), quoted(root), F.lit(" service at "),
        F.date_format("first.first_ts", "HH:mm:ss"), F.lit(". Errors subsequently propagated to "),
        (F.size("seen") - 1).cast("string"), F.lit(" other services: "),
        F.array_join(F.transform(names, quoted), ", "), F.lit("."),
    )
    upstream = F.concat(
        F.lit("Incident likely originated in the infrastructure layer "), quoted(root), F.lit(". Although "),
        quoted(first), F.lit(" experienced the first symptom, upstream analysis points to "),
        quoted(root), F.lit(" as the primary source of failure."),
    )
    return run.select(
        "run_id",
        root.alias("likely_root_cause"),
        F.col("root.score").alias("score"),
        confidence.alias("confidence"),
        F.when(root == first, direct).otherwise(upstream).alias("summary"),
        names.alias("services_in_order"),
        F.col("first.first_ts").alias("start_time"),
    )


def root_cause(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """Result for every run, with the fixed answer for runs without anomalies."""
    return runs.select("run_id").join(roots, "run_id", "left").select(
        "run_id",
        F.coalesce("likely_root_cause", F.lit("Unknown")).alias("likely_root_cause"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("summary", F.lit(NO_ANOMALIES)).alias("summary"),
    )


def evidence_level(reasons: Column) -> Column:
    words = F.lower(F.array_join(reasons, ""))
    return (
        F.when(words.contains("critical"), F.lit("CRITICAL"))
        .when(words.contains("error") | words.contains("5xx"), F.lit("ERROR"))
        .otherwise(F.lit("WARNING"))
    )


def evidence_chain(anomalies: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per anomaly with its level and root flag; order by (timestamp, first_bucket, service_name)."""
    sample = F.coalesce(F.get("sample_messages", F.lit(0)), F.lit(""))
    message = F.concat(
        F.lit("Service ["), F.col("service_name"), F.lit("] flagged anomaly: "),
        F.array_join("reasons", ", "), F.lit('. Sample: "'), sample, F.lit('"'),
    )
    return anomalies.join(roots.select("run_id", "likely_root_cause"), "run_id").select(
        "run_id",
        "timestamp",
        "first_bucket",
        "service_name",
        evidence_level(F.col("reasons")).alias("level"),
        "reasons",
        F.col("confidence"),
        (F.col("service_name") == F.col("likely_root_cause")).alias("is_root_cause_indicator"),
        message.alias("message"),
    )
