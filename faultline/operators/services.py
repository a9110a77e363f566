"""Service dimension and service health."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.operators.incidents import is_open, severity_weight


def discovered_services(events: DataFrame) -> DataFrame:
    """Service rows for the distinct names in ``events``."""
    names = events.select(F.col("service_name").alias("name")).where("name is not null").distinct()
    return names.select(
        "name",
        text.service_type(F.col("name")).alias("type"),
        F.lit("HEALTHY").alias("status"),
        F.lit(0.0).alias("error_rate"),
        F.lit(0).cast("bigint").alias("anomaly_count"),
    )


def new_services(events: DataFrame, services: DataFrame) -> DataFrame:
    return discovered_services(events).join(services.select("name"), "name", "left_anti")


def register_services(events: DataFrame, services: DataFrame) -> DataFrame:
    """Existing rows unchanged, new names appended."""
    return services.unionByName(new_services(events, services))


def list_services(services: DataFrame) -> DataFrame:
    return services.orderBy("name")


def attach_services(events: DataFrame, services: DataFrame) -> DataFrame:
    """Service type of each event.

    The planner broadcasts the dimension only when its measured size is below
    spark.sql.autoBroadcastJoinThreshold; a larger one is shuffled and split on skew.
    """
    dim = services.select(F.col("name").alias("service_name"), F.col("type").alias("service_type"))
    return events.join(dim, "service_name", "left")


def rate_percent(errors: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(errors / total * 100.0, 2)).otherwise(F.lit(0.0))


def recent_error_rates(events: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Error rate per service from ``as_of - minutes`` on; the time filter reaches the scan."""
    recent = events.where(F.col("timestamp") >= as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return recent.groupBy("service_name").agg(
        F.count("*").alias("total"), F.count_if(text.is_error(F.col("level"))).alias("errors")
    ).select("service_name", "total", "errors", rate_percent(F.col("errors"), F.col("total")).alias("error_rate"))


def open_severity(incidents: DataFrame) -> DataFrame:
    """Highest severity weight among open incidents per affected service."""
    exploded = incidents.where(is_open(F.col("status"))).select(
        F.explode("affected_services").alias("service_name"), severity_weight(F.col("severity")).alias("w")
    )
    return exploded.groupBy("service_name").agg(F.max("w").alias("severity_weight"))


def recent_anomaly_counts(timeline: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Timeline rows of type exactly ``anomaly`` in the last hour, per service."""
    recent = timeline.where(
        (F.col("event_type") == "anomaly")
        & (F.col("timestamp") >= as_of - F.make_dt_interval(mins=F.lit(minutes)))
    )
    return recent.groupBy("service_name").agg(F.count("*").alias("anomaly_count"))


def service_status(error_rate: Column, weight: Column) -> Column:
    w = F.coalesce(weight, F.lit(0))
    return (
        F.when((error_rate >= 10.0) | (w >= 3), F.lit("CRITICAL"))
        .when((error_rate >= 2.0) | (w >= 1), F.lit("DEGRADED"))
        .otherwise(F.lit("HEALTHY"))
    )


def compute_service_health(
    services: DataFrame, events: DataFrame, incidents: DataFrame, timeline: DataFrame, as_of: Column
) -> DataFrame:
    """Fresh status, error rate and anomaly count of every service, in one plan."""
    rates = recent_error_rates(events, as_of).select("service_name", F.col("error_rate").alias("rate"))
    counts = recent_anomaly_counts(timeline, as_of).withColumnRenamed("anomaly_count", "recent")
    joined = (
        services.select(F.col("name").alias("service_name"), "type")
        .join(rates, "service_name", "left")
        .join(open_severity(incidents), "service_name", "left")
        .join(counts, "service_name", "left")
    )
    rate = F.coalesce("rate", F.lit(0.0))
    return joined.select(
        F.col("service_name").alias("name"),
        "type",
        service_status(rate, F.col("severity_weight")).alias("status"),
        rate.alias("error_rate"),
        F.coalesce("recent", F.lit(0)).alias("anomaly_count"),
    )
