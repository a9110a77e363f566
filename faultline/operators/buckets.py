"""Per-service time series: bucket counters and their baselines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import text, time

SERIES = ["run_id", "service_name"]


def bucket_counts(events: DataFrame, minutes: int, dependency_hits: bool = False) -> DataFrame:
    """Counters per run, service and bucket.

    Partial aggregation reduces a noisy service to one row per bucket and task before
    the shuffle. ``dependency_hits`` adds the number of error logs whose text names a
    database or a connection, so root-cause scoring needs no second pass over the logs.
    """
    level = F.col("level")
    counters = [
        F.count("message").alias("total_logs"),
        F.count_if(text.is_error(level)).alias("error_count"),
        F.count_if(text.is_critical(level)).alias("critical_count"),
        F.count_if(text.is_5xx(F.col("status_code"))).alias("status_5xx_count"),
    ]
    if dependency_hits:
        hit = text.is_error(level) & text.mentions_dependency(F.col("message"))
        counters.append(F.count_if(hit).alias("dependency_hits"))
    bucket = time.round_to_bucket(F.col("timestamp"), minutes)
    return events.groupBy(*SERIES, bucket.alias("bucket")).agg(*counters)


def baselines(buckets: DataFrame) -> DataFrame:
    """Mean and population deviation per service over its existing buckets.

    A grouped aggregate and not a window: no task ever holds the whole series of a service.
    """
    return buckets.groupBy(*SERIES).agg(
        F.count("*").alias("n_buckets"),
        F.min("bucket").alias("first_bucket"),
        F.avg("error_count").alias("mean_errors"),
        F.stddev_pop("error_count").alias("std_errors"),
        F.avg("total_logs").alias("mean_logs"),
        F.stddev_pop("total_logs").alias("std_logs"),
        F.max("critical_count").alias("max_critical"),
        F.max("status_5xx_count").alias("max_5xx"),
    )
