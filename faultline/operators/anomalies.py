"""Anomaly rules over the bucket series, and sample messages for the hits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from faultline.functions import text, time
from faultline.operators.buckets import SERIES, baselines

# z-scores are compared after rounding, so that the order in which tasks add up a
# mean cannot tip a bucket that sits exactly on the threshold.
Z_DIGITS = 9


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, F.round((value - mean) / std, Z_DIGITS))


def scored_buckets(buckets: DataFrame, historical: DataFrame | None = None) -> DataFrame:
    """Buckets with their service's baseline and z-scores.

    Only services on which some rule can fire are joined. ``historical`` (service_name,
    mean_errors, std_errors, mean_logs, std_logs) replaces the statistics of this run.
    """
    base = baselines(buckets)
    if historical is not None:
        stats = ["mean_errors", "std_errors", "mean_logs", "std_logs"]
        past = historical.select("service_name", *[F.col(c).alias(f"past_{c}") for c in stats])
        base = base.join(past, "service_name", "left")
        for c in stats:
            base = base.withColumn(c, F.coalesce(F.col(f"past_{c}"), F.col(c))).drop(f"past_{c}")
        can_fire = F.lit(True)
    else:
        can_fire = (
            (F.col("std_errors") > 0)
            | (F.col("std_logs") > 0)
            | (F.col("max_critical") > 0)
            | (F.col("max_5xx") > 0)
        )
    candidates = base.where(can_fire).drop("max_critical", "max_5xx")
    return (
        buckets.join(candidates, SERIES)
        .withColumn("z_errors", z_score(F.col("error_count"), F.col("mean_errors"), F.col("std_errors")))
        .withColumn("z_logs", z_score(F.col("total_logs"), F.col("mean_logs"), F.col("std_logs")))
    )


def _rules(threshold_z: float, with_forest: bool) -> list[tuple[str, Column, Column, Column]]:
    """(code, condition, confidence, text) in reporting order."""
    errors, z_errors, z_logs = F.col("error_count"), F.col("z_errors"), F.col("z_logs")
    rules = [
        (
            "error_spike",
            z_errors > threshold_z,
            F.least(F.lit(0.95), 0.4 + 0.15 * z_errors),
            F.concat(F.lit("Error count spike (Z-Score: "), text.two_decimals(z_errors), F.lit(")")),
        ),
        (
            # Needs a stored baseline: in-run counts with a zero mean are all zero.
            "first_errors",
            ~(F.col("std_errors") > 0) & (errors > 0) & (F.col("mean_errors") == 0),
            F.lit(0.80),
            F.concat(F.lit("First seen errors ("), errors.cast("string"), F.lit(" errors in window)")),
        ),
        (
            "volume_spike",
            z_logs > threshold_z + 1.0,
            F.least(F.lit(0.90), 0.3 + 0.12 * z_logs),
            F.concat(F.lit("Log volume anomaly (Z-Score: "), text.two_decimals(z_logs), F.lit(")")),
        ),
        (
            "critical",
            F.col("critical_count") > 0,
            F.lit(0.85),
            F.concat(F.col("critical_count").cast("string"), F.lit(" CRITICAL level errors detected")),
        ),
        (
            "http_5xx",
            F.col("status_5xx_count") > 0,
            F.lit(0.90),
            F.concat(F.col("status_5xx_count").cast("string"), F.lit(" HTTP 5xx responses detected")),
        ),
    ]
    if with_forest:
        busy = (errors > F.col("mean_errors")) | (F.col("total_logs") > F.col("mean_logs"))
        rules.append(
            (
                "isolation_forest",
                F.col("forest_outlier") & busy,
                F.lit(0.75),
                F.lit("Flagged by Isolation Forest ML model"),
            )
        )
    return rules


def detect_anomalies(
    buckets: DataFrame,
    threshold_z: float = 2.0,
    historical: DataFrame | None = None,
    outliers: DataFrame | None = None,
) -> DataFrame:
    """One row per anomalous bucket with its reasons and the highest confidence.

    ``outliers`` holds the (run_id, service_name, bucket) keys flagged by the forest.
    """
    scored = scored_buckets(buckets, historical)
    if outliers is not None:
        flags = outliers.select(*SERIES, "bucket", F.lit(True).alias("forest_outlier"))
        scored = scored.join(flags, [*SERIES, "bucket"], "left").withColumn(
            "forest_outlier", F.coalesce("forest_outlier", F.lit(False))
        )
    # Every confidence stands behind its condition: least() alone would turn a null
    # z-score into the cap.
    hits = F.array_compact(
        F.array(
            *[
                F.when(cond, F.struct(F.lit(code).alias("code"), conf.alias("confidence"), words.alias("text")))
                for code, cond, conf, words in _rules(threshold_z, outliers is not None)
            ]
        )
    )
    return (
        scored.withColumn("hits", hits)
        .where(F.size("hits") > 0)
        .select(
            *SERIES,
            F.col("bucket").alias("timestamp"),
            "first_bucket",
            "total_logs",
            "error_count",
            "critical_count",
            "status_5xx_count",
            "mean_errors",
            "std_errors",
            "z_errors",
            "z_logs",
            F.array_max("hits.confidence").alias("confidence"),
            F.col("hits.code").alias("reason_codes"),
            F.col("hits.text").alias("reasons"),
        )
    )


SAMPLES = 3

#: Bits of the bitmap of anomalous cells, in words of 64: a table of at most 131,072 rows, whatever the data.
CELL_BITS = 1 << 23


def _cell_bit(bits: int) -> Column:
    return F.pmod(F.xxhash64(*SERIES, "cell"), F.lit(bits))


def near_anomalies(cells: DataFrame, wanted: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """The rows of ``cells`` whose (run, service, cell) may be in ``wanted``; none that is gets lost.

    A bitmap of fixed size over the hashed keys. It goes to every task, so ``cells`` is not
    shuffled; with very many anomalies it fills up and lets more rows through.
    """
    at = _cell_bit(bits)
    low = at.bitwiseAND(F.lit(63)).cast("int")
    hits = wanted.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), low).alias("mask"))
    words = hits.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    marked = cells.withColumns({"word": F.shiftright(at, 6), "bit": low})
    return marked.join(F.broadcast(words), "word").where(F.bit_get("mask", F.col("bit")) == 1).drop("word", "bit", "mask")


def anomaly_samples(anomalies: DataFrame, events: DataFrame, minutes: int) -> DataFrame:
    """First three messages around each anomaly, error messages first choice.

    The range [bucket - w, bucket + w] is closed at both ends. It equals the two whole
    windows starting at bucket - w and at bucket, plus the single instant bucket + w. So
    the logs near an anomaly, found by a bitmap, are cut to three rows per (run, service,
    window, on-the-instant) cell, which Spark does map-side before any shuffle, and only
    those few rows meet the anomalies in an equi join. A cell with a third of all logs still
    leaves each task with three rows, and logs elsewhere are not sorted.
    """
    width = minutes * time.MINUTE_US
    cells = events.select(
        *SERIES,
        time.floor_index(F.col("timestamp"), minutes).alias("cell"),
        (F.pmod(F.unix_micros("timestamp"), F.lit(width)) == 0).alias("on_edge"),
        (~text.is_error(F.col("level"))).cast("int").alias("rank_group"),
        "line_no",
        "message",
    )
    key = time.floor_index(F.col("timestamp"), minutes)
    wanted = anomalies.select(
        *SERIES, "timestamp", F.explode(F.array(key - 1, key, key + 1)).alias("cell"), key.alias("home")
    )
    order = [F.col("rank_group"), F.col("line_no")]
    first_in_cell = Window.partitionBy(*SERIES, "cell", "on_edge").orderBy(*order)
    numbered = near_anomalies(cells, wanted).withColumn("rn", F.row_number().over(first_in_cell))
    kept = numbered.where(F.col("rn") <= SAMPLES).drop("rn")

    near = wanted.join(kept, [*SERIES, "cell"]).where((F.col("cell") <= F.col("home")) | F.col("on_edge"))
    # At most fifteen rows per anomaly arrive here.
    picked = near.groupBy(*SERIES, "timestamp").agg(
        F.array_sort(F.collect_list(F.struct("rank_group", "line_no", "message"))).alias("rows")
    )
    best = F.element_at("rows", 1)["rank_group"]
    same_kind = F.filter("rows", lambda r: r["rank_group"] == best)
    return picked.select(
        *SERIES, "timestamp", F.transform(F.slice(same_kind, 1, SAMPLES), lambda r: r["message"]).alias("sample_messages")
    )


def with_samples(anomalies: DataFrame, events: DataFrame, minutes: int) -> DataFrame:
    samples = anomaly_samples(anomalies, events, minutes)
    return anomalies.join(samples, [*SERIES, "timestamp"], "left").withColumn(
        "sample_messages", F.coalesce("sample_messages", F.array().cast("array<string>"))
    )
