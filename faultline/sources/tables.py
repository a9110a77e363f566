"""Log events derived from the analytics tables ``events`` and ``documents``.

A deterministic mapping gives every row of ``events`` a service, a level, a status code
and a message, so that all operators run over whole tables of any size.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.schemas import LOG_EVENTS

DEMO_SERVICES = [
    "database", "payment-api", "gateway-service", "auth-service",
    "redis-cache", "orders-api", "external-stripe", "search-service",
]
RAW_LEVELS = ["info", "WARN", " Error ", "FATAL", "debug", "TRACE", "critical", "Warning"]
CHANGE_STATUSES = ["OPEN", "INVESTIGATING", "RESOLVED", "CLOSED"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(number, F.lit(len(names))) + 1).cast("int"))


def log_events(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """``events`` as log events of one run, or of one run per day."""
    return _as_log_events(table(spark, sf_dir, "events"), daily)


def stream_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mapping over ``events`` read as a stream."""
    schema = table(spark, sf_dir, "events").schema
    stream = _as_log_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet"), False)
    return stream.withColumn("ts_defaulted", F.lit(False))  # every row of the table has its time


def _as_log_events(e: DataFrame, daily: bool) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    is_err = F.col("event_type") == "error"
    level = (
        F.when(is_err & (F.col("value") >= 150), "CRITICAL")
        .when(is_err, "ERROR")
        .when(F.col("value") >= 100, "WARNING")
        .when(F.col("event_type") == "view", "DEBUG")
        .otherwise("INFO")
    )
    status = F.when(is_err & (k < 5), 500 + k).when(is_err & (k < 20), 404).otherwise(200)
    message = F.concat(
        F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"),
        F.lit(" value "), F.col("value").cast("decimal(12,2)").cast("string"),
        F.when(is_err & (k % 3 == 0), F.lit(" database timeout")).otherwise(F.lit("")),
    )
    run = F.date_format(ts, "yyyy-MM-dd") if daily else F.lit("all")
    return e.select(
        run.alias("run_id"),
        F.col("event_id").alias("line_no"),
        ts.alias("timestamp"),
        one_of(DEMO_SERVICES, F.col("user_id")).alias("service_name"),
        level.alias("level"),
        message.alias("message"),
        status.cast("int").alias("status_code"),
    )


def whole_events(events: DataFrame) -> DataFrame:
    """``events`` with the columns that the mapping leaves out, as nulls."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in LOG_EVENTS if f.name not in events.columns}
    return events.withColumns(missing | {"ts_defaulted": F.lit(False)}).select(LOG_EVENTS.fieldNames())


def write_daily_files(events: DataFrame, folder: str, kind: str = "lines") -> None:
    """``events`` of daily runs as files below ``folder``/day=..., one per day, in input order.

    ``kind``: JSON ``lines`` or bracket ``text`` in text files, a JSON ``array``, or ``csv`` whose
    messages run over two lines now and then.
    """
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    fields = [stamp, F.col("service_name").alias("service"), F.col("level"), F.col("message"), F.col("status_code")]
    dated = events.withColumn("day", F.col("run_id"))
    if kind == "csv":
        two_lines = F.when(F.col("line_no") % 5 == 0, F.concat("message", F.lit('\n"so it goes", again'))).otherwise(F.col("message"))
        rows = dated.select("day", "line_no", *fields[:3], two_lines.alias("message"), "status_code")
        rows = rows.repartition("day").sortWithinPartitions("day", "line_no").drop("line_no")
        rows.write.partitionBy("day").options(header=True, escape='"', ignoreLeadingWhiteSpace=False).csv(folder)
        return
    value = F.to_json(F.struct(*fields))
    if kind == "text":
        value = F.format_string("[%s] [%s] [%s] %s", stamp, "service_name", "level", "message")
    if kind == "array":
        ends = dated.groupBy("day").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
        dated = dated.join(ends, "day")
        opening = F.when(F.col("line_no") == F.col("first"), "[").otherwise(" ,")
        value = F.concat(opening, value, F.when(F.col("line_no") == F.col("last"), "]").otherwise(""))
    lines = dated.select("day", "line_no", value.alias("value"))
    dealt = lines.repartition("day").sortWithinPartitions("day", "line_no").select("day", "value")
    if kind == "array":  # the writer of unquoted one-column CSV gives its files any ending
        plain = {"header": False, "quote": "", "sep": "\x01", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "escape": "", "extension": "json"}
        dealt.write.partitionBy("day").options(**plain).csv(folder)
    else:
        dealt.write.partitionBy("day").text(folder)


#: Shapes of dates, as patterns for writing them, with the precision that they keep.
DATE_SHAPES = [
    ("MMM d HH:mm:ss", "second"), ("d MMM yyyy HH:mm:ss", "second"), ("yyyyMMdd'T'HHmmss'Z'", "second"),
    ("EEE MMM d HH:mm:ss yyyy", "second"), ("MMMM d, yyyy h:mm:ss a", "second"), ("dd-MMM-yyyy HH:mm:ss", "second"),
    ("MM/dd/yyyy HH:mm:ss", "second"), ("dd/MMM/yyyy:HH:mm:ss '+0000'", "second"), ("yyyy.MM.dd HH:mm:ss,SSS", "millisecond"),
    ("EEEE, MMMM d, yyyy HH:mm:ss 'UTC'", "second"), ("HH:mm:ss yyyy/MM/dd", "second"), ("yyyyMMddHHmm", "minute"), ("M/d/yy HH:mm", "minute"),
]


def dates_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and its time written in one shape of ``DATE_SHAPES``, in turn."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    shaped = F.coalesce(*[F.when(F.col("event_id") % len(DATE_SHAPES) == i, F.date_format("ts", p)) for i, (p, _) in enumerate(DATE_SHAPES)])
    return e.select("event_id", shaped.alias("written"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw lines of six shapes in turn."""
    e = log_events(spark, sf_dir)
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    words = F.date_format("timestamp", "d MMM yyyy HH:mm:ss")
    shapes = [
        F.format_string("[%s] [%s] [%s] %s", stamp, "service_name", "level", "message"),
        F.format_string("%s %s %s: %s", stamp, "service_name", "level", "message"),
        F.format_string('{"time": "%s", "service": "%s", "level": "%s", "message": "false", "msg": "%s"}', stamp, "service_name", "level", "message"),
        F.format_string('{"date": "%s", "logger": "%s", "severity": "%s", "message": false, "msg": 0.0, "log": "%s"}', words, "service_name", "level", "message"),
        F.format_string("[%s] [%s] [%s] [r\x1e%s] %s", words, "service_name", "level", "line_no", "message"),
        F.format_string("%s %s | %s | %s", stamp, "level", "service_name", "message"),
    ]
    value = F.coalesce(*[F.when(F.col("line_no") % len(shapes) == i, s) for i, s in enumerate(shapes)])
    return e.select("run_id", F.lit("events").alias("file_name"), "line_no", value.alias("value"))


def latest_time(spark: SparkSession, sf_dir: str):
    """Newest event time, read as one aggregated row; it becomes the ``as_of`` literal."""
    return table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("m")).first()["m"]


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status log of the daily incidents, one change per signup event."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        F.date_format(ts, "yyyy-MM-dd").alias("run_id"),
        one_of(CHANGE_STATUSES, F.col("event_id")).alias("status"),
        ts.alias("at"),
        F.col("event_id").alias("change_id"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as one log message."""
    return table(spark, sf_dir, "documents").select(
        F.lit("all").alias("run_id"), F.col("doc_id").alias("line_no"), F.col("text").alias("message")
    )


def raw_lines(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """``events`` written out as raw lines of one shape."""
    e = log_events(spark, sf_dir)
    raw_level = one_of(RAW_LEVELS, F.col("line_no"))
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    body = F.concat(F.col("message"), F.lit(" status "), F.col("status_code").cast("string"))
    request = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("[req-"), F.col("line_no"), F.lit("] "))).otherwise("")
    if shape == "bracket":
        value = F.concat(
            F.lit("["), stamp, F.lit("] ["), F.col("service_name"), F.lit("] ["), raw_level, F.lit("] "), request, body
        )
    elif shape == "syslog":
        value = F.concat(
            stamp, F.lit(" "), F.col("service_name"), F.lit(" "), F.col("level"), F.lit(": "), body,
            F.lit(" trace_id=("), F.col("line_no"), F.lit(")"),
        )
    elif shape == "json":
        value = F.to_json(
            F.struct(
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
                F.when(F.col("line_no") % 3 != 0, F.col("service_name")).alias("service"),
                F.col("service_name").alias("logger"),
                raw_level.alias("severity"),
                F.lit("").alias("message"),
                body.alias("msg"),
                F.when(F.col("line_no") % 5 == 0, F.lit("OK"))
                .when(F.col("line_no") % 5 != 1, F.col("status_code").cast("string"))
                .alias("status"),
                F.concat(F.lit("r"), F.col("line_no")).alias("req_id"),
            )
        )
    else:
        value = F.concat(
            F.lit("- "), stamp, F.lit(" pid "), F.col("service_name"), F.lit("[22] "), F.col("level"), F.lit(" - "), body
        )
    return e.select("run_id", F.lit("events").alias("file_name"), "line_no", value.alias("value"))
