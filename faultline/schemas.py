"""Column contracts shared by readers, operators and sinks."""

from pyspark.sql import types as T

RAW_LINES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("value", T.StringType()),
    ]
)

LOG_EVENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts_defaulted", T.BooleanType()),
        T.StructField("format", T.StringType()),
    ]
)

SERVICES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_rate", T.DoubleType()),
        T.StructField("anomaly_count", T.LongType()),
    ]
)

INCIDENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("affected_services", T.ArrayType(T.StringType())),
        T.StructField("root_cause", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("summary", T.StringType()),
    ]
)

INCIDENT_EVENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("importance", T.IntegerType()),
    ]
)

STATUS_CHANGES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("change_id", T.LongType()),
    ]
)

EVIDENCE = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("first_bucket", T.TimestampType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("is_root_cause_indicator", T.BooleanType()),
        T.StructField("message", T.StringType()),
    ]
)

ANALYSIS_RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("logs_processed", T.LongType()),
        T.StructField("anomalies_detected", T.LongType()),
        T.StructField("incidents_created", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

ANOMALIES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("total_logs", T.LongType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("critical_count", T.LongType()),
        T.StructField("status_5xx_count", T.LongType()),
        T.StructField("mean_errors", T.DoubleType()),
        T.StructField("std_errors", T.DoubleType()),
        T.StructField("z_errors", T.DoubleType()),
        T.StructField("z_logs", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason_codes", T.ArrayType(T.StringType())),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("sample_messages", T.ArrayType(T.StringType())),
    ]
)
