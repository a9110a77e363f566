"""Plan shapes that matter at scale."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import anomalies as an
from faultline.operators import services as sv
from faultline.operators.buckets import bucket_counts
from faultline.sources import tables as tb

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_reaches_the_scan(spark):
    text = plan(sv.recent_error_rates(tb.log_events(spark, SF), F.lit(tb.latest_time(spark, SF))))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    assert "PushedFilters: [IsNotNull(ts)" in text


def test_samples_cut_before_the_shuffle(spark):
    logs = tb.log_events(spark, SF)
    text = plan(an.anomaly_samples(an.detect_anomalies(bucket_counts(logs, 60)), logs, 60))
    assert "row_number(), 3, Partial" in text and "row_number(), 3, Final" in text
    # logs meet the bitmap of anomalous cells, unshuffled, before they are sorted
    below = text[text.index("row_number(), 3, Partial"):]
    below = below[:below.index("Scan parquet")]
    assert "BroadcastHashJoin [word" in below and "SortMergeJoin" not in below
    assert "Exchange" not in below[:below.index("BroadcastHashJoin [word")]


def test_baseline_reuses_the_counters(spark):
    df = an.detect_anomalies(bucket_counts(tb.log_events(spark, SF), 60))
    df.collect()
    assert "ReusedExchange" in plan(df)


@pytest.mark.parametrize("name", ["anomalies_rules", "evidence_chain", "service_health", "dashboard_status"])
def test_no_cross_join(spark, name):
    from faultline.plans.catalog import QUERIES

    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_counters_have_no_python(spark):
    assert "Python" not in plan(an.detect_anomalies(bucket_counts(tb.log_events(spark, SF), 60)))
