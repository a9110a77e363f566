"""Intermediates go to a shared folder or nowhere."""

from types import SimpleNamespace

import pytest

from faultline.functions import staging


def session(master, **conf):
    return SimpleNamespace(
        sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.split(".")[1], d))
    )


def test_folder():
    assert staging.scratch_root(session("yarn", checkpoint="hdfs:///x/")) == "hdfs:///x"
    assert staging.scratch_root(session("yarn", sql="hdfs:///w")) == "hdfs:///w/scratch"
    assert staging.scratch_root(session("local[4]", sql="file:/w")) == "file:/w/scratch"
    assert staging.scratch_root(session("yarn", sql="file:/w"), "s3a://b/t") == "s3a://b/t"
    for master in ("yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            staging.scratch_root(session(master, sql="file:/w"))


def test_stage_and_release(spark):
    df = staging.stage(spark.range(5), "five")
    assert df.count() == 5
    staging.release(spark)
    with pytest.raises(Exception, match="(?i)not.exist"):
        df.count()


def test_stage_bucketed(spark):
    df = staging.stage_bucketed(spark.range(50).selectExpr("id % 7 AS k", "id"), "sevens", "k", 3)
    counts = df.groupBy("k").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sum(r["count"] for r in counts.collect()) == 50
    staging.release(spark)


def test_discard_removes_one_table(spark):
    first, second = (staging.stage(spark.range(n), "some", codec="zstd") for n in (3, 5))
    staging.discard(first, second.filter("id > 1"))
    assert second.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist"):
        first.count()
    staging.release(spark)


def test_shuffle_setting_comes_back(spark):
    before = spark.conf.get(staging.CLEANUP)
    with pytest.raises(ZeroDivisionError), staging.without_shuffles(spark):
        assert spark.conf.get(staging.CLEANUP) == "true"
        1 / 0  # noqa: B018
    assert spark.conf.get(staging.CLEANUP) == before
