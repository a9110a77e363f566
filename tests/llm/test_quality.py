"""Held-out accuracy of the classifier, and odd input."""

import random
import zlib

import numpy as np
import pytest

from faultline.llm import quality
from faultline.llm import queries as q

SCHEMA = "doc_id long, text string, score double, row int, label int, source string"


def auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = q.QUERIES["op1_quality"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got[got["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(both) > 500
    assert auc(both["score"].to_numpy(), both["quality"].to_numpy()) > 0.99
    assert (both["predicted"] == both["quality"]).mean() > 0.98


def rows():
    rng = random.Random(1)
    out = []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)]
        out.append((i, " ".join(words) + "." if good else "$$$ ".join(words), 0.5, 1, int(good), "s"))
    return [*out, (None, "a b", 0.1, 1, None, ""), (7, None, 0.1, 1, 1, ""), (8, "", 0.0, 0, 0, ""), (9, "x" * 400_000, 0.0, 0, 0, ""), out[3]]


def test_odd_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    labels = df.selectExpr("doc_id", "label as quality", "'z' as text")
    model = quality.learn(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    again = quality.learn(df.repartition(7), labels.repartition(3))
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))
    whole = quality.score(df, model, keep_row=True)
    assert whole.select("row.*").columns == df.columns
    none = df.limit(0)
    assert quality.score(none, model).collect() == []
    flat = quality.learn(none, labels.limit(0))
    assert {r.score for r in quality.score(df, flat).collect()} == {0.5}


def test_labels_held_out_are_never_seen(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    labels = df.selectExpr("doc_id", "label as quality")
    wrong = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (quality.learn(df, x) for x in (labels, wrong))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables, strict=True))


@pytest.mark.parametrize("text", [b"", b" \n", b"a", "é🙂".encode(), b"\x00\xff" * 10])
def test_features_are_finite(text):
    assert np.isfinite(quality.describe(text)).all()
