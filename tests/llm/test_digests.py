"""Fingerprints against a plain loop, and what their likeness says."""

import hashlib
import random

import pytest

from faultline.llm import digests

SCHEMA = "doc_id long, text string, n_chars int, edited int, part string, mark string"


def brute(data):
    rows = [(i, t or "") for i, t, *_ in data]
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        d, e, n = (digests.digest(x.encode()) for x in (t, edited, after))
        near = [round(float(digests.likeness([d], [x])[0]), 9) for x in (e, n)]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), d.hex(), e.hex(), *near)
    return out


def rows(n=300):
    rng = random.Random(2)
    syll = ["th", "er", "on", "an", "re", "é", "日本", "🙂", "st", "en", "ing "]
    data = [(i * 3 - 40, "".join(rng.choices(syll, k=rng.choice([0, 1, 2, 30, 500]))), 1, 1, "", "") for i in range(n)]
    data[5] = (data[5][0], None, 1, 1, "", "")
    data[9] = (data[9][0], "ab" * 300_000, 1, 1, "", "")
    return data


@pytest.mark.parametrize("parts", [1, 13])
def test_against_loop(spark, parts):
    data = rows()
    shuffled = random.Random(1).sample(data, len(data))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = digests.fingerprint_report(spark.createDataFrame(shuffled, SCHEMA).repartition(5)).collect()
        texts = digests.fingerprints(spark.createDataFrame(shuffled, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r[0]: (*r[1:5], round(r[5], 9), round(r[6], 9)) for r in got} == brute(data) and len(got) == len(data)
    assert {r[0]: hashlib.sha256(r[2].encode()).hexdigest() for r in texts} == {r[0]: r[2] for r in got}


def test_odd_tables(spark):
    assert digests.fingerprint_report(spark.createDataFrame([], SCHEMA)).collect() == []
    one = digests.fingerprint_report(spark.createDataFrame([(3, "abcdef", 1, 1, "", "")], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0
    same = [(1, "x y z", 1, 1, "", "")] * 3 + [(None, "q", 1, 1, "", ""), (None, None, 1, 1, "", "")]
    got = digests.fingerprint_report(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1


def test_likeness(spark):
    got = [r for r in digests.fingerprint_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.n_chars > 300]
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert sum(r.near_edited > r.near_next for r in got) / len(got) > 0.99
    assert sorted(r.near_next for r in got)[len(got) // 2] < 0.35
    a = digests.digest(b"one text of some length")
    assert digests.likeness([a, a], [a, digests.digest(b"")]).tolist() == [1.0, 0.0]
