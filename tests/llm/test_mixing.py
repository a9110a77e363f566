"""Targets and systematic sampling."""

import math
import random
from collections import Counter, defaultdict

from faultline.llm import mixing
from faultline.llm import queries as q

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, rank int, size string, weight int, _row int"


def level(sizes, weights, share=1.5):
    target = [0.0] * len(sizes)
    capped = set()
    while True:
        rest = share * sum(sizes) - sum(2 * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        if not open_:
            break
        unit = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > 2 * sizes[i]}
        for i in open_:
            target[i] = unit * weights[i]
        for i in capped | over:
            target[i] = 2.0 * sizes[i]
        if not over:
            break
        capped |= over
    return target


def rows():
    rng = random.Random(5)
    out = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "d", "é", "𝄞", "～", None, ""])
        words = 0 if source == "d" and i % 2 else rng.randint(0, 60)
        out.append((i, " \t".join(["w"] * words) + rng.choice(["", "\n", " "]), source, 1, "x", 2, 3))
    return out + [(5, out[5][1], out[5][2], 1, "x", 2, 3)] * 2 + [(None, "a b c", "b", 1, "x", 2, 3), (7, None, None, 0, "", 0, 0)]


def test_plan(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = mixing.plan_mix(df).collect()
    assert len(got) == len(data)
    per = defaultdict(int)
    for _, t, s, *_ in data:
        per[s] += len((t or "").split())
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, level([per[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        assert r.source_size == per[r.source] and math.isclose(r.target, want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in names:
        assert abs(taken[s] - want[s]) <= 120, s
    again = mixing.plan_mix(df.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_repeats_rows(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    plan = Counter()
    for r in mixing.plan_mix(df).collect():
        plan[r.doc_id, r.source, r.size] += r.copies
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    assert got == +plan


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.plan_mix(none).collect() == [] and mixing.mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, None, 1, "", 1, 1), (2, "", "a", 1, "", 1, 1)], SCHEMA)
    assert {(r.size, r.target, r.copies) for r in mixing.plan_mix(blank).collect()} == {(0, 0.0, 0)}


def test_query(spark, duck):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(q.ORACLES["op7_mixing"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in q.QUERIES["op7_mixing"](spark, SF).select(names).collect()) == want
    target, taken = defaultdict(float), Counter()
    for r in want:
        row = dict(zip(names, r, strict=True))
        target[row["source_size"]] = row["target"]
        taken[row["source_size"]] += row["taken"]
    assert max(abs(taken[s] - t) / t for s, t in target.items()) < 0.1
