"""Line removal against exact counting in plain Python and in SQL."""

import hashlib
import random
from collections import defaultdict

from faultline.llm import line_dedup
from faultline.llm import queries as q

SCHEMA = "doc_id long, text string, source string, h1 int, line string, cut string, row int"


def brute(rows, least):
    sites, first = defaultdict(set), {}
    late = (1 << 63) - 1
    for i, t, s, *_ in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if line.strip(" "):
                sites[line].add(s)
                first[line] = min(first.get(line, late), late if i is None else i)
    out = []
    for i, t, s, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if len(sites[x]) < least or first[x] == (late if i is None else i)]
        out.append((i, None if t is None else "\n".join(kept), s, len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_against_loop(spark):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(60)] + ["", " ", "  ", "\r", "a\tb", "é", "x" * 50_000]
    data = []
    for i in range(500):
        lines = [pool[min(int(rng.expovariate(0.08)), len(pool) - 1)] for _ in range(rng.randint(0, 9))]
        source = rng.choice([None, "", *(f"s{min(int(rng.expovariate(0.2)), 30)}" for _ in range(6))])
        data.append((i, "\n".join(lines + [f"own {i}"] * rng.randint(0, 2)), source, 1, "l", "c", 2))
    data += [data[3], (None, data[4][1], "s1", 1, "l", "c", 2), (None, "only\nnull ids", None, 1, "l", "c", 2), (600, None, "s", 1, "", "", 1), (601, "", "s", 1, "", "", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    for least in (2, 10, 20):
        got = line_dedup.dedup_lines(df, least)
        assert got.columns == [*df.columns, "n_lines", "n_removed"]
        assert sorted(((r.doc_id, r.text, r.source, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == brute(data, least)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def test_names_that_clash(spark):
    rows = [(i, "common\nown", f"s{i}", "mine", 7) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string, N_Removed int")
    got = line_dedup.dedup_lines(df, 5)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert {(r.n_lines, r.n_removed) for r in got.collect() if r.doc_id} == {(2, 2)}
    kept = line_dedup.dedup_lines(df, 5, counts=False)
    assert kept.columns == df.columns and {(r.n_lines, r.N_Removed) for r in kept.collect()} == {("mine", 7)}


def test_sketches_near_the_threshold(spark):
    """Lines on 990 to 1010 sites: a sketch alone could not tell which are over 1000."""
    rows = [(n * 10_000 + s, f"spread {n}", f"site {s}") for n in range(990, 1011, 4) for s in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.dedup_lines(df, 1000).filter("n_removed > 0").groupBy(line_dedup.F.expr("doc_id div 10000").alias("n")).count().collect()
    assert {r.n: r["count"] for r in got} == {n: n - 1 for n in range(990, 1011, 4) if n >= 1000}


def test_query(spark, duck):
    cur = duck.execute(q.ORACLES["op6_line_dedup"])
    names = [d[0] for d in cur.description]
    got = q.QUERIES["op6_line_dedup"](spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
    assert any(r.n_removed for r in got) and hashlib.sha256(b"").hexdigest()
