"""Shards against a plain minimax partition and the SQL answer."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from faultline.llm import queries as q
from faultline.llm import sharding

SCHEMA = "doc_id long, text string, size string, mark int, shard string, slot int, tie long"


def least_capacity(sizes, shards):
    """Smallest possible largest sum of ``shards`` stretches, by dynamic programming over all cuts."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = sums[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))]
    return best[-1]


def brute(rows, shards):
    """(id, size, crc, shard, slot) of every row."""
    key = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode()) + 1
    groups = defaultdict(int)
    for _, t in rows:
        groups[key(t)] += size(t)
    order = sorted(groups)
    capacity = least_capacity([groups[k] for k in order], shards)
    of, at, used = {}, 0, 0
    for k in order:
        if used + groups[k] > capacity:
            at, used = at + 1, 0
        of[k], used = at, used + groups[k]
    out, slots = [], defaultdict(int)
    for i, t in sorted(rows, key=lambda r: (key(r[1]), r[0] is not None, r[0] or 0)):
        s = of[key(t)]
        out.append((i, size(t), zlib.crc32((t or "").encode()), s, slots[s]))
        slots[s] += 1
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "x", 2, 3) for i, t in rows], SCHEMA)


def collected(df):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 4])
def test_against_every_cut(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.choice(["é", "word ", "x"]) * rng.randint(0, 40)) for i in range(120)]
    rows += [(200 + i, "a copy in a third of the rows") for i in range(60)]
    rows += [(400, None), (401, ""), (402, "long " * 3000), (None, "no id"), (None, "no id"), rows[5], rows[5]]
    got = collected(sharding.shard(frame(spark, rows), shards))
    assert got == brute(rows, shards)


def test_few_groups_and_none(spark):
    rows = [(i, "one text") for i in range(9)]
    got = collected(sharding.shard(frame(spark, rows), 2))
    assert {r[3] for r in got} == {0} and sorted(r[4] for r in got) == list(range(9))
    two = [(1, "a"), (2, "ccc")]
    assert collected(sharding.shard(frame(spark, two), 3)) == brute(two, 3)
    empty = sharding.shard(frame(spark, []))
    assert empty.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and empty.collect() == []
    with pytest.raises(ValueError):
        sharding.shard(empty, 0)


@pytest.mark.parametrize("tried", [3, 40])
def test_search_width_does_not_matter(spark, tried):
    rng = random.Random(tried)
    sizes = [rng.choice([1, 2, 3, 50, 200]) for _ in range(90)]
    total = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    sums = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(total)], "mark string, total long")
    capacity, cuts = sharding.minimax_cuts(sums, 3, total[-1], max(sizes), tried)
    assert capacity == least_capacity(sizes, 3)
    assert max(b - a for a, b in zip([0, *cuts], [*cuts, total[-1]], strict=True)) <= capacity


def test_query(spark, duck):
    cur = duck.execute(q.ORACLES["op13_sharding"])
    names = [d[0] for d in cur.description]
    df = q.QUERIES["op13_sharding"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, df.select(names).collect())) == sorted(cur.fetchall())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
