"""Periodic runs against trying every period, in words and in the registered query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from faultline.llm import periodic_runs as pr
from faultline.llm import queries as q
from faultline.llm.suffix_trees import RangeMinimum, SuffixTree


def brute(words, least, periods):
    """Every stretch in which words a period apart agree, unless a smaller period already explains it."""
    n, out = len(words), []
    for p in range(1, n // periods + 1):
        start = None
        for i in range(n - p + 1):
            if i < n - p and words[i] == words[i + p]:
                start = i if start is None else start
            elif start is not None:
                length = i + p - start
                stretch = words[start : start + length]
                if length >= max(least, periods * p) and not any(stretch[d:] == stretch[:-d] for d in range(1, p)):
                    out.append((start, length, p))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_stretches_of_few_words():
    rng = random.Random(3)
    for _ in range(1500):
        words = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 6]))]) for _ in range(rng.randint(0, 50))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            words = [w if i < a or a + (i - a) % p >= len(words) else words[a + (i - a) % p] for i, w in enumerate(words)]
        for least, periods in ((1, 2), (6, 3), (24, 3)):
            assert [tuple(r) for r in pr.runs_of(words, least, periods).tolist()] == brute(words, least, periods)


def test_common_extensions():
    rng = random.Random(4)
    symbols = [rng.randint(1, 3) for _ in range(400)] + [1] * 200
    tree = SuffixTree(symbols, ordered=True)
    assert tree.leaves == sorted(range(601), key=lambda i: symbols[i:])
    a, b = np.array([(x, y) for x in range(0, 600, 7) for y in range(0, 600, 11) if x != y]).T
    want = [next((k for k in range(600) if x + k >= 600 or y + k >= 600 or symbols[x + k] != symbols[y + k]), 600) for x, y in zip(a, b, strict=True)]
    assert tree.common(a, b).tolist() == want


def test_range_minimum():
    values = np.random.default_rng(0).integers(0, 1000, 777)
    ends = np.random.default_rng(1).integers(0, 777, (5000, 2))
    least = RangeMinimum(values)(*ends.T)
    assert least.tolist() == [values[min(e) : max(e) + 1].min() for e in ends.tolist()]


def test_odd_rows(spark):
    loop = " ".join(["one", "two", "three"] * 9)
    rows = [(1, f"start {loop}\tend"), (1, f"start {loop}\tend"), (None, loop), (2, None), (3, ""), (4, " \n "), (5, "again " * 60_000), (6, "a b c")]
    df = spark.createDataFrame([(i, t, 1, "s", "x") for i, t in rows], "doc_id long, text string, runs int, collapsed string, start string")
    got = {(r.doc_id, i): r for i, r in enumerate(pr.find_runs(df).collect())}
    assert len(got) == len(rows)
    by = {i: r for (i, _), r in got.items()}
    assert [tuple(r) for r in by[1].runs] == [(1, 27, 3)] and by[1].collapsed == "start one two three end"
    assert [tuple(r) for r in by[5].runs] == [(0, 60_000, 1)] and by[5].collapsed == "again"
    assert [tuple(r) for r in by[None].runs] == [(0, 27, 3)]
    assert [(by[i].runs, by[i].collapsed) for i in (2, 3, 4, 6)] == [([], ""), ([], ""), ([], ""), ([], "a b c")]
    assert pr.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pr.find_runs(df, periods=1)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 24, 3)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = (None,) * 4
    for s, length, p in runs:
        if best[0] is None or length * best[2] > best[1] * p:
            best = (s, length, p, 1000 * length // p)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, duck):
    got = sorted(map(tuple, q.QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()))
    rows = duck.execute("SELECT doc_id, text FROM documents WHERE length(text) < 8000").fetchall()
    want = sorted(expected(*r) for r in rows)
    short = {r[0] for r in rows}
    assert [r for r in got if r[0] in short] == want and len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert sum(r[1] > 0 for r in want) > 10
