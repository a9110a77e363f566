"""SimHash groups against all pairs, dense groups and chains included."""

import random

import numpy as np
import pytest
import xxhash

from faultline.llm import components, simhash

SCHEMA = "doc_id long, text string, bits long, root int, component_id int"


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(values, linked):
    label = list(range(len(values)))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(values))]


def test_documents(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)] + ["É", "\x1cq", "A", "a"]
    data = [None, "", "  ", "one", "one two", "One\ttwo", "ONE TWO THREE four"]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(3, 400))
        data.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            edit = list(base)
            edit[rng.randrange(len(edit))] = rng.choice(words)
            data.append(" ".join(edit))
    data.append("long " * 60_000)
    ids = list(range(len(data)))
    rng.shuffle(ids)
    rows = [(i, t, 1, 2, 3) for i, t in zip(ids, data, strict=True)]
    rows += [rows[9], (None, rows[9][1], 1, 2, 3), (None, "nobody like this one here", 1, 2, 3)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain_print(t) for _, t, *_ in rows]
    top = reach(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = []
    for (i, *_), p, t in zip(rows, prints, top, strict=True):
        want.append((i, f"{p:016x}", min((r[0] for r, u in zip(rows, top, strict=True) if u == t and r[0] is not None), default=None)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted({c for *_, c in want if c is not None} | {None}, key=repr) + [None]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("group", [3, 20, 2048])
def test_dense_fingerprints(spark, group):
    """Crowded keys at every level lose no link."""
    rng = random.Random(group)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(90):
            values.add(base ^ sum({1 << rng.choice([0, 1, 2, 5, 9, 17, 30, 31, 32, 33, 40, 50, 63]) for _ in range(rng.randint(0, 5))}))
    values |= {rng.getrandbits(64) for _ in range(60)} | {0, 1, 3, (1 << 64) - 1}
    values = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "bits long")
    roots = {r.node: r.root for r in components.components(simhash.links(df, 3, group)).collect()}
    top = reach(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    least = {}
    for v, t in zip(values, top, strict=True):
        least[t] = min(v, least.get(t, v))
    assert {v: roots.get(v, v) for v in values} == {v: least[t] for v, t in zip(values, top, strict=True)}


def test_chain_and_star(spark):
    edges = [(i + 1, i) for i in range(3000)] + [(5000 + i, 5000) for i in range(1, 2000)] + [(9, 9)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {i: 0 for i in range(3001)} | {5000 + i: 5000 for i in range(2000)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
