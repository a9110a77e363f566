"""Repeated passages against a plain loop over all windows."""

import hashlib
import random
import re

import pytest

from faultline.llm import queries as q
from faultline.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, slab int, id string, doc string, kept int, bucket int"


def brute(rows, n):
    """rows in order of id; returns id -> (words, removed, kept, spans)."""
    seen, out = set(), []
    for i, t in rows:
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w]
        gone = [False] * len(words)
        for s in range(len(words) - n + 1):
            key = tuple(words[s : s + n])
            if key in seen:
                gone[s : s + n] = [True] * n
            seen.add(key)
        spans, k = [], 0
        while k < len(words):
            e = k
            while e < len(words) and gone[e]:
                e += 1
            if e > k:
                spans.append((k, e))
            k = max(e, k + 1)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g), spans))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)] + ["é", "x\x1cy", "x y", "🙂"]
    pool = [rng.choices(vocab, k=rng.randint(n - 2, 4 * n)) for _ in range(12)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(pool)
            a = rng.randint(0, max(len(part) // 3, 0))
            words += part[a:] if rng.random() < 0.6 else rng.choices(vocab, k=rng.randint(1, 40))
        texts.append(rng.choice([" ", "\n", " \t", "\x0b"]).join(words))
    texts += [texts[0]] * 5 + ["a " * 200, "a b " * 100, None, "", "  \n", "b " * (n - 1), " ".join(vocab * 3)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "window", "slab", "per_bucket"), [(1, 20, 4 << 20, 12 << 20), (2, 20, 3000, 20_000), (3, 5, 2000, 5000), (4, 2, 500, 50_000)])
def test_against_loop(spark, monkeypatch, seed, window, slab, per_bucket):
    monkeypatch.setattr(sd, "HASH_BYTES", per_bucket)
    rows = corpus(seed, window)
    mixed = random.Random(seed).sample(rows, len(rows))
    df = spark.createDataFrame([(i, t, 1, "i", "d", 2, 3) for i, t in mixed], SCHEMA).repartition(5)
    got = sd.dedup_passages(df, window, slab).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept, [tuple(s) for s in r.spans]) for r in got) == brute(rows, window)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(3, text), (3, text), (None, text), (None, text), (9, None)]
    df = spark.createDataFrame([(i, t, 1, "", "", 2, 3) for i, t in rows], SCHEMA)
    got = sd.dedup_passages(df).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("3", 0), ("3", 50), ("9", 0), ("None", 50), ("None", 50)]
    assert sd.dedup_passages(df.limit(0)).collect() == []
    assert [r.n_removed for r in sd.dedup_passages(df.filter("doc_id = 9")).collect()] == [0]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in q.QUERIES["op3_substring_dedup"](spark, sf).collect())
    assert got == [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t, _ in brute(docs, 20)]
