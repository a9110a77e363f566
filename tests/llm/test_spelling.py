"""Spelling variants against comparing every pair of words, and the SQL answer."""

import random
import re
import zlib
from collections import Counter

import pytest

from faultline.llm import queries as q
from faultline.llm import spelling_variants as sv

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(rows, damage):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def collected(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "k", True) for i, t in rows], "doc_id long, text string, word string, n long, key string, own boolean")


@pytest.mark.parametrize("damage", [None, 3])
def test_from_text(spark, damage):
    rng = random.Random(5)
    words = ["".join(rng.choice("abéÀEf") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["naïveté×", "STRASSEß", "aaaaaaaa"]
    rows = [(i, " ".join(rng.choices(words, k=40)) + ", x-" + "Aaaaaaaaaa" * (i % 5)) for i in range(120)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (900, None), (901, ""), (902, "aaaaaaaab " * 4000)]
    vocab = sv.vocabulary(frame(spark, rows), damage=damage)
    counts = count(rows, damage)
    assert {r.word: r.n for r in vocab.collect()} == counts
    assert collected(sv.variants(vocab)) == brute(counts)


@pytest.mark.parametrize("symbols", [2, 7])
def test_many_near_words(spark, symbols):
    """Words over few letters are near to many, and nearly all share their reduced words."""
    rng = random.Random(symbols)
    counts = {"".join(rng.choice("aà") for _ in range(rng.randint(1, 8))): 10 ** rng.randint(0, 6) for _ in range(250)}
    counts |= {"x" * 300: 5, "x" * 301: 50, "x" * 302: 500, "x" * 303: 5000}
    vocab = spark.createDataFrame([(w, n, "other") for w, n in counts.items()], "word string, n long, root string")
    got = collected(sv.variants(vocab, symbols=symbols))
    assert got == brute(counts) and max(r[4] for r in got) > 5
    assert next(r for r in got if r[0] == "x" * 300)[2] == "x" * 303


def test_none(spark):
    empty = sv.variants(sv.vocabulary(frame(spark, [])))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.collect() == []
    assert collected(sv.variants(sv.vocabulary(frame(spark, [(1, "lonelyword lonelyword")])))) == [("lonelyword", None, "lonelyword", 2, 0, None)]
    with pytest.raises(ValueError):
        sv.variants(empty, times=1)


def test_query(spark, duck):
    cur = duck.execute(q.ORACLES["op11_spelling_variants"])
    assert [d[0] for d in cur.description] == ["word", "form", "root", "n", "n_near", "form_n"]
    got = collected(q.QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001"))
    assert got == sorted(cur.fetchall(), key=lambda r: r[0]) and any(r[1] for r in got)
