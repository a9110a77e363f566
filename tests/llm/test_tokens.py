"""Token counts and packing against the libraries themselves."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from faultline.llm import packing, token_counts

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, id string, ids int, start int"
ODD = [
    None, "", " ", "\n", "a", "A", "don't THEY'RE we'll", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "</s> <s> <unk>",
    "é É ́x Å ﬁ Σας ΣΑΣ İI", "a b c\x1cd\x0be\x85f", "1234 12.5 x²y½ ª º µ", "日本語 テキスト 🙂🙂", "▁a ▁ b",
    "a  b   c ▁ d", "﻿x ​y", "''s 's'", "...,,;;", "<| |>", "|a|b <a>",
]


def rows(seed=3):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta,", "gamma.", "don't", "été", "x" * 50, "2024", "naïve!"] + [f"w{i}" for i in range(300)]
    long = [" ".join(rng.choices(vocab, k=n)) for n in (30, 700, 5000, 40_000)]
    texts = ODD + long + [" ".join(rng.choices(vocab, k=rng.randint(1, 400))) for _ in range(40)]
    texts.append("y" * 150_000 + " a" * 40_000)
    return [(i, t, "c", 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], "c", 1, 2), (None, "a b", "c", 1, 2)]


def test_counts(spark):
    data = rows()
    got = token_counts.token_counts(spark.createDataFrame(data, SCHEMA), MODEL, token_limit=500).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(d, len((t or "").encode()), len(sp.encode(t or ""))) for d, t, *_ in data]
    key = repr
    assert sorted(((*r[:3], r[3]) for r in got), key=key) == sorted(((*w, w[2] > 500) for w in want), key=key)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), MODEL).collect() == []
    tk = Tokenizer.from_file(WORDS)
    got = token_counts.token_counts(spark.createDataFrame(data[:25], SCHEMA), WORDS).collect()
    assert {r[0]: r[2] for r in got} == {d: len(tk.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in data[:25]}


def test_safe_cuts_join():
    text = "word " * 50_000
    parts = token_counts.safe_cuts(text)
    assert len(parts) > 2 and " ".join(parts) == text
    assert token_counts.safe_cuts("z" * 200_000) == ["z" * 200_000]


@pytest.mark.parametrize("parts", [1, 3])
def test_packing(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    got = packing.pack(df, WORDS).collect()
    tk = Tokenizer.from_file(WORDS)
    want = defaultdict(list)
    for d, t, *_ in data:
        want[d].append(b"".join(i.to_bytes(4, "little") for i in [*tk.encode(t or "", add_special_tokens=False).ids, 1]))
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    assert set(docs) == set(want)
    for d, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        if len(want[d]) == 1:
            assert b"".join(r.ids for r in pieces) == want[d][0], d
        assert sum(r.length for r in pieces) * 4 == sum(map(len, want[d]))
        assert {4 * r.doc_tokens for r in pieces} == {len(w) for w in want[d]}
    padding = 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        total = 0
        for r in s:
            assert r.offset == total
            total += r.length
        assert total <= 2048
        if total & (total - 1):
            padding += 2048 - total
    assert padding <= 0.01 * sum(r.length for r in got)
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORDS).collect() == []
    assert zlib.crc32(b"") == 0


def test_cut():
    for n in range(1, 7000):
        pieces = list(packing.cut(n, 2048, 1 / 128))
        assert sum(p for p, _ in pieces) == n and len(pieces) < 10
        assert all(2048 * (1 - 1 / 50) <= p * k <= 2048 for p, k in pieces)
