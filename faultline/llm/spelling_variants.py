"""Spelling variants of a vocabulary, found over a reduced alphabet.

Letters are hashed to a few symbols. Every word offers the one-edit neighbourhood of its reduced
form as join keys: itself, each symbol replaced by a larger one and each symbol left out; a smaller
symbol or one more is the same edit seen from the other word, so each relation is generated at one
end. Keys meet the reduced vocabulary in an equality join, and only pairs whose own letters differ
by one edit are kept. A key stands for its symbols by a polynomial over 64 bits, so that all keys of
a word come from prefix sums; what meets by chance does not pass the check of the letters.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.staging import stage
from faultline.llm.batches import by_bytes, texts

SYMBOLS = 7
LEAST_CHARS = 7
LEAST_COUNT = 2
TIMES = 10
SLICE_BYTES = 4 << 20
#: Words that a task holds before it passes their counts on.
HELD = 200_000
BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(BASE, -1, 1 << 64)


def vocabulary(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damage: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``word``, ``n``: maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF with their number.

    Only A-Z are lower-cased. Words of fewer than ``least_chars`` code points or ``least_count``
    occurrences are left out. With ``damage``, a run loses a letter wherever that number divides
    the CRC-32 of id and run, which plants misspellings to be found. Null texts hold no words, a
    null id counts as an empty one, repeated rows count like others.
    """
    wanted = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")  # no shorter run can become a word
        counts: Counter[str] = Counter()
        for part in by_bytes(batches, "text", SLICE_BYTES):
            for i, text in zip(part.column(0).to_pylist(), texts(part), strict=True):
                found = Counter(runs.findall(text.lower().decode()))  # bytes lower-case ASCII only
                if damage is not None:
                    begun = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for word, n in list(found.items()):
                        if not (h := zlib.crc32(word.encode(), begun)) % damage:
                            del found[word]
                            at = h % len(word)
                            if len(word) > least_chars:
                                counts[word[:at] + word[at + 1 :]] += n
                counts.update(found)
            if len(counts) >= HELD:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    counted = wanted.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def keys(words: list[str], symbols: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of words, keys, whether a key is the word's own; only own keys unless ``whole``."""
    lengths = np.array([len(w) for w in words])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        digits = np.array([words[i] for i in at], f"U{max(size, 1)}").view(np.uint32).reshape(len(at), -1)[:, :size] % symbols
        power = np.array([pow(BASE, i, 1 << 64) for i in range(size)], np.uint64)
        terms = (digits.astype(np.uint64) + 1) * power
        total = terms.sum(axis=1, dtype=np.uint64)
        yield at, total, np.ones(len(at), bool)
        if not whole or not size:
            continue
        for larger in range(1, symbols):
            row, col = np.nonzero(digits < larger)
            key = total[row] + (np.uint64(larger) - digits[row, col]) * power[col]
            yield at[row], key, np.zeros(len(row), bool)
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        without = upto - terms + (total[:, None] - upto) * np.uint64(_UNBASE)
        last = np.ones(digits.shape, bool)  # equal symbols in a row leave the same word
        last[:, :-1] = digits[:, :-1] != digits[:, 1:]
        row, col = np.nonzero(last)
        yield at[row], without[row, col], np.zeros(len(row), bool)


def _keyed(vocab: DataFrame, symbols: int, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, own in keys(batch.column(0).to_pylist(), symbols, whole):
                picked = [batch.column(i).take(pa.array(row)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), *picked], ["key", "own", "word", "n"])

    return vocab.select("word", "n").mapInArrow(run, "key long, own boolean, word string, n long")


def near_pairs(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, n_a, b, n_b: each pair of different words of ``vocab`` (word, n) one edit apart, once."""
    index = _keyed(vocab, symbols, whole=False).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    probe = _keyed(vocab, symbols, whole=True).select("key", "own", F.col("word").alias("a"), F.col("n").alias("n_a"))
    met = probe.join(index, "key").filter((~F.col("own") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b")


def variants(vocab: DataFrame, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of ``vocab`` (word, n; words distinct).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The
    form of a word is its most frequent near word (ties: the first in code-point order) if that is
    ``times`` as frequent or more (``times`` above 1), else null; the root is where forms lead in
    the end, the word itself without a form. Words may be of any length; other columns are ignored;
    an empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("forms must be more frequent than their variants")
    vocab = stage(vocab.select("word", "n"), "vocabulary")
    both = F.expr("stack(2, a, n_a, b, n_b, b, n_b, a, n_a)").alias("word", "n", "near", "near_n")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_pairs(vocab, symbols).select(both).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), first)
    leads = F.when(-F.col("best.less") >= F.lit(times) * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    near = stage(near.select("word", "n_near", leads.alias("lead")), "near_words")
    forms = near.filter("lead IS NOT NULL").select("word", F.col("lead.form").alias("form"))
    out = vocab.join(near, "word", "left").join(roots(forms), "word", "left")
    return out.select(
        "word", F.col("lead.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("lead.form_n").alias("form_n"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where following ``forms`` (word, form; without cycles) ends, by doubling the steps."""
    at = stage(forms.select("word", F.col("form").alias("root")), "variant_roots")
    while True:
        onward = at.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        moved = at.join(onward, F.col("root") == F.col("_at"), "left")
        moved = stage(moved.select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("open")), "variant_roots")
        if moved.filter("open").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")
