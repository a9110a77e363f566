"""Stretches of a document that repeat with a short period, found through suffix trees.

By the runs theorem every maximal repetition holds, for the order of words or for its reverse, a
longest Lyndon word as long as its period that begins inside it. So every position gives two
candidates, the distances to the next smaller and the next greater suffix, and a candidate is
extended in both directions by the longest common extensions of the document and of its reversal,
each a lowest-common-ancestor question to a suffix tree.

A run of three periods and more holds each of its words three times. Words that are rarer in the
document lie in no such run, so they part it into stretches, each with trees of its own; a word
that occurs once or twice is a symbol with which no suffix of another stretch goes on.
"""

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.batches import by_bytes, texts
from faultline.llm.suffix_trees import SuffixTree

LEAST_WORDS = 24
LEAST_PERIODS = 3
SLICE_BYTES = 4 << 20

RUN = "array<struct<start: long, length: long, period: long>>"


def repetitions(symbols: list[int], periods: int) -> np.ndarray:
    """start, length, period of every maximal repetition of at least ``periods`` (2 or more) periods, sorted."""
    n = len(symbols)
    tree, back = SuffixTree(symbols, ordered=True), SuffixTree(symbols[::-1], ordered=False)
    rank = [0] * (n + 1)
    for r, leaf in enumerate(tree.leaves):
        rank[leaf] = r
    at, period = _lyndon(rank, n)
    near = period * periods <= n
    at, period = at[near], period[near]
    right = tree.common(at, at + period)
    left = np.zeros(len(at), np.int64)
    inner = at > 0
    left[inner] = back.common(n - at[inner], n - at[inner] - period[inner])
    length = left + period + right
    long = length >= periods * period
    return np.unique(np.stack([(at - left)[long], length[long], period[long]], axis=1), axis=0)


def _lyndon(rank: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with the length of the longest Lyndon word that begins there, for both orders."""
    smaller, greater = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while falling and rank[falling[-1]] > r:
            falling.pop()
        if falling:
            smaller[i] = falling[-1]
        falling.append(i)
        while rising and rank[rising[-1]] < r:
            rising.pop()
        if rising:
            greater[i] = rising[-1]
        rising.append(i)
    at = np.tile(np.arange(n), 2)
    following = np.array(smaller + greater)
    inside = following < n
    return at[inside], (following - at)[inside]


def runs_of(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """start, length, period of the runs of a document, by start, then period."""
    found = [np.zeros((0, 3), np.int64)]
    counts = Counter(words)
    often = np.fromiter(map(counts.__getitem__, words), np.int64, len(words)) >= periods
    edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if stop - start >= least:
            numbers: dict[bytes, int] = {}
            symbols = [numbers.setdefault(w, len(numbers) + 1) for w in words[start:stop]]
            own = repetitions(symbols, periods)
            own = own[own[:, 1] >= least]
            own[:, 0] += start
            found.append(own)
    return np.concatenate(found)  # stretches follow one another, so the order holds


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run contains behind its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return list(itertools.compress(words, (np.cumsum(change)[:-1] == 0).tolist()))


def find_runs(
    docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``runs`` and ``collapsed`` for every row of ``docs``.

    Words are parted by ASCII white space. A run is a stretch of at least ``least`` words and
    ``periods`` (2 or more) times its smallest period that no neighbouring word extends; ``runs``
    lists start (word number), length and period by start, then period. ``collapsed`` is the text
    without the words that a run contains behind its first period, words joined by one blank. Null
    and empty texts have no runs and collapse to an empty text; texts of any length are worked on
    whole, in memory that grows with the text; repeated rows and null ids stay rows of their own;
    other columns are ignored whatever their names; an empty table gives an empty result.
    """
    if periods < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE_BYTES):
            kept, rows, offsets = [], [np.zeros((0, 3), np.int64)], [0]
            for text in texts(part):
                words = text.split()
                runs = runs_of(words, least, periods)
                kept.append(b" ".join(collapsed(words, runs)))
                rows.append(runs)
                offsets.append(offsets[-1] + len(runs))
            fields = pa.StructArray.from_arrays([pa.array(c) for c in np.concatenate(rows).T], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    kind = wanted.schema["id"].dataType.simpleString()
    return wanted.mapInArrow(search, f"id {kind}, runs {RUN}, collapsed string").withColumnRenamed("id", id_col)
