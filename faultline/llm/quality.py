"""Quality scores by a generalised additive model with pairwise interactions.

Texts are described by a few bounded statistics. Each is cut into bins, and boosting goes through
the features in turn, again and again, fitting a tree of two levels on the bins of that feature
alone; the sum of a feature's trees is one number per bin. Then the pairs of features that explain
most of what is left get tables of their own in the same way. A score is a sum of looked-up
numbers. The fit sees a bounded number of labelled rows; scoring is one pass without a shuffle.
"""

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.batches import by_bytes, texts

SAMPLE = 20_000
#: Score from which on a document counts as good.
GOOD = 0.3
BINS = 48
PAIR_BINS = 12
PAIRS = 6
CYCLES = 120
PAIR_CYCLES = 40
RATE = 0.15
LEAF = 20
SLICE_BYTES = 1 << 20
FEATURES = (
    "bytes", "words", "word_bytes", "upper", "digits", "stops", "symbols", "shouts", "bars", "high_bytes", "blanks", "line_ends",
    "distinct_words", "top_word", "short_words", "distinct_lines", "line_words", "closed_lines", "entropy", "symbol_ends",
)

_CLASS = np.zeros((10, 256))
for _row, _chars in enumerate((range(65, 91), range(48, 58), b".,", b"#$%&*<>@~^_=+/\\", b"!", b"|", range(128, 256), b" \t\v\f\r", b"\n")):
    _CLASS[_row, list(_chars)] = 1


def describe(text: bytes) -> np.ndarray:
    """The features of one whole text, in the order of ``FEATURES``; all finite, zeros if empty."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / len(text)
    upper, digits, stops, symbols, shouts, bars, high, blanks, ends = (_CLASS[:9] @ share).tolist()
    used = share[share > 0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(words)
    closed = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    n = len(words)
    out[:] = (
        np.log1p(len(text)), np.log1p(n), (len(text) - counts[_BLANK].sum()) / n, upper, digits, stops, symbols, shouts, bars, high, blanks, ends,
        len(distinct) / n, Counter(words).most_common(1)[0][1] / n, sum(len(w) <= 3 for w in words) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        closed / len(lines), -(used * np.log2(used)).sum(), sum(w[-1:] in b"#$%&*!|" for w in words) / n,
    )
    return out


_BLANK = [9, 10, 11, 12, 13, 32]


@dataclass
class Model:
    """Bin edges and tables; ``score`` adds up what they hold."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), table in self.pairs.items():
            total += table[tuple(np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (f, g))]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in order; 0 if none leaves ``LEAF`` rows on both sides."""
    if len(g) < 2:
        return 0.0, 0
    left = np.cumsum(np.stack([g, h, n]), axis=1)[:, :-1]
    right = np.stack([g, h, n]).sum(1, keepdims=True) - left
    gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(left[2] < LEAF) | (right[2] < LEAF)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A step per bin: leaves of a tree that cuts the bins ``depth`` times in a row."""
    gain, at = best_split(g, h, n) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([tree(g[:at], h[:at], n[:at], depth - 1), tree(g[at:], h[at:], n[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of one axis and then of the other in each part; gain over no cut, and the step per cell."""
    best, step = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b, c = (x if axis == 0 else x.T for x in (g, h, n))
        for at in range(1, len(a)):
            parts, gain = [], -(a.sum() ** 2) / (b.sum() + 1)
            for side in (slice(0, at), slice(at, None)):
                line = [x[side].sum(0) for x in (a, b, c)]
                more, _ = best_split(*line)
                gain += more + line[0].sum() ** 2 / (line[1].sum() + 1)
                parts.append(np.repeat(tree(*line, depth=1)[None], len(a[side]), 0))
            if gain > best:
                best, step = gain, np.concatenate(parts) if axis == 0 else np.concatenate(parts).T
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosting on features in turn, then on the pairs that explain most of the rest."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Model(base, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    edges = [cuts(x[:, f], BINS) for f in range(x.shape[1])]
    coarse = [cuts(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size), np.bincount(at, minlength=size)

    for _ in range(CYCLES):
        for f, table in enumerate(tables):
            step = RATE * tree(*sums(binned[f], len(table)))
            table += step
            total += step[binned[f]]
    shapes = {p: (len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1) for p in itertools.combinations(range(x.shape[1]), 2)}
    cell = {p: rough[p[0]] * shapes[p][1] + rough[p[1]] for p in shapes}
    gains = {p: pair_tree(*(s.reshape(shapes[p]) for s in sums(cell[p], np.prod(shapes[p]))))[0] for p in shapes}
    pairs = {p: np.zeros(shapes[p]) for p in sorted(gains, key=gains.get, reverse=True)[:PAIRS]}
    for _ in range(PAIR_CYCLES):
        for p, table in pairs.items():
            _, step = pair_tree(*(s.reshape(shapes[p]) for s in sums(cell[p], table.size)))
            table += RATE * step
            total += RATE * step.ravel()[cell[p]]
    return Model(base, edges, tables, pairs, coarse)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality") -> Model:
    """A model from at most ``sample`` labelled rows, those with the least hash of ``doc_id``.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Null ids and null labels teach nothing.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & ~held_out()).select("doc_id", F.col(label_col).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    seen = known.mapInArrow(_features, "label double, x array<double>").limit(sample).toPandas()
    x = np.array(seen["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, seen["label"]))  # the same model whatever order the rows come in
    return fit(x[order], seen["label"].to_numpy()[order])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "text", SLICE_BYTES):
        rows = pa.array([describe(t).tolist() for t in texts(part)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("_label")), rows], ["label", "x"])


def score(docs: DataFrame, model: Model, keep_row: bool = False) -> DataFrame:
    """doc_id and ``score`` for every row of ``docs`` (with ``keep_row`` the row itself, as ``row``).

    Nulls are empty texts; empty texts get a score like others. Repeated rows, null ids and further
    columns change nothing. An empty table gives an empty result.
    """
    text = F.col("text").cast("string").alias("text")
    names = [f.name for f in docs.schema]
    # a text that is in its row goes to Python once
    at = names.index("text") if keep_row and [n.lower() for n in names].count("text") == 1 and "text" in names else None
    if at is not None and isinstance(docs.schema[at].dataType, T.StringType):
        wanted = docs.select(F.struct("*").alias("row"))
    else:
        at, wanted = None, docs.select(F.struct("*").alias("row") if keep_row else F.col("doc_id").alias("row"), text)

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            yield batch if at is None else pa.RecordBatch.from_arrays([rows, rows.field(at)], ["row", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(with_text(batches), "text", SLICE_BYTES):
            scores = model.score(np.stack([describe(t) for t in texts(part)]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["row", "score"])

    fields = T.StructType([wanted.schema["row"], T.StructField("score", T.DoubleType())])
    out = wanted.mapInArrow(run, fields)
    return out if keep_row else out.withColumnRenamed("row", "doc_id")
