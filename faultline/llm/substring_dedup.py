"""Removal of repeated word passages through fixed-block anchors.

A window of n words holds a whole block of b = (n + 1) // 2 words of any cutting of the text into
blocks. So a window that repeats elsewhere meets, at one of its words, a reference block of the
other text. The job has three passes over texts kept in slabs, packs of documents of a few MB:

1. Each slab hashes its reference blocks and every run of b words, and sends the distinct hashes of
   each bucket as one packed row. A bucket tells each slab which of them also occur in another slab
   and are a block in one of the two.
2. Each slab extends these hits to the windows around them, hashes those with 96 bits and sends the
   distinct ones with their documents. A bucket tells which ones occur earlier elsewhere.
3. Each slab joins the windows that repeat something earlier to maximal passages and cuts them.

A hash is sent once per slab, however often a passage occurs in it, and answers are bits, so no
pairs of occurrences arise and a passage in every document is as cheap as any other. Slabs are
stored in buckets by their number, so the text itself is never shuffled.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.staging import stage, stage_bucketed
from faultline.llm.batches import by_bytes, texts

WINDOW = 20
SLAB_BYTES = 4 << 20
#: Text whose hashes one bucket gathers, and text of the slabs that one stored bucket holds.
HASH_BYTES = 12 << 20
STORE_BYTES = 32 << 20
LAST = (1 << 63) - 1
_ODD = np.random.default_rng(20).integers(1, 1 << 63, (3, 512), dtype=np.uint64) | np.uint64(1)


def dedup_passages(
    docs: DataFrame, window: int = WINDOW, slab_bytes: int = SLAB_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document without the words of every window that starts earlier, too.

    Returns ``id_col``, ``n_words``, ``n_removed``, ``kept`` (the other words, joined by a blank) and
    ``spans`` (start, end: the maximal runs of removed words). Words are what stands between ASCII
    white space. A window counts if the same words start in a document with a smaller id or further
    ahead in the same document, on the input as it is. Ids are integers; null ids come last, rows
    with equal ids follow each other in a fixed order. Null texts have no words. Other columns are
    ignored. An empty table gives an empty result. ``window`` is from 2 to 512.
    """
    text = F.col(text_col).cast("string")
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), order, F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // HASH_BYTES
    slabs = rows.mapInArrow(cut_slabs(slab_bytes), "slab long, nth long, id long, doc long, text string")
    slabs = stage_bucketed(slabs, "slabs", "slab", min(1 + size // STORE_BYTES, 100_000))

    sent = slabs.groupBy("slab").applyInArrow(offer_runs(window, buckets), "bucket long, slab long, block binary, other binary")
    runs = stage(sent.groupBy("bucket").applyInArrow(shared_runs, "slab long, bucket long, bits binary"), "runs")
    fields = "bucket long, slab long, high binary, low binary, docs binary, counts binary"
    windows = stage(slabs.groupBy("slab").cogroup(runs.groupBy("slab")).applyInArrow(offer_windows(window, buckets), fields), "windows")
    earlier = windows.filter("bucket >= 0").groupBy("bucket").applyInArrow(later_windows, "slab long, bucket long, bits binary")
    masks = windows.filter("bucket < 0").select("slab", "bucket", F.col("high").alias("bits"))
    answers = stage(earlier, "later").unionByName(masks)
    fields = "id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"
    out = slabs.groupBy("slab").cogroup(answers.groupBy("slab")).applyInArrow(cut_passages(window, buckets), fields)
    return out.withColumnRenamed("id", id_col)


def cut_slabs(slab_bytes: int):
    """Documents with the number of their slab, unique over tasks, and their number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, used, nth = TaskContext.get().partitionId() << 32, 0, 0
        for part in by_bytes(batches, "text", slab_bytes // 4):
            n = part.num_rows
            columns = [pa.array(np.full(n, slab)), pa.array(np.arange(nth, nth + n)), *part.columns]
            yield pa.RecordBatch.from_arrays(columns, ["slab", "nth", "id", "doc", "text"])
            used, nth = used + part.nbytes, nth + n
            if used >= slab_bytes:
                slab, used, nth = slab + 1, 0, 0

    return run


class Hashes(dict):
    """Hash of every word asked for, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


KNOWN = Hashes()


class Slab:
    """The words of a slab in order of documents, and hashes of what starts at each word."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc", "ascending"), ("nth", "ascending")])
        self.slab = table.column("slab")[0].as_py()
        self.ids, self.docs = table.column("id"), np.asarray(table.column("doc"))
        self.words = [t.split() for t in texts(table.combine_chunks().to_batches()[0])]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        if len(KNOWN) > 1_000_000:
            KNOWN.clear()
        total = int(self.ends[-1])
        self.hashes = np.fromiter(map(KNOWN.__getitem__, itertools.chain.from_iterable(self.words)), np.uint64, total)
        self.end = np.repeat(self.ends, self.sizes)
        self.at = np.arange(total)

    def rolling(self, n: int, seed: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; without meaning where a document ends earlier."""
        total = max(len(self.at) - n + 1, 0)
        out = np.zeros(len(self.at), np.uint64)
        for k in range(n):
            out[:total] += self.hashes[k : k + total] * _ODD[seed, k]
        return mixed(out)

    def runs(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of all runs of ``n`` words; distinct (bucket, hash) of them; which one each place has;
        which ones are reference blocks; which ones are a block and occur again in the slab."""
        at = self.at[self.at + n <= self.end]
        code = self.rolling(n, 0)[at]
        code = (code >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32) | code & np.uint64(0xFFFFFFFF)
        distinct, which, counts = np.unique(code, return_inverse=True, return_counts=True)
        start = np.repeat(self.ends - self.sizes, self.sizes)
        block = np.zeros(len(distinct), bool)
        block[which[(at - start[at]) % n == 0]] = True
        return at, distinct, which, block, block & (counts > 1)

    def windows(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """96-bit hashes of the windows at ``places``; the first place of each distinct one, as a
        position in ``places`` and in order; and for every place the number of its distinct one."""
        high, low = self.rolling(n, 1)[places], self.rolling(n, 2)[places].astype(np.uint32)
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
        first = order[new]  # the sort is stable, so this is the earliest
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        which = np.empty(len(order), np.int64)
        which[order] = rank[np.cumsum(new) - 1]
        return high, low, np.sort(first), which


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def bucket_parts(distinct: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, positions of its blocks, positions of its other runs) for each bucket that has some."""
    numbers = distinct >> np.uint64(32)
    edges = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] + np.uint64(1)))
    for a, b in itertools.pairwise([*edges.tolist(), len(distinct)]):
        inside = np.arange(a, b)
        yield int(numbers[a]), inside[block[a:b]], inside[~block[a:b]]


def offer_runs(window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        slab = Slab(table)
        _, distinct, _, block, _ = slab.runs((window + 1) // 2, buckets)
        low = distinct.astype("<u4")
        rows = [(k, slab.slab, low[a].tobytes(), low[b].tobytes()) for k, a, b in bucket_parts(distinct, block)]
        return as_table(rows, [("bucket", pa.int64()), ("slab", pa.int64()), ("block", pa.binary()), ("other", pa.binary())])

    return run


ANSWER = [("slab", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]


def shared_runs(table: pa.Table) -> pa.Table:
    """For each slab of a bucket: which of its runs another slab has, too, one of the two as a block."""
    blocks, others = (table.column(c).to_pylist() for c in ("block", "other"))
    parts = [np.frombuffer(x, "<u4") for pair in zip(blocks, others, strict=True) for x in pair]
    _, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    ends = np.cumsum([0] + [len(p) for p in parts])
    block = np.zeros(len(counts), bool)
    for k in range(0, len(parts), 2):
        block[which[ends[k] : ends[k + 1]]] = True
    shared = (block & (counts > 1))[which]
    keys = zip(table.column("slab").to_pylist(), table.column("bucket").to_pylist(), strict=True)
    return as_table([(*key, np.packbits(shared[ends[2 * k] : ends[2 * k + 2]]).tobytes()) for k, key in enumerate(keys)], ANSWER)


def offer_windows(window: int, buckets: int):
    """A slab's windows around shared runs, once each, and in bucket -1 the mask of their places."""
    length = (window + 1) // 2

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return as_table([], WINDOWS)
        slab = Slab(table)
        at, distinct, which, block, shared = slab.runs(length, buckets)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for k, a, b in bucket_parts(distinct, block):
            inside = np.concatenate([a, b])
            if k in bits:
                shared[inside] |= np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(inside)).astype(bool)
        hits = np.zeros(len(slab.at) + window, np.int64)
        hits[at[shared[which]] + 1] = 1
        hits = np.cumsum(hits)
        mask = slab.at + window <= slab.end
        mask &= hits[slab.at + window - length + 1] > hits[slab.at]
        places = np.flatnonzero(mask)
        if not len(places):
            return as_table([], WINDOWS)
        high, low, first, _ = slab.windows(places, window)
        doc_of = np.repeat(np.arange(len(slab.docs)), slab.sizes)[places[first]]
        rows = [(-1, slab.slab, np.packbits(mask).tobytes(), None, None, None)]
        for k, inside in window_parts(high[first], buckets):
            docs, counts = np.unique(doc_of[inside], return_counts=True)
            chosen = first[inside]
            rows.append((k, slab.slab, high[chosen].astype("<u8").tobytes(), low[chosen].astype("<u4").tobytes(),
                         slab.docs[docs].astype("<i8").tobytes(), counts.astype("<i4").tobytes()))
        return as_table(rows, WINDOWS)

    return run


WINDOWS = [("bucket", pa.int64()), ("slab", pa.int64()), *((c, pa.binary()) for c in ("high", "low", "docs", "counts"))]


def window_parts(high: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    numbers = ((high >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(numbers, kind="stable")
    edges = np.flatnonzero(np.diff(numbers[order], prepend=-1))
    for a, b in itertools.pairwise([*edges.tolist(), len(order)]):
        yield int(numbers[order[a]]), order[a:b]


def later_windows(table: pa.Table) -> pa.Table:
    """For each slab of a bucket: which of its windows an earlier document of another slab has."""
    table = table.sort_by("slab")
    high, low, docs, counts = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("high", "<u8"), ("low", "<u4"), ("docs", "<i8"), ("counts", "<i4")))
    ends = np.cumsum([0] + [len(x) for x in high])
    row = np.repeat(np.arange(len(high)), np.diff(ends))
    h, g, doc = np.concatenate(high), np.concatenate(low), np.repeat(np.concatenate(docs), np.concatenate(counts))
    order = np.lexsort((row, doc, g, h))
    later = np.zeros(len(h), bool)
    later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
    keys = zip(table.column("slab").to_pylist(), table.column("bucket").to_pylist(), strict=True)
    return as_table([(*key, np.packbits(later[ends[k] : ends[k + 1]]).tobytes()) for k, key in enumerate(keys)], ANSWER)


def cut_passages(window: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        slab = Slab(table)
        total = len(slab.at)
        gone = np.zeros(total + 1, np.int64)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        if -1 in bits:
            places = np.flatnonzero(np.unpackbits(np.frombuffer(bits[-1], np.uint8), count=total))
            high, _, first, which = slab.windows(places, window)
            later = np.zeros(len(first), bool)
            for k, inside in window_parts(high[first], buckets):
                later[inside] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(inside)).astype(bool)
            repeated = later[which]
            again = np.ones(len(places), bool)
            again[first] = False
            starts = places[repeated | again]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
        return passages(slab, np.cumsum(gone)[:total] > 0)

    return run


OUT = pa.schema([
    ("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def passages(slab: Slab, gone: np.ndarray) -> pa.Table:
    begins = slab.ends - slab.sizes
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[slab.ends] - removed[begins]
    kept = []
    for words, n, a, b in zip(slab.words, removed.tolist(), begins.tolist(), slab.ends.tolist(), strict=True):
        kept.append(b" ".join(itertools.compress(words, ~gone[a:b]) if n else words).decode())
    # runs of removed words, cut where a document begins
    edge = np.zeros(len(gone) + 1, bool)
    edge[begins] = True
    start = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
    stop = np.flatnonzero(gone & np.concatenate([edge[1:-1] | ~gone[1:], [True]])) + 1 if len(gone) else start
    first = np.searchsorted(start, np.append(begins, len(gone)))
    of = np.repeat(begins, np.diff(first))
    spans = pa.StructArray.from_arrays([pa.array((x - of).astype(np.int32)) for x in (start, stop)], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans)
    return pa.Table.from_arrays([slab.ids.combine_chunks(), pa.array(slab.sizes), pa.array(removed), pa.array(kept, pa.string()), lists], schema=OUT)


def as_table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
