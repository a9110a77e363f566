"""Harmonic packing of documents into sequences of a fixed number of tokens.

A length belongs to class k if k pieces of that length fill a sequence: C/(k+1) < length <= C/k.
A document keeps its length if k such pieces waste little; otherwise a piece of exactly C/(k+1)
is cut off and the rest, at most C/(k(k+1)), is looked at again, so a document falls into a few
pieces. A bin of class k always takes k pieces, whatever they are, so no bin is ever searched for
and workers never need each other: packing is one pass over the documents without a shuffle. The
bins that are open when a worker has no more documents are chained and cut into whole sequences,
the last one into powers of two, which need no padding.
"""

import functools
import itertools
import re
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.batches import by_bytes, texts

CAPACITY = 2048
WASTE = 1 / 128
END_ID = 1
WORDS_KEPT = 1_200_000
SLICE_BYTES = 1 << 20
FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, waste: float = WASTE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers; every document
    ends with ``END_ID``, a null or empty text is that id alone. ``sequence_id`` is the worker's
    number above bit 40 plus a running number. A sequence is full up to ``waste`` of its capacity,
    or its length is a power of two. Repeated rows and null ids are documents of their own, other
    columns are ignored, an empty table gives no pieces.
    """
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = wanted.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, waste, TaskContext.get().partitionId() << 40)
        id_type = None
        for part in by_bytes(batches, "text", SLICE_BYTES):
            id_type = part.schema.field(0).type
            for doc, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode(texts(part)), strict=True):
                bins.add(doc, ids + END_ID.to_bytes(4, "little"))
            yield from rows(bins, id_type)
        if id_type is not None:
            bins.finish()
            yield from rows(bins, id_type)

    def rows(bins: "Bins", id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if bins.done:
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*bins.done, strict=True), kinds, strict=True)]
            names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            bins.done = []
            yield pa.RecordBatch.from_arrays(columns, names)

    return wanted.mapInArrow(run, f"id {kind.simpleString()}, {FIELDS}").withColumnRenamed("id", id_col)


def cut(n: int, capacity: int, waste: float) -> Iterator[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` tokens, in order."""
    while n >= capacity:
        yield capacity, 1
        n -= capacity
    while n:
        k = capacity // n
        if n * k >= (1 - waste) * capacity:
            yield n, k
            return
        piece = capacity // (k + 1)
        yield piece, capacity // piece
        n -= piece


class Bins:
    """Open bins of one worker, one per class; closed ones wait in ``done`` as rows."""

    def __init__(self, capacity: int, waste: float, first_id: int):
        self.capacity, self.waste, self.next_id = capacity, waste, first_id
        self.open: dict[int, list] = defaultdict(list)
        self.done: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for length, k in cut(total, self.capacity, self.waste):
            self.open[k].append((doc, start, ids[4 * start : 4 * (start + length)], total))
            start += length
            if len(self.open[k]) == k:
                self.close(self.open.pop(k))

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def finish(self) -> None:
        """Chain what open bins hold and cut it into full sequences, then into powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left, self.open = sum(len(p[2]) // 4 for p in rest), defaultdict(list)
        size = room = self._next_size(left)
        held: list = []
        for doc, start, ids, total in rest:
            while ids:
                take = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * take], total))
                start, ids, room, left = start + take, ids[4 * take :], room - take, left - take
                if not room:
                    self.close(held)
                    held, size = [], self._next_size(left)
                    room = size

    def _next_size(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << max(left.bit_length() - 1, 0)


@functools.lru_cache(1)
def encoder(path: str) -> "WordEncoder":
    return WordEncoder(path)


class Numbers(dict):
    """Numbers of words in the order in which they were first asked for; ``fresh`` has the new ones."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Token ids of texts from a tokenizer that drops white space, word by word.

    Such a tokenizer never lets a token cross white space and folds case, so equal words have equal
    ids wherever they stand; ids of words seen before come from a bounded table. What is looked up
    is what lies between ASCII white space, with A-Z folded (not in texts that may hold special
    strings, which are matched before folding). A new word of letters and a tail of punctuation is
    put together from the two, which the tokenizer keeps apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        if self._alone(["a  b\tA."]) != [b"".join(self._alone(["a", "b", "a", "."]))]:
            raise ValueError("the tokenizer must drop white space, fold case and part punctuation from letters")
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.ids = np.zeros(1 << 16, "<u4")
        self.ends = np.zeros(1 << 16, np.int64)  # of word n: from ends[n] to ends[n + 1]

    def encode(self, batch: list[bytes]) -> list[bytes]:
        if len(self.numbers) > WORDS_KEPT:
            self._forget()
        split = [(t if b"<|" in t else t.lower()).split() for t in batch]
        found = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        if self.numbers.fresh:
            self._learn()
        start, size = self.ends[found], self.ends[found + 1] - self.ends[found]
        until = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(start - until[:-1], size) + np.arange(until[-1])].tobytes()
        docs = 4 * until[np.cumsum([0] + [len(words) for words in split])]
        return [ids[a:b] for a, b in itertools.pairwise(docs.tolist())]

    def _learn(self) -> None:
        fresh, numbers = self.numbers.fresh, self.numbers
        first = len(numbers) - len(fresh)
        parts: dict[int, tuple[int, int]] = {}
        units, odd = [], []
        for n, word in enumerate(fresh):  # grows while it is read
            core = word.rstrip(PUNCTUATION)
            if not core or (core == word and LETTERS.fullmatch(word)):
                units.append(n)
            elif LETTERS.fullmatch(core):
                parts[n] = numbers[core], numbers[word[len(core) :]]
            else:
                odd.append(n)
        out: list[bytes] = [b""] * len(fresh)
        for n, ids in zip(units, self._units([fresh[n].decode() for n in units]), strict=True):
            out[n] = ids
        for n, ids in zip(odd, self._alone([fresh[n].decode() for n in odd]), strict=True):
            out[n] = ids
        for n, pair in parts.items():
            out[n] = b"".join([out[m - first] if m >= first else self._known(m) for m in pair])
        data = np.frombuffer(b"".join(out), "<u4")
        ends = self.ends[first] + np.cumsum([len(x) // 4 for x in out])
        self.ids = _fill(self.ids, self.ends[first], data)
        self.ends = _fill(self.ends, first + 1, ends)
        numbers.fresh = []

    def _known(self, n: int) -> bytes:
        return self.ids[self.ends[n] : self.ends[n + 1]].tobytes()

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of strings that the tokenizer never splits before merging, many to a call."""
        out: list[bytes] = []
        for k in range(0, len(units), 500):
            some = units[k : k + 500]
            encoded = self.model.encode(" ".join(some), add_special_tokens=False)
            of, ids = np.array(encoded.word_ids), np.array(encoded.ids, "<u4")
            if len(of) and of[-1] + 1 == len(some):
                ends = np.searchsorted(of, np.arange(len(some) + 1))
                out += [ids[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())]
            else:
                out += self._alone(some)
        return out

    def _alone(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(batch, add_special_tokens=False)]


def _fill(array: np.ndarray, at: int, data: np.ndarray) -> np.ndarray:
    """``array``, made longer if need be, with ``data`` from ``at`` on."""
    if at + len(data) > len(array):
        array = np.concatenate([array, np.zeros(max(len(array), len(data)), array.dtype)])
    array[at : at + len(data)] = data
    return array


#: What a new word is parted into: folded ASCII and Latin-1 letters, and ASCII punctuation behind.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
PUNCTUATION = string.punctuation.encode()
