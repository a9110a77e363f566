"""Token counts of whole texts.

Texts are encoded by the tokenizer's own library in Arrow functions, and only lengths leave the
Python worker. One call gets texts of about the same number of bytes, and a text longer than that
is cut first, but only where a cut cannot change a token (see ``safe_cuts``).
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.batches import by_bytes, raw, texts

CALL_BYTES = 1 << 20
PART_BYTES = 64 << 10
MARK = "▁"


def token_counts(
    docs: DataFrame, tokenizer: str, token_limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row of ``docs``.

    ``tokenizer`` is a path readable on every executor, ``.model`` for sentencepiece or ``.json``
    for tokenizers. No begin, end or other special tokens are added, nothing is truncated.
    Null texts count as empty, repeated rows and null ids stay rows of their own, other columns are
    ignored, an empty table gives an empty result.
    """
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", CALL_BYTES):
            data = texts(part)
            n_bytes = np.array([len(t) for t in data], np.int64)
            n_tokens = lengths(tokenizer, [t.decode() for t in data])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > token_limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = wanted.schema["id"].dataType.simpleString()
    out = wanted.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def lengths(tokenizer: str, batch: list[str]) -> np.ndarray:
    """Number of tokens of each text."""
    if tokenizer.endswith(".json"):
        encoded = _tokenizers(tokenizer).encode_batch_fast(batch, add_special_tokens=False)
        return np.array([len(e) for e in encoded], np.int64)
    model, may_cut = _sentencepiece(tokenizer)
    parts, owner = [], []
    for i, text in enumerate(batch):
        pieces = safe_cuts(text) if may_cut and len(text) > PART_BYTES else [text]
        parts += pieces
        owner += [i] * len(pieces)
    counted = np.zeros(len(batch), np.int64)
    start, size = 0, 0
    for k, part in enumerate(parts):
        size += len(part)
        if size >= CALL_BYTES or k + 1 == len(parts):
            ids = model.encode(parts[start : k + 1], num_threads=1)
            np.add.at(counted, owner[start : k + 1], [len(x) for x in ids])
            start, size = k + 1, 0
    return counted


def safe_cuts(text: str) -> list[str]:
    """``text`` in parts of about ``PART_BYTES`` whose tokens, joined, are those of the whole.

    A cut replaces one blank between two ASCII letters or digits. The library puts its word mark
    in front of every text, which stands for just that blank, and no token has the mark behind
    another character. Without such a place the text goes on to the next one.
    """
    out, start = [], 0
    while len(text) - start > PART_BYTES:
        at = text.find(" ", start + PART_BYTES)
        while at > 0 and not (_plain(text[at - 1 : at]) and _plain(text[at + 1 : at + 2])):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


@functools.lru_cache(2)
def _sentencepiece(path: str):
    """The model, and whether its vocabulary and normaliser allow cuts at blanks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    inner = any(MARK in p.lstrip(MARK) for p in pieces)
    # with a mark in front, and with every blank kept, a lone letter shows what the normaliser does
    kept = model.encode("a  b", out_type=str) != model.encode("a b", out_type=str)
    return model, not inner and kept and model.encode("a", out_type=str)[0].startswith(MARK)


@functools.lru_cache(2)
def _tokenizers(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model
