"""Near-duplicates by SimHash, found through deletion variants of fingerprint halves.

With at most three differing bits one half of a fingerprint differs in one bit at most. So every
distinct fingerprint is listed under each of its halves and under each half with one bit deleted,
and fingerprints that share such a key are compared. A key holds fingerprints in any number; where
they are more than ``GROUP``, the same step is taken on the other half, and then on what is left of
that, with which at most 2^11 fingerprints can share a key. Keys return a spanning forest of the
links they verify, never all pairs of a dense group.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.staging import stage
from faultline.llm.batches import by_bytes, texts
from faultline.llm.components import components, least_reached

SHINGLE = 3
DISTANCE = 3
SEED = 42
GROUP = 2048
SLICE_BYTES = 1 << 20
SMALL = 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the hashes of the word shingles; 0 without words."""
    words = text.lower().split()
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words] if words else []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), itertools.repeat(SEED)), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``bits`` (the fingerprint as a long) of every row; null texts are empty."""
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE_BYTES):
            bits = np.array([fingerprint(t, shingle) for t in texts(part)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], ["id", "bits"])

    kind = wanted.schema["id"].dataType.simpleString()
    return wanted.mapInArrow(run, f"id {kind}, bits long").withColumnRenamed("id", id_col)


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text",
    group: int = GROUP,
) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 lowercase hex digits), ``component_id`` for every row.

    Fingerprints that differ in at most ``distance`` bits (0 to 3) are linked; ``component_id`` is
    the smallest id reachable over links, null only where no reachable row has an id. Texts without
    words have fingerprint zero and are linked like others. Repeated rows stay, other columns are
    ignored, an empty table gives an empty result. ``group`` bounds what one key compares at once.
    """
    if not 0 <= distance <= 3:
        raise ValueError("halves with one deleted bit find up to three differing bits")
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = stage(prints.groupBy("bits").agg(F.min(id_col).alias("least")), "simhash_nodes")
    roots = components(links(nodes.select("bits"), distance, group))
    found = nodes.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = found.join(least, "root").select("bits", "component_id")
    text = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return prints.join(of_print, "bits").select(id_col, text, "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The row with the smallest ``doc_id`` of every group of near-duplicates, all columns.

    Rows without an id are kept, as nothing tells them apart. Of rows that repeat an id that is
    kept, one stays.
    """
    kept = near_duplicates(docs, shingle, distance).filter("doc_id = component_id").select("doc_id").distinct()
    order = W.partitionBy("doc_id").orderBy(F.xxhash64(F.col("text").cast("string")))
    row = docs.filter("doc_id IS NOT NULL").select(F.struct("*").alias("row"), "doc_id", "text")
    first = row.join(kept, "doc_id", "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return first.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


#: Keys of a row: the number of the variant above, the half (or the part of it) with one bit deleted below.
_FIRST = """transform(sequence(0, 65), i -> struct(
  (shiftleft(cast(i as bigint), 32) | {part}) as k1, 0L as k2))"""
_HALF = "(shiftrightunsigned(bits, cast(i div 33 as int) * 32) & 4294967295L & ~if(i % 33 < 32, shiftleft(1L, i % 33), 0L))"
#: The half that the first key leaves open, and the part of it that the second key leaves open.
_OPEN = "(shiftrightunsigned(bits, if(shiftrightunsigned(k1, 32) < 33, 32, 0)) & 4294967295L)"
_SECOND = f"""transform(sequence(0, 33), i -> struct(k1, shiftleft(cast(i + 1 as bigint), 16) |
  (shiftrightunsigned({_OPEN}, cast(i div 17 as int) * 16) & 65535L & ~if(i % 17 < 16, shiftleft(1L, i % 17), 0L)) as k2))"""
_LEFT = f"(shiftrightunsigned({_OPEN}, if(shiftrightunsigned(k2, 16) - 1 < 17, 16, 0)) & 65535L)"
_THIRD = f"""transform(sequence(0, 17), i -> struct(k1, k2 | shiftleft(cast(i + 1 as bigint), 40) | shiftleft(
  shiftrightunsigned({_LEFT}, cast(i div 9 as int) * 8) & 255L & ~if(i % 9 < 8, shiftleft(1L, i % 9), 0L), 32) as k2))"""


def links(prints: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links a > b that join whatever is joined by pairs of distinct ``bits`` within ``distance``."""
    found = []
    rows = prints.select("bits", F.expr(f"inline({_FIRST.format(part=_HALF)})"))
    for finer in (_SECOND, _THIRD, None):
        most = group if finer else 1 << 62
        out = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(
            comparer(distance, most), "a long, b long, k1 long, k2 long"
        )
        out = stage(out, "simhash_links")
        found.append(out.filter("k1 IS NULL").select("a", "b"))
        crowded = out.filter("k1 IS NOT NULL").select(F.col("a").alias("bits"), "k1", "k2")
        if finer is None or crowded.isEmpty():
            break
        rows = crowded.select("bits", F.expr(f"inline({finer})"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.distinct()


def comparer(distance: int, most: int):
    """Reads rows sorted by key; links within keys of up to ``most`` rows, rows of larger ones back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        crowded = None
        for batch in batches:
            rows = [np.concatenate([h, np.asarray(batch.column(i))]) for i, h in enumerate(held)]
            bits, k1, k2 = rows
            if not len(bits):
                continue
            new = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            tail = new[-1]  # its key may go on in the next batch
            if len(bits) - tail > most:
                # the open key is over the bound: pass on what is here, remember the key
                yield from compare(bits[:tail], new[:-1], tail, k1, k2, distance, most, crowded)
                crowded = (k1[tail], k2[tail])
                yield back(bits[tail:], k1[tail:], k2[tail:])
                held = [x[:0] for x in rows]
                continue
            yield from compare(bits[:tail], new[:-1], tail, k1, k2, distance, most, crowded)
            held = [x[tail:] for x in rows]
            if crowded is not None and (k1[tail], k2[tail]) == crowded:
                yield back(*held)
                held = [x[:0] for x in rows]
        bits, k1, k2 = held
        if len(bits):
            yield from compare(bits, np.zeros(1, np.int64), len(bits), k1, k2, distance, most, crowded)

    return run


def back(bits: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bits), pa.nulls(len(bits), pa.int64()), pa.array(k1), pa.array(k2)], ["a", "b", "k1", "k2"])


def compare(bits, starts, end, k1, k2, distance, most, crowded) -> Iterator[pa.RecordBatch]:
    """Links of the whole groups that begin at ``starts`` and end before ``end``."""
    if not len(starts):
        return
    sizes = np.diff(np.append(starts, end))
    of = np.repeat(np.arange(len(starts)), sizes)
    values = bits[:end].view(np.uint64)
    linked = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    small = sizes[of] <= SMALL
    for gap in range(1, SMALL):
        if gap < end:
            pair = small[:-gap] & (of[gap:] == of[:-gap])
            at = np.flatnonzero(pair)
            at = at[np.bitwise_count(values[at] ^ values[at + gap]) <= distance]
            linked.append((at, at + gap))
    for g in np.flatnonzero(sizes > SMALL):
        start, stop = starts[g], starts[g] + sizes[g]
        if sizes[g] > most or (crowded is not None and (k1[start], k2[start]) == crowded):
            yield back(bits[start:stop], k1[start:stop], k2[start:stop])
            continue
        own = values[start:stop]
        near = [np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None]) <= distance) for i in range(0, len(own), 256)]
        a = np.concatenate([x + 256 * i for i, (x, _) in enumerate(near)])
        b = np.concatenate([y for _, y in near])
        least = least_reached(len(own), a, b)
        tied = np.flatnonzero(least != np.arange(len(own)))
        linked.append((start + tied, start + least[tied]))
    a, b = (bits[np.concatenate(x)] for x in zip(*linked, strict=True))
    if len(a):
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), none, none], ["a", "b", "k1", "k2"])
