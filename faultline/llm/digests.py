"""Fingerprints of whole texts that stay close when a text is edited: quartile bucket digests.

Every three bytes in a row are hashed to one of ``BUCKETS`` counters; a digest holds for each
counter in which quartile of the document's counters it lies (two bits), and a code of the length.
Two digests differ by 0, 1, 2 or, from end to end, 6 points a bucket and up to ``LENGTH_MOST``
points for length. Likeness is one minus that score over the score that two unrelated digests with
as many buckets in each quartile would have, so it is 1 for equal texts and about 0 for strangers,
short ones too.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.staging import stage
from faultline.llm.batches import by_bytes, texts

BUCKETS = 512
LENGTH_MOST = 100
SLICE_BYTES = 4 << 20
COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int32)


def digest(text: bytes) -> bytes:
    """Length code, then the quartiles of the buckets, four to a byte."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:  # too short for a triplet: padded, so that different short texts differ
        b = np.concatenate([b, np.full(3 - len(b), 256 + len(b), np.uint32)]) if len(b) else b
    code = np.zeros(BUCKETS, np.uint8)
    if len(b):
        mixed = (b[:-2] * np.uint32(65_793) + b[1:-1] * np.uint32(257) + b[2:]) * np.uint32(0x9E3779B1)
        counts = np.bincount((mixed >> np.uint32(23)).astype(np.intp), minlength=BUCKETS)
        cuts = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])
        for q in (1, 2, 3):
            code += counts > cuts[q * BUCKETS // 4 - 1]
    fours = code.reshape(-1, 4)
    packed = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    length = min(255, int(np.log1p(len(text)) * 10))
    return bytes([length]) + packed.astype(np.uint8).tobytes()


def likeness(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """How alike the texts behind two lists of digests are, pair by pair, from 0 to 1."""
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (left, right))
    x, y = (np.stack([d[:, 1:] >> s & 3 for s in (0, 2, 4, 6)], 2).reshape(len(d), -1) for d in (a, b))
    lengths = np.minimum(2 * np.abs(a[:, 0].astype(int) - b[:, 0]), LENGTH_MOST)
    score = COST[x, y].sum(1) + lengths
    px, py = (np.stack([(q == k).mean(1) for k in range(4)], 1) for q in (x, y))
    chance = np.einsum("ni,ij,nj->n", px, COST, py) * BUCKETS
    return np.clip(1 - score / np.maximum(chance, 1), 0, 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's digest, that of an edit of it, and how near the edit and the next document are.

    Returns ``id_col``, ``n_chars``, ``edited`` (text), ``fingerprint``, ``edited_fingerprint``
    (lowercase hex), ``near_edited``, ``near_next``. The edit puts the beginning of the next
    document, in ascending id order and after the last the first, in place of the last half of the
    code points. Null ids come first; rows with equal ids go by a hash of the text, then the text;
    null texts are empty; an only document follows itself; other columns are ignored.
    """
    return _run(docs, id_col, text_col, with_text=True)


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``fingerprints`` with ``edited_sha256`` in place of the edited text."""
    return _run(docs, id_col, text_col, with_text=False)


def _run(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    dealt = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "text").drop("mark")
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, n_chars long, edited {'string' if with_text else 'binary'}, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the next one of the same task; the last one waits with the task's first text."""
        first, held, of = None, None, None
        for part in by_bytes(batches, "text", SLICE_BYTES):
            of = part.column(0).type
            seen = list(zip(part.column(0).to_pylist(), texts(part), strict=True))
            first = seen[0][1] if first is None else first
            seen = [held, *seen] if held is not None else seen
            held = seen[-1]
            if len(seen) > 1:
                out = described(of, [i for i, _ in seen[:-1]], [t for _, t in seen[:-1]], [t for _, t in seen[1:]], with_text)
                nothing = pa.nulls(len(seen) - 1, pa.string())
                yield _batch([*out, pa.nulls(len(seen) - 1, pa.int32()), nothing, nothing])
        if held is not None:
            out = [pa.array([held[0]], of), *[pa.nulls(1, a.type) for a in described(of, [], [], [], with_text)[1:]]]
            edge = [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([t.decode()]) for t in (first, held[1]))]
            yield _batch([*out, *edge])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text", SLICE_BYTES):
            out = described(part.column(0).type, part.column(0).to_pylist(), texts(part), texts(part, "next_text"), with_text)
            yield pa.RecordBatch.from_arrays(out, NAMES)

    done = stage(dealt.mapInArrow(along, f"{fields}, part int, first_text string, last_text string"), "digests")
    edges = done.filter("part IS NOT NULL").select("id", "part", "first_text", "last_text")
    # one number per task: where the next task that has rows is
    order = edges.select("part").withColumn("follower", F.lead("part").over(W.orderBy("part")))
    order = order.withColumn("follower", F.coalesce("follower", F.min("part").over(W.partitionBy())))
    heads = edges.select(F.col("part").alias("follower"), F.col("first_text").alias("next_text"))
    last = edges.join(order, "part").join(heads, "follower").select("id", F.col("last_text").alias("text"), "next_text")
    out = done.filter("part IS NULL").select(*NAMES).unionByName(last.mapInArrow(across, fields))
    edited = F.col("edited").alias("edited") if with_text else F.lower(F.hex("edited")).alias("edited_sha256")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return out.select(F.col("id").alias(id_col), "n_chars", edited, *hexed, "near_edited", "near_next")


NAMES = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def described(of: pa.DataType, ids: list, own: list[bytes], following: list[bytes], with_text: bool) -> list[pa.Array]:
    n_chars, edited, prints, edits, nexts = [], [], [], [], []
    after_text = before = None
    for text, after in zip(own, following, strict=True):
        chars = text.decode()
        half = len(chars) // 2
        changed = (chars[: len(chars) - half] + after.decode()[:half]).encode()
        n_chars.append(len(chars))
        edited.append(changed.decode() if with_text else hashlib.sha256(changed).digest())
        prints.append(before if text == after_text else digest(text))
        after_text, before = after, digest(after)  # in a run of rows, the next row's own
        edits.append(digest(changed))
        nexts.append(before)
    near = [likeness(prints, x) if prints else np.zeros(0) for x in (edits, nexts)]
    kinds = [of, pa.int64(), pa.string() if with_text else pa.binary(), pa.binary(), pa.binary()]
    return [pa.array(c, k) for c, k in zip((ids, n_chars, edited, prints, edits), kinds, strict=True)] + [pa.array(x, pa.float64()) for x in near]


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [*NAMES, "part", "first_text", "last_text"])
