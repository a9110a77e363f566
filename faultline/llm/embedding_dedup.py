"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside them.

Equal vectors are folded into one row with a count first. Centroids are learned on a bounded
sample; then every vector goes to its nearest centroid's cell, and a copy of it into each other
cell whose border it is close to, so that neighbours on both sides of a border meet. A cell's own
vectors and its guests are cut into blocks; a block of its own meets each block of the cell in one
small matrix product, guests do not meet each other. What leaves a pair of blocks is a count of
links per vector and a spanning forest of them, not the pairs.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.staging import stage
from faultline.llm.components import components, least_reached

THRESHOLD = 0.95
SAMPLE = 20_000
MOST_CELLS = 2048
CHUNK = 2048
HASHES = 1 << 40
BLOCK = 2048
SLACK = 0.5
#: Components of a vector from which on SLACK serves; below, the border grows to the proven one.
WIDE = 16
ROUNDS = 8


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, cells: int | None = None, block: int = BLOCK, slack: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` for every row.

    Links join rows whose cosine, in double precision, is at least ``threshold``. A vector that is
    null, empty, zero or holds a null or a non-finite number links with nothing, and vectors of
    different length do not link. ``component_id`` is the smallest id reachable, ``kept`` marks the
    row that has it; a null id reaches whatever its links have. Repeated rows link like others.
    Without ``cells`` there are twice as many as the square root of the number of distinct vectors, at
    most ``MOST_CELLS``. The fit sees about ``sample`` vectors, chosen by their hash. ``slack`` is the width of a
    cell's border as a share of the width at which no link can be missed: 1 is proven, at 0.5 a
    link is missed only if the difference of the two vectors points almost straight across. The
    fewer components, the likelier that is, so without ``slack`` the share is 2 over the root of
    their number, at least 0.5 and at most 1. An empty table gives an empty result.
    """
    wide = F.col(vector_col).cast("array<double>")
    sound = (F.size(wide) > 0) & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound &= F.exists(wide, lambda x: x != 0)
    keys = [F.when(sound, F.xxhash64(F.lit(s), wide)).alias(f"h{s}") for s in (1, 2)]
    rows = stage(vectors.select(F.col(id_col).alias("id"), *keys), "vector_ids")
    unlinked = rows.filter("h1 IS NULL").select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
    )
    distinct = vectors.filter(sound).select(F.col(id_col).alias("id"), *keys, wide.alias("v")).groupBy("h1", "h2")
    distinct = distinct.agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    share = F.pmod("h1", F.lit(HASHES)) < int(HASHES * min(1.0, sample / max(1, n)))
    fitted = nodes.filter(share).select("h1", "h2", "v").toPandas().sort_values(["h1", "h2"])["v"]
    c = centroids(list(fitted), cells or min(MOST_CELLS, 2 * math.isqrt(n)))
    share = border(c.shape[1]) if slack is None else slack
    counted, linked = compare(nodes, c, threshold, block, share)

    degree = counted.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(linked)
    whole = nodes.select("node", "h1", "h2", "least", "copies").join(degree, "node", "left").join(roots, "node", "left")
    whole = whole.select(
        F.coalesce("root", "node").alias("root"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "least",
        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
    )
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    found = whole.join(least, "root").select("g1", "g2", "n_links", "component_id")
    out = rows.filter("h1 IS NOT NULL").join(found, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept")).unionByName(unlinked)


def border(dim: int) -> float:
    """Share of the proven border that serves for vectors of ``dim`` components."""
    return min(1.0, SLACK * math.sqrt(WIDE / dim)) if dim < WIDE else SLACK


def centroids(vectors: list, cells: int) -> np.ndarray:
    """Unit centroids, ``cells`` at most, of the vectors with the most common length."""
    if not vectors:
        return np.zeros((1, 1))
    sizes, counts = np.unique([len(v) for v in vectors], return_counts=True)
    x = np.stack([np.asarray(v) for v in vectors if len(v) == sizes[counts.argmax()]])
    x = unit(x)
    c = x[np.random.default_rng(0).permutation(len(x))[: max(1, cells)]]
    for _ in range(ROUNDS):
        home = np.concatenate([(x[k : k + CHUNK] @ c.T).argmax(1) for k in range(0, len(x), CHUNK)])
        moved = np.zeros_like(c)
        np.add.at(moved, home, x)
        norms = np.linalg.norm(moved, axis=1, keepdims=True)
        c = np.where(norms > 0, moved / np.maximum(norms, 1e-300), c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(nodes: DataFrame, c: np.ndarray, threshold: float, block: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """(node, n) counts of links, to be summed, and (a, b) links that span every component."""

    def near_cells(x: np.ndarray, margin: np.ndarray):
        """(row, cell, at_home): each row's home and the cells of lower number whose border is close."""
        for k in range(0, len(x), CHUNK):
            near = x[k : k + CHUNK] @ c.T
            home = near.argmax(1)
            far = near[np.arange(len(near)), home][:, None] - near
            row, cell = np.nonzero((far <= margin[home]) & (np.arange(len(c)) <= home[:, None]))
            yield row + k, cell, cell == home[row]

    def assign(batches):
        square = (c * c).sum(1)
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * (c @ c.T), 0))
        np.fill_diagonal(apart, 0)
        margin = slack * np.sqrt(2 - 2 * threshold) * apart
        for batch in batches:
            if not batch.num_rows:
                continue
            node, copies = (np.asarray(batch.column(i)) for i in (0, 1))
            values, ends = np.asarray(batch.column(2).flatten()), np.concatenate([[0], np.cumsum(np.asarray(batch.column(2).value_lengths()))])
            sizes = np.diff(ends)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = unit(values[ends[own][:, None] + np.arange(size)])
                if size == c.shape[1]:
                    row, cell, at_home = (np.concatenate(z) for z in zip(*near_cells(x, margin), strict=True))
                else:  # the few of another length are a cell of their own
                    row, cell, at_home = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
                flat = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), size)), pa.array(cell), pa.array(at_home), pa.array(node[own][row]), pa.array(copies[own][row]),
                     pa.array([flat[i].tobytes() for i in row], pa.binary())],
                    ["dim", "cell", "at_home", "node", "copies", "x"],
                )

    placed = nodes.select("node", "copies", "v").mapInArrow(assign, "dim long, cell long, at_home boolean, node long, copies long, x binary")
    placed = stage(placed, "vector_cells")
    # blocks are numbered through: the cell's own first, then its guests'; how many follows from the cell's size
    own_blocks, guest_blocks = (F.ceil(F.count_if(c) / block).cast("int") for c in (F.col("at_home"), ~F.col("at_home")))
    blocks = placed.groupBy("dim", "cell").agg(own_blocks.alias("h"), guest_blocks.alias("g")).filter("h > 0")
    dealt = placed.join(blocks, ["dim", "cell"])
    dealt = dealt.withColumn("own", F.expr("CAST(IF(at_home, pmod(xxhash64(node), h), h + pmod(xxhash64(node), g)) AS int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("at_home"), F.col("h") + F.col("g")).otherwise(F.col("h")) - 1)))
    pair = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    dealt = dealt.select("dim", "cell", *pair, "own", "node", "copies", "x")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        first = (group["own"] == group["i"]).to_numpy()
        inside = group["i"].iloc[0] == group["j"].iloc[0]
        left, right = np.flatnonzero(first), np.flatnonzero(first if inside else ~first)
        x = np.frombuffer(b"".join(group["x"]), np.float64).reshape(len(group), -1)
        copies, node = (group[k].to_numpy() for k in ("copies", "node"))
        n, found = np.zeros(len(group), np.int64), []
        for k in range(0, len(left), 256):
            some = left[k : k + 256]
            at, to = np.nonzero(x[some] @ x[right].T >= threshold)
            at, to = some[at], right[to]
            if inside:
                at, to = at[at < to], to[at < to]
            np.add.at(n, at, copies[to])
            np.add.at(n, to, copies[at])
            found.append((at, to))
        a, b = (np.concatenate(z) if found else np.zeros(0, np.int64) for z in zip(*found, strict=True)) if found else ([], [])
        order = np.argsort(node)
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        least = order[least_reached(len(node), rank[np.asarray(a, np.int64)], rank[np.asarray(b, np.int64)])[rank]]
        tied = least != np.arange(len(node))
        some = n > 0
        return pd.concat([
            pd.DataFrame({"node": node[some], "other": pd.array([pd.NA] * some.sum(), "Int64"), "n": pd.array(n[some], "Int64")}),
            pd.DataFrame({"node": node[tied], "other": pd.array(node[least[tied]], "Int64"), "n": pd.array([pd.NA] * tied.sum(), "Int64")}),
        ])

    keys = ["dim", "cell", "i", "j"]
    dealt = dealt.repartition(*keys)  # by pairs of blocks, not by the cells that the join has dealt
    met = stage(dealt.groupBy(*keys).applyInPandas(meet, "node long, other long, n long"), "vector_links")
    return met.filter("other IS NULL").select("node", "n"), met.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
