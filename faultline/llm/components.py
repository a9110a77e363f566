"""Connected components of an undirected graph by alternating star joins."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.staging import stage


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch replaced by links from every node to the least node it reaches in the batch."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.asarray(c) for c in batch.columns)
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            least = least_reached(len(nodes), at[: len(a)], at[len(a) :])
            own = np.arange(len(nodes)) != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[least[own]])], ["a", "b"])


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b: the least node that each one reaches."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, least[a], low)
        np.minimum.at(new, least[b], low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it reaches, for every node of ``links`` (a, b; longs).

    Links are contracted batch by batch first. Then two steps alternate until nothing changes: each
    node ties its larger neighbours to its least one, and ties its smaller neighbours and itself to
    their least one. Every round is stored; the number of rounds grows with the logarithm of the
    longest chain. Neighbours are aggregated before they are joined, so no list of them is built.
    """
    edges = stage(links.select("a", "b").filter("a <> b").mapInArrow(forest, "a long, b long").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.filter("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        near = large.join(least, F.col("a") == F.col("n"))
        small = near.select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        edges = stage(small.mapInArrow(forest, "a long, b long").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tied.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
