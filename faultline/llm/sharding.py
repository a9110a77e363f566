"""Shards of nearly equal bytes: a minimax contiguous partition of documents in hash order.

Equal texts are one atomic group. Groups stand in the order of a hash of their text, and the
sequence of their sizes is cut into contiguous shards so that the largest shard is as small as it
can be. A capacity is feasible if filling shards greedily up to it leaves nothing over; the
smallest feasible one lies between the largest of (average shard, largest group) and the average
plus the largest group, and is found by narrowing that range, several capacities a round.

Greedy filling needs only the largest prefix sum not above a limit, so it is one aggregation over
stored prefix sums per shard; files and row groups hold ranges of them, so that a filter on the
limits skips what cannot decide. Cuts are hashes: a document finds its shard by comparing its own
hash with them, without a join, wherever it lies. Column expressions and SQL functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.staging import stage
from faultline.llm.ranks import ranked

SHARDS = 8
#: Capacities that one round of the search tries.
TRIED = 31


def sizes(text: Column) -> Column:
    """Bytes of a text plus one; a null text has none."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")) + F.lit(1).cast("long")


def prefix_sums(groups: DataFrame) -> DataFrame:
    """``groups`` (mark, size), stored in ``mark`` order with ``total``, the size up to and with each row.

    Rows are dealt by range; a row's sum is that of its task's sorted part plus the parts before,
    of which there is one row per task.
    """
    dealt = groups.repartitionByRange("mark").sortWithinPartitions("mark")
    rows = stage(dealt.select("mark", "size", F.spark_partition_id().alias("part")), "shard_groups")
    parts = rows.groupBy("part").agg(F.sum("size").alias("own"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per task
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    within = F.sum("size").over(W.partitionBy("part").orderBy("mark").rowsBetween(W.unboundedPreceding, 0))
    summed = rows.withColumn("within", within).join(parts, F.col("part") == F.col("_part"))
    return stage(summed.select("mark", (F.col("before") + F.col("within")).alias("total")), "shard_sums")


def fill(sums: DataFrame, capacities: list[int], shards: int, longest: int) -> list[list[int]]:
    """For each capacity, the prefix sums at which greedy filling closes the first ``shards`` - 1 shards.

    The next cut of every capacity is found by one aggregation. It lies within ``longest``, the
    largest group, below its limit, as otherwise one more group would fit.
    """
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards - 1):
        limits = [(c[-1] if c else 0) + capacity for c, capacity in zip(cuts, capacities, strict=True)]
        total = F.col("total")
        near = total.between(min(limits) - longest, max(limits))
        tops = sums.filter(near).agg(*[F.max(F.when(total <= limit, total)).alias(f"c{i}") for i, limit in enumerate(limits)]).first()
        for i, c in enumerate(cuts):
            c.append(max(tops[i] or 0, c[-1] if c else 0))
    return cuts


def minimax_cuts(sums: DataFrame, shards: int, whole: int, longest: int, tried: int = TRIED) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the prefix sums at which it cuts."""
    low = max(-(-whole // shards), longest)
    high = -(-whole // shards) + longest  # every shard but the last then gets at least the average
    best = None  # the cuts at capacity ``high``, once that has been tried
    while low < high:
        step = max(1, -(-(high - low) // (tried + 1)))
        capacities = list(range(low, high, step))[:tried]
        cuts = fill(sums, capacities, shards, longest)
        fits = [whole - (c[-1] if c else 0) <= capacity for c, capacity in zip(cuts, capacities, strict=True)]
        if any(fits):
            at = fits.index(True)
            low, high, best = (capacities[at - 1] + 1 if at else low), capacities[at], cuts[at]
        else:
            low = capacities[-1] + 1
    return high, best if best is not None else fill(sums, [high], shards, longest)[0]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` (0 to ``shards`` - 1) and ``slot`` of every row.

    Size is UTF-8 bytes plus 1. Rows with equal texts share a shard; a null text counts as an empty
    one. The largest shard, in summed sizes, is as small as any cut of the hash order allows; where
    there are fewer groups than shards the last shards stay empty. Slots count from 0 in each shard
    by text hash, then id, nulls first; repeated rows take slots of their own. Very long texts are
    rows like others, other columns are ignored whatever their names, an empty table gives an empty
    result. The driver holds a few numbers per shard and capacity tried.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), sizes(text).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("mark"))
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "shard_rows")  # tells repeated rows apart
    groups = stage(rows.groupBy("mark").agg(F.sum("size").alias("size")), "shard_sizes")
    whole, longest = groups.agg(F.sum("size"), F.max("size")).first()
    ends: list[str | None] = []
    if whole:
        sums = prefix_sums(groups)
        _, cuts = minimax_cuts(sums, shards, whole, longest)
        marks = {r["total"]: r["mark"] for r in sums.filter(F.col("total").isin(cuts)).collect()}  # one row per cut
        ends = [marks[c] for c in cuts if c < whole]
    of = F.lit(0)
    for end in ends:
        of = of + (F.col("mark") > F.lit(end)).cast("int")
    placed = ranked(rows.withColumn("shard", of), ["shard"], [F.col("mark").asc(), F.col("id").asc_nulls_first(), F.col("tie").asc()], "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
