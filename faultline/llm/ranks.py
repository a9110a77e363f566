"""Positions in a global order without a global sort task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.staging import stage

_LOCAL = (1 << 33) - 1


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based position of each row in its group, counted in ``order``.

    Rows are dealt by range of group and order, so a group with most of all rows spreads over many
    tasks. A row's position is its position in the task's sorted part plus the sizes of the group's
    parts in earlier tasks; only one row per group and task is summed. Ties get some order, the
    same for every reader of the result, which is stored.
    """
    keys = [F.col(g).asc_nulls_last() for g in groups]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    first = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = first.select(
        *[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    position = F.col("_before") + F.col("_at") - F.col("_first")
    return rows.join(parts, same).select(*df.columns, position.alias(name))
