"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix ``rate`` = target / size of the source times.
Laying these expectations end to end and adding one offset, drawn from the seed, a document is
emitted once for every integer that its stretch crosses. Documents are laid out by size, so that
every stretch of the line holds documents alike and the words taken come close to the target.
Positions come from counts per task (see ``ranks``), so a hot source is no task of its own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions.staging import stage
from faultline.llm.ranks import ranked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``totals`` (source, source_size) with ``target``.

    Weights are dealt in turn to the sources in code-point order, null last. A target is
    level x weight, or ``most`` times the source's size if that is less; the level is raised until
    the targets make up ``share`` of all sizes. Only sums over sources reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(ranked(totals, [], order).withColumn("weight", turn), "mix_sources")
    whole = sources.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * most
    while True:
        above = F.col("weight") * F.lit(level) > cap
        full, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        raised = (share * whole - full) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def plan_mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, mark, size, source_size, target, copies.

    ``docs`` needs doc_id, text and source; other columns are ignored. Null texts have size 0, a
    null source is a source of its own, null ids and repeated rows are rows like others, an empty
    table gives an empty plan. ``mark`` is a hash of the text. Ties in size go by a hash of doc_id.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", "source", sizes(text).alias("size"), F.xxhash64(text).alias("mark"))
    rows = stage(rows, "mix_sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(totals, weights, share)
    spread = F.md5(F.col("doc_id").cast("string"))
    placed = ranked(rows, ["source"], [F.col("size").asc(), spread.asc(), F.col("doc_id").asc(), F.col("mark").asc()])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("offset") + F.col("rate") * (F.col("rank") + 1)) - F.floor(
        F.col("offset") + F.col("rate") * F.col("rank")
    )
    aims = aims.withColumn("rate", rate).withColumn("offset", offset("source", seed)).withColumnRenamed("source", "_source")
    return placed.join(aims, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "mark", "size", "source_size", "target", crossed.cast("long").alias("copies")
    )


def offset(source: str, seed: int) -> Column:
    """A number in [0, 1) for each source, fixed by the seed."""
    drawn = F.md5(F.concat_ws(":", F.lit("mix"), F.lit(str(seed)), F.col(source)))
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the plan says.

    Rows alike in doc_id, source and text are served together: their copies are dealt evenly.
    """
    plan = plan_mix(docs, seed, weights, share).groupBy(*_keys("k1", "k2"))
    plan = plan.agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")).filter("copies > 0")
    text = F.col("text").cast("string")
    row = docs.select(F.struct("*").alias("row"), "doc_id", "source", sizes(text).alias("size"), F.xxhash64(text).alias("mark"))
    row = row.select("row", *_keys("k1", "k2"))
    # the window finds the rows where the join has put them
    nth = F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.lit(0)))
    joined = row.join(plan, ["k1", "k2"]).withColumn("nth", nth)
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") <= F.col("copies") % F.col("rows")).cast("long")
    times = F.explode(F.array_repeat(F.lit(0), own.cast("int")))
    return joined.select("row", times.alias("time")).select("row.*")


def _keys(*names: str) -> list[Column]:
    """Two hashes of what tells rows apart: doc_id, source, size and text."""
    parts = [x for c in ("doc_id", "source", "size", "mark") for x in (F.isnull(c), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts).alias(n) for seed, n in enumerate(names)]
