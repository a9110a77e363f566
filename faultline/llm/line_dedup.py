"""Removal of boilerplate lines by the number of distinct sites that carry them.

Every line is known by a 128-bit hash. One aggregation builds a HyperLogLog sketch of the sites of
each hash, partial sketches first, so a line on every page is one small row per task. Sketches
decide except near the threshold, where the sites of the few lines concerned are counted exactly.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.staging import stage

MIN_SITES = 10
LG_K = 12
#: Five standard errors of a sketch with 2^LG_K registers.
ERROR = 5 * 1.04 / 2 ** (LG_K / 2)


def hashes(text: Column, names: tuple[str, str]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), text).alias(n) for seed, n in enumerate(names)]


def widespread(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2, first of the lines (h1, h2, site, doc) that at least ``min_sites`` sites carry."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc").alias("first"), F.count("*").alias("n"))
    spread = spread.filter(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch"))
    spread = stage(spread.filter(F.col("sites") >= min_sites * (1 - ERROR)).drop("sketch", "n"), "line_spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + ERROR))
    near = spread.filter(F.col("sites") <= min_sites * (1 + ERROR))
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").count().filter(F.col("count") >= min_sites)
    return sure.select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with boilerplate cut from ``text``, all columns, and ``n_lines``, ``n_removed``.

    Without ``counts`` these two are left out; with it they stand in place of columns of ``docs``
    that have their names.

    Lines end at "\\n". A line that occurs on at least ``min_sites`` distinct sites (null is a site of
    its own) is cut from every document but that with the smallest ``doc_id``, so that one copy of
    every line stays; rows without an id come last and keep a line only if no row with an id has
    it. Blank lines stay. Null texts stay null with no lines, an empty text has one line. Repeated
    rows are treated alike. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    line = F.expr("posexplode(split(cast(text as string), '\\n', -1))").alias("at", "line")
    rows = docs.filter("text IS NOT NULL").select(last.alias("doc"), F.xxhash64(F.col(site_col).cast("string")).alias("site"), *hashes(text, ("t1", "t2")), line)
    rows = rows.filter(F.trim("line") != "").select("doc", "site", "t1", "t2", "at", *hashes(F.col("line"), ("h1", "h2")))
    rows = stage(rows, "lines")
    cut = rows.join(widespread(rows, min_sites), ["h1", "h2"]).filter(F.col("doc") != F.col("first"))
    cut = cut.groupBy("doc", "t1", "t2").agg(F.collect_set("at").alias("cut"))  # no more than the document's lines
    cut = cut.select(F.col("doc").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "cut")
    whole = docs.select(F.struct("*").alias("row"), text.alias("body"), last.alias("doc"), *hashes(text, ("t1", "t2")))
    same = (F.col("doc") == F.col("_doc")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    joined = whole.join(cut, same, "left").select("row", without("body", "cut").alias("kept"), F.coalesce(F.size("cut"), F.lit(0)).alias("gone"))
    own = [F.col("kept.lines").alias("n_lines"), F.greatest("gone", F.lit(0)).cast("long").alias("n_removed")] if counts else []
    taken = {"n_lines", "n_removed"} if counts else set()
    columns = [F.col("kept.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in taken]
    return joined.select(*columns, *own)


@F.pandas_udf(T.StructType().add("text", "string").add("lines", "long"))
def without(body: pd.Series, cut: pd.Series) -> pd.DataFrame:
    """Texts without the lines at the given positions, and how many lines they had."""
    kept, counts = [], []
    for text, gone in zip(body, cut, strict=True):
        if text is None:
            kept.append(None)
            counts.append(0)
        elif gone is None:
            kept.append(text)
            counts.append(text.count("\n") + 1)
        else:
            lines, out = text.split("\n"), set(gone)
            kept.append("\n".join([x for i, x in enumerate(lines) if i not in out]))
            counts.append(len(lines))
    return pd.DataFrame({"text": pd.Series(kept, dtype=object), "lines": pd.Series(counts, dtype="int64")})
