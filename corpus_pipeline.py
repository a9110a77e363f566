"""From raw documents to packed training sequences, one stored stage after the other."""

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.staging import stage
from faultline.llm import line_dedup, mixing, packing, quality, simhash

#: Size of the batches that go between Spark and Python. Spark's default, 10,000 rows up to 64 MB, is held several
#: times over for each task, beside the heap and the word tables of workers that earlier stages leave behind.
BATCH_SIZE = "4m"


def small_batches(step: Callable) -> Callable:
    """``step`` in a session that hands texts to Python ``BATCH_SIZE`` at a time; a longer text goes alone.

    The setting stays in the session, as a stage's rows are computed when they are written.
    """

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_SIZE)
        return step(spark, docs, sf_dir)

    return run


@small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``quality.GOOD`` or more, under a model learned from the labelled ones among ``docs``.

    A null text is scored as an empty one, a very long one as a whole; repeated rows share their
    fate; null ids have no label and are scored like others; further columns, whatever their names,
    are carried along; without labelled documents every score is the same and all stay; an empty
    table stays empty.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep_row=True).filter(F.col("score") >= quality.GOOD).select("row.*")


@small_batches
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more sources carry (the first document keeps them).

    A null source is a source of its own. Null and empty texts stay as they are; rows without an id
    come last and keep a line only if no row with an id has it; repeated rows are treated alike.
    ``n_chars``, if there is one, is counted again; all other columns are carried along, whatever
    their names; an empty table stays empty.
    """
    kept = line_dedup.dedup_lines(docs, counts=False)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@small_batches
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates.

    Texts without words, null and empty ones too, are near-duplicates of each other. Rows without
    an id stay, as nothing tells them apart; of rows that repeat a kept id one stays. Long texts
    count as a whole, further columns are carried along, an empty table stays empty.
    """
    return simhash.keep_one(docs)


@small_batches
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own; null and empty texts have size 0; rows alike in id,
    source and text share their copies evenly, null ids too; further columns are carried along;
    an empty table stays empty.
    """
    return mixing.mix(docs)


@small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences.

    A null text is an empty one and gives the closing id alone; a very long one goes on over
    sequences; repeated rows and null ids are packed like others; other columns are left out,
    whatever their names; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Scores, hashes of shingles and token ids have no SQL form; tests/llm/test_pipeline.py checks each stage by a plain loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
