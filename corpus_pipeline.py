"""From raw documents to packed sequences: a pipeline of five operators.

Each stage takes the documents that the one before kept; all but the last return
the columns of ``documents``.  Null and empty texts leave at the first stage (no
trusted text resembles them); rows without a doc_id pass all stages that compare
documents unchanged; of a repeated row (same doc_id and text) one passes the third
stage; an empty table passes through.  Columns beyond those a stage needs, whatever
their names, stay untouched.

A stage's result is lazy, so the limits on batches that it runs under (``BATCHES``)
stay set in the session; those that the session already sets itself are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.columns import named, set_aside
from tallyloom.llm.minhash import drop_near_duplicates
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.quality import score_quality
from tallyloom.llm.queries import table, vocabulary
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.substring import remove_repeats
from tallyloom.llm.toxicity import fit_toxicity, toxic_passages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes that go to a Python worker at once, and rows that come out of a file at once.  Spark's own limits
#: (64 MB, and 4,096 rows) let long texts pile up several times over, in the worker and in its executor.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session whose batches are small, unless it has limits of its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCHES.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is not above their language's threshold."""
    own, back = set_aside(docs, ["doc_id", "text", "lang"])
    return back(score_quality(own, table(spark, sf_dir, "labels")).where("not rejected"))


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    own, back = set_aside(docs, ["doc_id", "text"])
    model = fit_toxicity(own, table(spark, sf_dir, "labels"))
    return back(toxic_passages(own, model, passages=False).where("score < 0.5"))


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one with the smallest doc_id, of each group of near duplicates (five words, similarity 0.8) and of repeats."""
    return drop_near_duplicates(docs, k=5, percent=80)


@in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that a document with a smaller doc_id holds; n_chars follows the text."""
    out = remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return out
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(n_chars if c == "n_chars" else named(c) for c in out.columns))


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, vocabulary(), capacity=1024, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Models and approximate search have no SQL form; each stage is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
