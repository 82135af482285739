"""From raw documents to token ids: what is toxic, repeated or leaked from the benchmark goes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it
again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import bpe, content_sort, near_dup, queries, templates, toxicity
from pricewell.llm.tables import read, rows_with_ids
from pricewell.session import materialized

#: Texts go to Python in batches of so many bytes, unless the session says otherwise: the JVM and the worker hold a whole batch each.
BATCH_BYTES, BATCH_SETTING = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage in a session that sends small batches to Python."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, among them all without text.

    The chain is trained on the labelled documents of the raw table.
    """
    raw = read(spark, sf_dir, "documents")
    chain = toxicity.trained(toxicity.labelled_rows(raw, read(spark, sf_dir, "labels")))
    return toxicity.scored(docs, chain).where(~F.col("rejected")).select(*docs.columns)


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those with the same text but for white space: the longest, then the smallest id.

    Rows that share an id and a text leave one.
    """
    return content_sort.surviving(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles."""
    gone = near_dup.near_duplicates(docs, near_dup.Similarity(words=5, percent=80)).where(~F.col("kept"))
    return rows_with_ids(docs, gone.select("doc_id"), "left_anti")


@in_small_batches
def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, reworded with other values or not."""
    found = templates.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return rows_with_ids(docs, found.select("doc_id"), "left_anti")


@in_small_batches
def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and whether the ids give the text back."""
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return bpe.encoded(docs, queries.BYTE_BPE).select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaked),
    ("bpe", tokenized),
]

#: The stages need a trained model, graph components and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
