"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame; all but the
last return the columns of `documents`.  `run` writes each stage's rows as Parquet below spark.checkpoint.dir and reads
them again as the next one's input, so a lost executor costs no more than the tasks it held.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import jaccard, language, packing, pii, quality
from faultline.llm._store import saved


#: Bounds of what a task holds of whole texts at a time: bytes of a batch on its way to a Python worker, and rows of a
#: batch that the Parquet reader fills.  Stages share the executors' memory, so these hold whoever calls a stage; `run`
#: sets the session's own values back.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def _bounded(stage: Callable) -> Callable:
    """The stage, with the session's batch sizes set before it plans anything."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BOUNDS.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


@_bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows have: one language leads with half of the letters or more, in its
    script, and they are as likely as in labelled texts.  Null, empty and letterless texts, other languages and scripts,
    and mixtures without a leading language go.  Repeated rows are judged alike; an empty table stays empty."""
    return language.keep_known(docs, language.fit(docs))


@_bounded
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of at least one half of the best grade; poor and toxic ones go.  A null text is judged as
    an empty one; repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.75 or more.  Texts without words have no
    copies; of rows with equal doc_id and set one stays; an empty table stays empty."""
    return jaccard.one_of_each(docs)


@_bounded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars is that of the new text, null for a null
    text.  Repeated rows stay; an empty table stays empty."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


@_bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a null or empty text is its end id alone, every row
    is a document of its own, and an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language_id", language_id), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates),
    ("personal_data", personal_data), ("packing", packed),
]

#: Model fitting, tokenizer and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    before = {name: spark.conf.get(name, None) for name in BOUNDS}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return docs
