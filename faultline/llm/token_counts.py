"""Token counts by an exact length histogram: documents are aggregated by encoded length, and suffix sums over the
distinct lengths answer totals, quantiles and truncated totals for every context limit.

Each input slice hands on one row for each length it has seen, so what is shuffled has no more rows than distinct lengths
times slices, whatever a key's share.  The suffix sums run over the distinct lengths; since those are different numbers
that add up to no more than the token total N, there are fewer than sqrt(2N) + 1 of them.

Defined results: null and empty texts have length 0; repeated rows count once each; an empty table gives no rows, and
total 0, quantile null; columns other than text are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from .encoding import Encoder

TOKENIZER = "word_bpe_49k.json"


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, n_docs: the exact histogram of encoded lengths of the column text."""

    def run(batches):
        total: Counter[int] = Counter()
        for batch in batches:
            for part in X.blocks(batch, "text"):
                u = Encoder.of(path).units(*X.as_bytes(part.column("text")))
                n = np.bincount(u.doc, weights=u.size, minlength=part.num_rows).astype(np.int64)
                seen, times = np.unique(n, return_counts=True)
                for length, times_seen in zip(seen.tolist(), times.tolist(), strict=True):
                    total[length] += times_seen
        yield pa.record_batch({"n_tokens": pa.array(list(total), pa.int64()), "n_docs": pa.array(list(total.values()), pa.int64())})

    return docs.select("text").mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds, for each length: docs_ge and tokens_ge (documents of at least that length and their tokens), docs_le, and
    truncated_tokens (the total if every document is cut to that length)."""
    up = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = histogram.withColumn("docs_ge", F.sum("n_docs").over(up)).withColumn("tokens_ge", F.sum(F.col("n_tokens") * F.col("n_docs")).over(up))
    whole = out.agg(F.max("docs_ge").alias("docs"), F.max("tokens_ge").alias("tokens"))
    return (
        out.crossJoin(F.broadcast(whole))  # one row
        .select(
            "n_tokens", "n_docs", "docs_ge", "tokens_ge", (F.col("docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
            (F.col("tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        )
    )


def total_tokens(sums: DataFrame) -> int:
    return sums.agg(F.max("tokens_ge")).first()[0] or 0


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length with at least the share q of documents no longer than it."""
    docs = sums.agg(F.max("docs_le")).first()[0]
    return None if docs is None else sums.filter(F.col("docs_le") >= F.lit(q) * docs).agg(F.min("n_tokens")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to `limit`: those of the shorter documents, and `limit` for each other."""
    short, long = sums.select(
        F.sum(F.when(F.col("n_tokens") < limit, F.col("n_tokens") * F.col("n_docs"))), F.sum(F.when(F.col("n_tokens") >= limit, F.col("n_docs")))
    ).first()
    return (short or 0) + limit * (long or 0)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    return with_suffix_sums(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER)))
