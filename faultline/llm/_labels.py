"""A bounded, repeatable sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a classifier is fitted on.
MAX_FIT = 16_384
_SPAN = 1 << 30


def fit_sample(labels: DataFrame, most: int = MAX_FIT) -> DataFrame:
    """About `most` labelled documents at the most: doc_id, quality, toxic.

    Repeated doc_ids count once (lowest quality, highest toxic); rows with a null among the three are left out.
    The share is set from the number of labels, and membership by a hash of doc_id, so it is the same in every run.
    """
    one = (
        labels.select("doc_id", "quality", "toxic").dropna()
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    n = one.count()
    share = min(1.0, 0.97 * most / n) if n else 1.0
    return one.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(_SPAN)) < F.lit(int(share * _SPAN)))
