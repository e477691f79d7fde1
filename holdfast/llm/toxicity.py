"""Toxicity: subword-bag embeddings averaged into a linear softmax (see `subwords`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subwords

#: The sample holds at most 1,500 rows labelled 1 and 4,000 labelled 0. The decay keeps chance n-grams of clean texts small.
SETTINGS = subwords.Settings(ones=1500, zeros=4000, decay=3e-4)
THRESHOLD = 0.5


def classify(docs: DataFrame, labels: DataFrame, settings: subwords.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity score of every document: doc_id, held_out, score, predicted (see `subwords.fit` and `subwords.score`)."""
    return subwords.score(docs, subwords.fit(docs, labels, "toxic", settings), threshold)


def remove(docs: DataFrame, labels: DataFrame, settings: subwords.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, whole, whose text scores below the threshold. Rows are judged one by one, so repeated ids do no harm."""
    model = subwords.fit(docs, labels, "toxic", settings)
    return docs.filter(subwords.scorer(docs, model)(F.col("text").cast("string")) < threshold)
