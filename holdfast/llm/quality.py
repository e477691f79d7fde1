"""Quality classifier: supervised subword embeddings with a softmax output (see `subwords`)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import subwords

#: Case matters for quality. The sample holds at most 3,000 rows labelled 1 and 2,000 labelled 0.
SETTINGS = subwords.Settings(lower=False, ones=3000, zeros=2000)
THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame, settings: subwords.Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """Quality score of every document: doc_id, held_out, score, predicted (see `subwords.fit` and `subwords.score`)."""
    return subwords.score(docs, subwords.fit(docs, labels, "quality", settings), threshold)
