"""The flagged-word index over a stream of documents: the array plan is one projection, so it runs as it is.

Null texts count as empty, with a null index; every row that arrives is scored, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from textloom.operators.detect import detect


def flagged_words(docs: DataFrame, own: float = 0.65, gate: float = 0.65, short: int = 5) -> DataFrame:
    """doc_id, n_words, flagged_words, flagged_word_pct for a batch or streaming DataFrame of doc_id and text."""
    return detect(docs.select("doc_id", "text"), own=own, gate=gate, short=short).select("doc_id", "n_words", "flagged_words", "flagged_word_pct")
