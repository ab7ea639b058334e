"""Plug-in point for a window scorer of one's own: a function from a list of texts to a list of scores.

A null text is given as an empty one. Repeated rows are scored each; an empty table calls nothing. A column `score` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def scored(windows: DataFrame, scorer: Callable[[list[str]], list[float]], batch: int = 64, concurrency: int | None = None) -> DataFrame:
    """The rows with `score` double; texts go to the scorer in batches, from at most `concurrency` tasks at a time."""
    if concurrency:
        windows = windows.repartition(concurrency)
    windows = windows.drop("score")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [t or "" for t in b.column("text").to_pylist()]
            scores = [float(s) for k in range(0, len(values), batch) for s in scorer(values[k : k + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    return windows.mapInArrow(run, StructType([*windows.schema.fields, StructField("score", DoubleType())]))
