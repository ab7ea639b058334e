"""Scores a collection of drafts: sentences, windows, flags, the flagged-word index and the highlighted text.

Null texts count as empty and have a null index, repeated rows are scored each, an empty table gives no rows. All columns of the
input stay; columns of the results' names are replaced. Scores are uncalibrated heuristics, or those of the caller's scorer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.scorer import scored

RESULTS = ["n_words", "flagged_words", "flagged_word_pct", "highlighted"]
_sum = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y).cast("long")


def detect(
    df: DataFrame, mode: str = "window", scorer: str | Callable[[list[str]], list[float]] = "heuristic", own: float = 0.65, gate: float = 0.65,
    short: int = 5, size: int = 3, style: Callable[[Column, Column], Column] = T.marked, batch: int = 64, concurrency: int | None = None, text: str = "text",
) -> DataFrame:
    """The rows with n_words, flagged_words, flagged_word_pct and highlighted.

    mode: "window" scores windows of `size` sentences and flags sentences by the mean of their windows, with the gate on isolated
    short ones; "sentence" scores each sentence alone, without the gate. scorer: "heuristic", one projection without a shuffle, or a
    function of texts, which gets windows in batches from at most `concurrency` tasks; documents are then put together by a shuffle
    of their scores. style: T.marked or T.ansi.
    """
    if mode not in ("window", "sentence"):
        raise ValueError("mode is window or sentence")
    keep = [c for c in df.columns if c not in RESULTS]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), T.sentences(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("ss"))
    rows = rows.withColumn("sw", F.transform("ss", T.words)).withColumn("n", F.transform("sw", F.size))
    width = size if mode == "window" else 1
    if callable(scorer):
        rows = _plugged(rows, scorer, width, batch, concurrency)
    else:
        rows = rows.withColumn("wsc", T.window_scores(F.col("sw"), width))
    rows = rows.withColumn("sc", T.sentence_scores(F.col("wsc"), width))
    flags = T.gated_flags(F.col("sc"), F.col("n"), own, gate, short) if mode == "window" else F.transform("sc", lambda s: s >= own)
    rows = rows.withColumn("flags", flags)
    rows = rows.withColumn("n_words", _sum(F.col("n"))).withColumn("flagged_words", _sum(F.zip_with("flags", "n", lambda f, n: F.when(f, n).otherwise(0))))
    pct = T.flagged_word_pct(F.col("flagged_words"), F.col("n_words"))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in keep], "n_words", "flagged_words", pct.alias("flagged_word_pct"), F.array_join(F.zip_with("ss", "flags", style), " ").alias("highlighted"))


def _plugged(rows: DataFrame, scorer: Callable[[list[str]], list[float]], size: int, batch: int, concurrency: int | None) -> DataFrame:
    """wsc from the caller's scorer: windows are rows while they are scored; a document is gathered by a key of its own."""
    rows = rows.withColumn("row", F.struct("doc", "ss", "sw", "n"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "row", "ss")
    windows = T.let(F.col("ss"), lambda ss: F.transform(ss, lambda _, i: F.array_join(F.slice(ss, i + 1, size), " ")))
    # the document rides on its first window only, so that it is moved once
    each = rows.select("rid", "row", F.posexplode_outer(windows).alias("i", "text"))
    each = each.withColumn("row", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("row"))).withColumn("text", F.coalesce("text", F.lit("")))
    done = scored(each, scorer, batch, concurrency)
    gathered = done.groupBy("rid").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "score")))).alias("scores"))
    return gathered.select("row.*", F.transform("scores", lambda x: x["score"]).alias("wsc"))
