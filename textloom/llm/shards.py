"""Operator 9: minimax contiguous partition of documents into shards, with DataFrame functions only.

Rows of equal texts are one atomic group. Groups stand in the order of their texts' SHA-256; a shard is a run of groups. The
smallest feasible capacity is found by binary search, each candidate checked by greedy filling, and the runs end there.

The driver sees sums over ranges of digests ("cells"), never all groups: at first one cell for each two-digit prefix, then
only cells in which a cut may still fall are split by a further digit. What it holds is bounded by CELLS; the cuts are exact
as soon as every cell in which one may fall is a single group.

Null texts have size 1 and are a group apart from empty texts, whose size is also 1. Repeated rows are rows of their own.
An empty table gives no rows. Null ids are numbered like any other. Only the key and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import table, texts, written

#: Most cells that the driver asks for in a round.
CELLS = 200_000
#: Rows that get their slots in one window, about.
SLOT_ROWS = 4_000


def greedy(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Fill shards to the capacity, cutting at the given prefix sums only; the sums at the cuts, None if too few shards."""
    cuts, at = [], 0
    for _ in range(shards):
        at = prefix[bisect_right(prefix, at + capacity) - 1]
        cuts.append(at)
    return cuts if at == prefix[-1] else None


def least_capacity(prefix: list[int], shards: int, low: int) -> int:
    """Binary search for the smallest feasible capacity; `low` is a known lower bound."""
    high = prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return high


def cut_digests(groups: DataFrame, shards: int) -> list[str]:
    """First digests of shards 1, 2, ... (fewer if the last shards stay empty). groups: digest (hex), bytes."""

    def sums(where: Column | None, digits: int) -> list[tuple[str, int, int, int]]:
        rows = groups if where is None else groups.where(where)
        rows = rows.groupBy(F.substring("digest", 1, digits).alias("p"))
        return [tuple(r) for r in rows.agg(F.sum("bytes"), F.count("*"), F.max("bytes")).orderBy("p").collect()]

    cells = sums(None, 2)
    if not cells:
        return []
    total, largest = sum(c[1] for c in cells), max(c[3] for c in cells)
    low = max(-(-total // shards), largest)
    while True:
        prefix = [0, *accumulate(c[1] for c in cells)]
        high = least_capacity(prefix, shards, low)
        # where the cuts of capacities from low to high may fall once cells are split: a cut lies at or after the last cell
        # edge that low reaches, and at or before what high reaches, or that cell's first byte if it can't be split
        windows, a, b = [], 0, 0
        for _ in range(shards):
            a = prefix[bisect_right(prefix, a + low) - 1]
            k = bisect_right(prefix, b := b + high) - 1
            b = total if k >= len(cells) else prefix[k] if cells[k][2] == 1 else b
            windows.append((a, b))
        open_cells = [k for k, c in enumerate(cells) if c[2] > 1 and any(x < prefix[k + 1] and y > prefix[k] for x, y in windows)]
        if not open_cells:
            break
        by_length: dict[int, list[int]] = {}
        for k in open_cells:
            by_length.setdefault(len(cells[k][0]), []).append(k)
        length, ks = min(by_length.items())
        ks = ks[: CELLS // 16]
        deeper = 2 if len(ks) * 256 <= CELLS else 1
        prefixes = [cells[k][0] for k in ks]
        split = sums(F.substring("digest", 1, length).isin(prefixes), length + deeper)
        cells = sorted([c for k, c in enumerate(cells) if k not in set(ks)] + split)
    cuts = greedy(prefix, high, shards)
    starts = {p: c[0] for p, c in zip(prefix, cells, strict=False)}
    return [starts[c] for c in cuts[:-1] if c < total]


def shard(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: law `bytes`, equal texts together."""
    data = F.col("text").cast("binary")
    rows = texts(df, key, text).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.coalesce(F.sha2(data, 256), F.lit("-")).alias("digest"),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts = cut_digests(groups, shards)
    place = F.lit(0)
    for k, digest in enumerate(cuts):
        place = F.when(F.col("digest") >= digest, k + 1).otherwise(place)
    # slots: rows of a shard are dealt by id to bins of even sizes, numbered in each, after all rows of earlier bins
    bins = max(32, rows.count() // (shards * SLOT_ROWS))
    rows = rows.withColumn("shard", place).withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)).cast("int"))
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bin", (F.sum("n").over(W.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("before"))
    in_bin = F.row_number().over(W.partitionBy("shard", "bin").orderBy("doc_id", "digest")) - 1
    numbered = rows.withColumn("in_bin", in_bin).join(before, ["shard", "bin"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("in_bin")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
