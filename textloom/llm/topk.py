"""Operator 2: exact top-k search by tiled matrix products.

Rows are packed into candidate shards of up to TILE vectors, queries into blocks of up to TILE. Every shard meets every block
in one matrix product; a partial selection keeps the k best of each query in the tile; lists are merged in a tree, FAN lists at
a time, until one is left. The queries are a stated subset (vec_id divisible by `every`), in blocks.

Components are taken as floor(scale * x) with x as double, products are exact integers (a component or score beyond 64 bits raises).
Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id; vectors of another
length than the query's don't meet it. Empty vectors score 0. Repeated ids: a query meets no candidate of its own id; repeated
query rows are one query by their least vector; repeated candidate rows each count, as rows. Ties go to the smaller id. A query with fewer than k candidates
returns them all, with none it has no row. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, written

#: Vectors in a tile's side; lists merged at a time; bytes of candidates that one group of tasks shares.
TILE, FAN, GROUP_BYTES = 2048, 16, 32 << 20


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: ids, and components as little-endian 64-bit integers."""
    kept: dict[int, list] = {}

    def block(dim: int, rows: list) -> pa.RecordBatch:
        ids = np.array([i for i, _ in rows], dtype="<i8")
        order = np.argsort(ids, kind="stable")
        values = np.array([v for _, v in rows], dtype="<i8").reshape(len(rows), dim)[order]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([values.tobytes()])], names=["dim", "n", "ids", "data"])

    for b in batches:
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
            rows = kept.setdefault(len(v), [])
            rows.append((i, v))
            if len(rows) == TILE:
                yield block(len(v), kept.pop(len(v)))
    for dim, rows in kept.items():
        yield block(dim, rows)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers: by doubles where every partial sum is below 2**53, else by 64-bit or Python integers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, the places of the k best candidates; ids ascend, so an earlier place wins a tie."""
    out = []
    for row, me in zip(scores, own, strict=True):
        usable = np.flatnonzero(ids != me)
        if len(usable) > k:
            s = row[usable]
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = usable[s > least]
            usable = np.concatenate([above, usable[s == least][: k - len(above)]])
        out.append(usable[np.lexsort((usable, -row[usable]))])
    return out


def search(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    x = F.col("e").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & fine)
    whole = lambda c: F.when(F.abs(c) < F.lit(float(1 << 62) / scale), F.floor(c * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("long"))
    rows = rows.select("vec_id", F.transform(x, whole).alias("v"))
    packed = "dim int, n int, ids binary, data binary"
    shards = written(rows.mapInArrow(_pack, packed), "topk-shards").withColumn("shard", F.monotonically_increasing_id())
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    size, n_shards = shards.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.count("*")).first()
    groups = max(1, size // GROUP_BYTES, min(n_shards, df.sparkSession.sparkContext.defaultParallelism))
    blocks = written(queries.coalesce(1 + int(size) // (1 << 30)).mapInArrow(_pack, packed), "topk-queries")
    shards = shards.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    blocks = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    tiles = shards.join(blocks, ["part", "dim"]).select("shard", "dim", "ids", "data", "q_ids", "q_data")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, dim, ids, data, q_ids, q_data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, q = np.frombuffer(ids, dtype="<i8"), np.frombuffer(q_ids, dtype="<i8")
                scores = product(np.frombuffer(q_data, dtype="<i8").reshape(len(q), dim), np.frombuffer(data, dtype="<i8").reshape(len(ids), dim))
                top = best(scores, ids, q, k)
                lists = [[{"neg": -int(s[j]), "vec_id": int(ids[j])} for j in t] for s, t in zip(scores, top, strict=True)]
                kind = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), shard)), pa.array(q), pa.array(lists, kind)], names=["node", "query_id", "top"])

    lists = tiles.mapInArrow(score, "node long, query_id long, top array<struct<neg: long, vec_id: long>>")
    levels, left = 1, n_shards
    while left > FAN:
        levels, left = levels + 1, -(-left // FAN)
    lists = lists.withColumn("node", F.pmod(F.xxhash64("node"), F.lit(FAN**levels)))
    for _ in range(levels):
        lists = lists.groupBy("query_id", F.floor(F.col("node") / FAN).alias("node")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    found = lists.select("query_id", F.posexplode("top").alias("rank", "hit"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))


def op2_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
