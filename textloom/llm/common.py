"""What several operators share: the shared scratch folder, written tables, text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.files import spread

#: A-Z to a-z, byte by byte; all else stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are runs of ASCII digits, ASCII letters and all bytes of non-ASCII characters; the rest turns into blanks.
ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; null has none."""
    # bytes.split() parts at exactly these six white-space bytes
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(ALNUM).split()


def coded_words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """plain_words() of a whole batch: a code for each word in order, where each text's words end, and the distinct words (binary)
    that the codes number. Without `lower`, capitals stay."""
    texts_ = column.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts_) if lower else texts_)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # stands at the edges of texts that begin or end with white space
        there = codes != empty
        ends = np.append(0, np.cumsum(there))[ends]
        codes = codes[there]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return codes, ends, words.cast(pa.binary())


def gathered(pool: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Pieces of the pool in a row."""
    stop = np.cumsum(length, dtype=np.int64)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((first - (stop - length)).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return pool[at]


def fold(remainder: int, modulus: int = 5, column: str = "doc_id") -> Column:
    """True where crc32(id as text) mod `modulus` is `remainder`; null ids are in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, a new local one, but on
    a single machine only."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; a scratch table left over harms nobody
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here, lost executors don't matter.

    The table stays until the process ends, as results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of what is no longer referenced: it waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df.written_to)


#: Bits of a bitmap of hashed keys: its table has BITS / 64 rows of 16 bytes at most, whatever the number of keys.
BITS = 1 << 25


def bitmap(keys: DataFrame, column: str, name: str) -> DataFrame:
    """(bitmap_word, bitmap_bits): the hashed values of a column, as a table that `may_hold` broadcasts; its size is bounded by BITS."""
    slots = keys.select(F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(BITS)).alias("slot")).selectExpr("slot div 64 AS bitmap_word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit")
    return written(slots.groupBy("bitmap_word").agg(F.bit_or("bit").alias("bitmap_bits")), name)


def may_hold(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """The rows with `bitmap_hit`: false only where the bitmap lacks the column's value; null values are no hits."""
    slot = f"pmod(xxhash64({column}), {BITS}L)"
    joined = df.withColumn("bitmap_word", F.expr(f"{slot} div 64")).join(F.broadcast(words), "bitmap_word", "left")
    hit = F.expr(f"{column} IS NOT NULL AND coalesce(bitmap_bits & shiftleft(1L, CAST({slot} % 64 AS INT)), 0) <> 0")
    return joined.withColumn("bitmap_hit", hit).drop("bitmap_word", "bitmap_bits")


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the strings of one slice take about `most_bytes` at most (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: What empties the caches that a Python worker has kept of a task.
_kept: list[Callable[[], object]] = []


def _drop(*later: Callable[[], object]) -> None:
    """Empty the kept caches, or with `later`, keep those of the task that ends."""
    if not later:
        for f in _kept:
            f()
    _kept[:] = later


def tidied(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget_: Callable[[], object], kept: bool = False) -> Callable:
    """The same map, whose task leaves a small worker behind: caches are emptied and freed memory goes back to the system,
    as the worker lives on for other operators' tasks. With `kept`, the caches stay for the operator's next tasks, until a worker's
    first task of another map."""

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            _drop()
        try:
            yield from run(batches)
        finally:
            if kept:
                _drop(*forget_)
            else:
                for f in forget_:
                    f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
                ctypes.CDLL(None).malloc_trim(0)

    return tidy


#: Rows that a Python worker is given at a time: texts are long, and stages share the executors' memory.
BATCH_ROWS = 2000


def bounded(spark: SparkSession) -> None:
    """Batches of texts stay small, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (as long) and the text, so that further columns can neither clash nor be read."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; every operator also takes a path of its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


SPACED = re.compile(r" \s| \Z")
