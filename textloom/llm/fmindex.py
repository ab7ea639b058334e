"""Operator 4: benchmark decontamination with an FM-index of each training shard.

A shard is a run of documents of one partition with about `shard_words` words. Its words are coded by their place in the
phrases' sorted word list (0 for any other word; a mark parts documents), its suffixes are sorted, and the Burrows-Wheeler
transform goes into a wavelet matrix with rank directories. All phrases are searched backward at once, one rank query for each
bit plane and word. Occurrences are located by walking to sampled suffix positions, turned into word spans and merged.

Null and empty texts, and texts without words, have no words, no hits and a clean row. Phrase items that are null or without
words have no windows; repeated item rows count once by id; items with one id pool their windows. Repeated documents are
searched each for itself. Only the key and text columns are read. Documents are never shuffled: the phrase set, whose size is
checked, goes out to the tasks, and a lost executor costs only its tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import alnum_words, slices, table, texts, tidied

#: Words of one window, and about how many words one index holds (a longer document has an index of its own).
WINDOW, SHARD_WORDS = 10, 1_000_000
#: Every so many text positions, the suffix array is kept.
SAMPLE = 16
#: Phrase sets beyond this many bytes aren't broadcast: search() raises, and the caller searches ranges of items one after another.
PHRASE_BYTES = 64 << 20


class Ranks:
    """A bit vector with a count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix: a bit plane for each bit of the symbols, the highest first, zeros before ones on each level."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.width, self.planes, self.zeros = width, [], []
        for level in range(width - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.planes.append(Ranks(bits))
            ones = bits.astype(bool)
            self.zeros.append(len(symbols) - int(ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands among the first start, and the first stop, symbols."""
        at = np.zeros_like(start)
        for k, level in enumerate(range(self.width - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ends = [np.where(one, self.zeros[k] + (r := self.planes[k].ones(x)), x - r) for x in (at, start, stop)]
            at, start, stop = ends
        return start - at, stop - at

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol, at = np.zeros_like(i), np.zeros_like(i)
        for k in range(self.width):
            one, r, s = self.planes[k].get(i), self.planes[k].ones(i), self.planes[k].ones(at)
            i, at = np.where(one, self.zeros[k] + r, i - r), np.where(one, self.zeros[k] + s, at - s)
            symbol = symbol * 2 + one
        return symbol, i - at


def suffix_array(symbols: np.ndarray, width: int) -> np.ndarray:
    """Order of all suffixes. As many symbols as fit make the first key; later rounds double the length sorted by, and sort
    only suffixes that are still tied."""
    n = len(symbols)
    step = max(1, 62 // width)
    key, ext = np.zeros(n, dtype=np.int64), np.concatenate([symbols.astype(np.int64) + 1, np.zeros(step, dtype=np.int64)])
    base = (1 << width) + 1
    while base**step >= 1 << 62:
        step -= 1
    for k in range(step):
        key = key * base + ext[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = ~(head & np.append(head[1:], True))
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        suffixes = order[places]
        after = suffixes + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[suffixes] * (n + 1) + second
        new = np.argsort(both, kind="stable")
        order[places] = suffixes[new]
        both = both[new]
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        head[places] = fresh
        rank[order[places]] = np.maximum.accumulate(np.where(fresh, places, 0))
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        """symbols: below sigma; the end mark sorts before all and is stored as symbol 0 of a larger alphabet."""
        self.width = max(1, int(sigma).bit_length())
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        order = suffix_array(text, self.width)
        bwt = text[order - 1]
        self.wavelet = Wavelet(bwt, self.width)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 2))])
        self.n = len(text)
        marked = order % SAMPLE == 0
        self.marked, self.kept = Ranks(marked.astype(np.uint8)), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long phrases (rows of symbols)."""
        start, stop = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k].astype(np.int64) + 1
            a, b = self.wavelet.rank(c, start[live], stop[live])
            start[live], stop[live] = self.less[c] + a, self.less[c] + b
            live = live[a < b]
        dead = np.ones(len(phrases), dtype=bool)
        dead[live] = False
        stop[dead] = start[dead]
        return start, stop

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out, steps = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        left, row = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.marked.get(row)
            out[left[hit]] = self.kept[self.marked.ones(row[hit])] + steps[left[hit]]
            left, row = left[~hit], row[~hit]
            steps[left] += 1
            symbol, before = self.wavelet.access(row)
            row = self.less[symbol] + before
        return out


class Phrases:
    """The windows of all items: distinct phrases by length, the items of each, and the words' codes."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        coded = [(i, alnum_words(t)) for i, t in items if i is not None]
        self.code = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in coded for w in ws}))}
        found: dict[tuple[int, ...], set[int]] = {}
        for i, ws in coded:
            ids = [self.code[w] for w in ws]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(i)
        by_length: dict[int, list] = {}
        for phrase, owners in found.items():
            by_length.setdefault(len(phrase), []).append((phrase, sorted(owners)))
        self.groups = [(np.array([p for p, _ in x], dtype=np.int64), [o for _, o in x]) for _, x in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def find_spans(docs: list[list[int]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set[int]]]:
    """For each document, as coded words: merged spans [first, last) of hit words, and the items found.

    Runs of phrase words shorter than any phrase can't hold one and become a single 0 in the index.
    """
    mark = len(phrases.code) + 1
    text = np.concatenate([x for d in docs for x in (np.asarray(d, dtype=np.int64), [mark])]) if docs else np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(d) + 1 for d in docs])
    inside = (text > 0) & (text < mark)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    long = last - first >= phrases.shortest
    first, last = first[long], last[long]
    out: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in docs]
    if not len(first) or not phrases.shortest:
        return out
    # the kept runs, each after a 0, and where in the whole text each of their words stands
    lengths = last - first + 1
    place = np.repeat(first - 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    symbols = np.where(place >= 0, text[place], 0)
    symbols[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = 0
    index = FMIndex(symbols, mark)
    spans = []
    for rows, owners in phrases.groups:
        start, stop = index.search(rows)
        hit = np.flatnonzero(stop > start)
        if not len(hit):
            continue
        counts = (stop - start)[hit]
        which = np.repeat(hit, counts)
        sa_rows = np.repeat(start[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        at = place[index.locate(sa_rows)]
        doc = np.searchsorted(ends, at, side="right")
        spans.append((at, np.full(len(at), rows.shape[1])))
        for k in np.unique(doc * len(rows) + which).tolist():  # each document and phrase once
            out[k // len(rows)][1].update(owners[k % len(rows)])
    if spans:
        a, b = np.concatenate([s for s, _ in spans]), np.concatenate([s + n for s, n in spans])
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.concatenate([[True], a[1:] > b[:-1]])
        a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
        doc = np.searchsorted(ends, a, side="right")
        offset = np.concatenate([[0], ends])[doc]
        for d, x, y in zip(doc.tolist(), (a - offset).tolist(), (b - offset).tolist(), strict=True):
            out[d][0].append((x, y))
    return out


def _phrases(items: DataFrame, window: int, key: str, text: str) -> Phrases:
    small = items.select(F.col(key).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    size = small.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > PHRASE_BYTES:
        raise ValueError(f"the phrases take {size} bytes; over {PHRASE_BYTES}, search them in several passes of item ranges")
    return Phrases([(r.i, r.t) for r in small.collect()], window)


def search(df: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (found items, as sorted strings), spans (merged spans [first, last) of hit words)."""
    shared = df.sparkSession.sparkContext.broadcast(_phrases(items, window, item_key, item_text))
    schema = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<first: long, last: long>>"

    def flush(ids: list, docs: list[list[int]]) -> pa.RecordBatch:
        found = find_spans(docs, shared.value)
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(d) for d in docs], pa.int64()),
            pa.array([sum(b - a for a, b in s) for s, _ in found], pa.int64()),
            pa.array([sorted(map(str, i)) for _, i in found], pa.list_(pa.string())),
            pa.array([[{"first": a, "last": b} for a, b in s] for s, _ in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value.code.get
        ids: list = []
        docs: list = []
        words = 0
        for b in slices(batches, "text"):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws = alnum_words(t)
                coded = np.fromiter((code(w, 0) for w in ws), dtype=np.int32, count=len(ws))
                if docs and words + len(coded) > shard_words:
                    yield flush(ids, docs)
                    ids, docs, words = [], [], 0
                ids.append(i)
                docs.append(coded)
                words += len(coded)
        if docs:
            yield flush(ids, docs)

    return texts(df, key, text).mapInArrow(tidied(run), schema)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between the words of one span."""
    data = text.encode("utf-8", "surrogatepass")
    from textloom.llm.common import ALNUM

    mask = np.frombuffer(data.translate(ALNUM), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at : first[a]])
        at = int(last[b - 1])
    return (b"".join(parts) + data[at:]).decode("utf-8", "surrogatepass")


def removed(df: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, all columns, with the hit words cut out of their texts. Rows whose words are all hit keep an empty rest."""
    shared = df.sparkSession.sparkContext.broadcast(_phrases(items, window, item_key, item_text))
    where = df.columns.index(text)

    def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = shared.value.code.get
        new = batch.column(where).to_pylist()
        left = range(len(new))
        while left:  # what stands around a removed span may make a passage of its own
            found = find_spans([np.array([code(w, 0) for w in alnum_words(new[k])], dtype=np.int32) for k in left], shared.value)
            left = [k for k, (s, _) in zip(left, found, strict=True) if s and not new.__setitem__(k, remove_spans(new[k], s))]
        return pa.RecordBatch.from_arrays([*batch.columns[:where], pa.array(new, pa.string()), *batch.columns[where + 1 :]], schema=batch.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, shard_words * 6):
            yield flush(b)

    return df.mapInArrow(tidied(run), df.schema)


def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
