"""Operator 1: byte-level BPE encoding and decoding through DuckDB queries inside each partition.

Every match of the split pattern is a word. A word's tokens are rows (word, position, token); a recursive query joins
neighbouring rows with the merge table and contracts the leftmost pair of least rank until nothing joins. Decoding parts ids
before every token that begins with a blank, joins the token rows of each distinct run with the vocabulary and concatenates by an
ordered aggregate. Both keep words and runs that a worker has met, and look up each distinct one of a slice once.

Null and empty texts have no tokens and decode to no bytes. Repeated rows and ids stay, each with its own result; columns
other than the key and the text are neither read nor returned. The map has no shuffle, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import SPACED, slices, table, texts, tidied, tokenizer_file


class Limits(NamedTuple):
    """What one Python worker holds at a time; results don't depend on it."""

    #: Entries of each word cache; a full cache starts anew.
    cache_words: int
    #: Words and bytes that one recursive query contracts.
    query_words: int
    query_bytes: int
    #: Ids that one decoding query takes.
    decode_ids: int
    #: Text of a slice.
    slice_bytes: int


#: For executors that other operators share, whose heaps they leave grown; far larger, for the query alone: less time, more memory.
SMALL, LARGE = Limits(30_000, 5_000, 50_000, 25_000, 1 << 19), Limits(600_000, 40_000, 500_000, 250_000, 6 << 20)
#: Words of up to so many bytes are contracted one pair a round.
SHORT = 48

# A round for each pair: rows point to their right neighbour, and the words that changed go on to the next round.
CONTRACT_SHORT = """
WITH RECURSIVE step(round, w, pos, right_pos, tok) AS (
    SELECT 0, w, pos, right_pos, tok FROM init
    UNION ALL
    (WITH least AS (
        SELECT a.w, min({'merged': m.merged, 'pos': a.pos, 'gone': b.pos, 'right_pos': b.right_pos}) AS pick
        FROM step a JOIN step b ON a.right_pos = b.pos JOIN merges m ON m.pair = a.tok::BIGINT * 16777216 + b.tok
        GROUP BY a.w
    )
    SELECT round + 1, s.w, s.pos, CASE WHEN s.pos = pick.pos THEN pick.right_pos ELSE s.right_pos END,
        CASE WHEN s.pos = pick.pos THEN pick.merged ELSE s.tok END
    FROM step s JOIN least l ON s.w = l.w WHERE s.pos <> pick.gone)
)
SELECT s.w, s.tok FROM step s JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) l ON s.w = l.w AND s.round = l.round ORDER BY s.pos
"""
# For long words, where a row for each round and token would be too many: only the present state is kept, by key.
# `pos` is the offset of a token's first byte, so order survives without renumbering. recurring.step is the state of all
# words, step what the last round changed. Every occurrence of a word's least pair is contracted at once, every second one in
# a run of overlaps, just as repeated leftmost contraction would: a new pair holds the new token, and ranks above it. Where
# some merge of that token ranks below it ("lone"), only the leftmost occurrence is.
CONTRACT_LONG = """
WITH RECURSIVE step(w, pos, tok) USING KEY (pos) AS (
    SELECT w, pos, tok FROM init
    UNION
    (WITH live AS (
        SELECT w, pos, tok FROM recurring.step WHERE tok >= 0 AND w IN (SELECT w FROM step)
    ), pairs AS (
        SELECT w, pos, tok, lead(tok) OVER o AS tok2, lead(pos) OVER o AS pos2 FROM live
        WINDOW o AS (PARTITION BY w ORDER BY pos)
    ), hits AS (
        SELECT p.w, p.pos, p.pos2, m.merged, m.lone FROM pairs p JOIN merges m ON m.pair = p.tok::BIGINT * 16777216 + p.tok2
    ), least AS (
        SELECT w, min(merged) AS merged FROM hits GROUP BY w
    ), found AS (
        SELECT h.*, lag(h.pos2) OVER (PARTITION BY h.w ORDER BY h.pos) IS DISTINCT FROM h.pos AS fresh
        FROM hits h JOIN least l ON h.w = l.w AND h.merged = l.merged
    ), runs AS (
        SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) AS k, sum(fresh::INT) OVER (PARTITION BY w ORDER BY pos) AS run
        FROM found
    ), picked AS (
        SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k_run FROM runs
    )
    SELECT w, unnest([pos, pos2]) AS pos, unnest([merged, -1]) AS tok FROM picked
    WHERE CASE WHEN lone THEN k = 1 ELSE k_run % 2 = 1 END)
)
SELECT w, tok FROM step WHERE tok >= 0 ORDER BY pos
"""
DECODE = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS bytes FROM tok JOIN vocab USING (id) GROUP BY doc"


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """A row for every way to put two tokens together to a third; the third's rank is the merge's."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    lone = {x for a, b, m in zip(left, right, merged, strict=True) for x in (a, b) if x > m}
    pair = np.array(left, dtype=np.int64) * (1 << 24) + np.array(right, dtype=np.int64)
    return pa.table({"pair": pair, "merged": pa.array(merged, pa.int32()), "lone": pa.array([m in lone for m in merged], pa.bool_())})


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def joined(pieces: list[bytes], place: np.ndarray | pa.Array, stops: np.ndarray) -> list[bytes]:
    """The pieces at all places in a row, cut where `stops` of them have gone by."""
    row = pa.array(pieces, pa.large_binary()).take(place if isinstance(place, pa.Array) else pa.array(place))
    cuts, data = np.append(0, np.frombuffer(row.buffers()[1], dtype=np.int64)[stops]).tolist(), memoryview(row.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Engine:
    """The DuckDB database of one Python worker, with the merge table and the vocabulary."""

    def __init__(self, rank_file: bytes, pattern: str, limits: Limits = SMALL):
        import regex

        self.limits = limits
        self.ranks = read_ranks(rank_file)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.find = regex.compile(pattern).findall
        if pattern != _pattern(None):
            self._split = lambda blank, part: self.find(blank + part)
        self.opens = np.zeros(max(self.ranks.values()) + 1, dtype=bool)
        self.opens[[i for t, i in self.ranks.items() if t.startswith(b" ")]] = True
        self.sizes = np.zeros(len(self.opens), dtype=np.int64)
        self.sizes[list(self.ranks.values())] = [len(t) for t in self.ranks]
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})
        self.tables = {"merges": merge_table(self.ranks), "vocab": vocab}
        # ids are kept as the bytes of little-endian 32-bit integers
        self.words: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        #: Runs of ids and the bytes that they stand for.
        self.runs: dict[bytes, bytes] = {}

    @cached_property
    def con(self):
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        for name, rows in self.tables.items():
            con.register("given", rows)
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        con.unregister("given")
        return con

    def forget(self) -> None:
        """Empty the caches."""
        for cache in (self.words, self.first, self.later, self.runs):
            cache.clear()

    def close(self) -> None:
        """Empty the caches and close the database: the worker's next task may be another operator's."""
        self.forget()
        if "con" in self.__dict__:
            self.con.close()
            del self.con

    def _contract(self, words: list[str]) -> None:
        """Fill the cache for words that it lacks."""
        short, long = [], []
        for w in words:
            (short if len(w.encode("utf-8", "surrogatepass")) <= SHORT else long).append(w)
        self._query(short, CONTRACT_SHORT)
        self._query(long, CONTRACT_LONG)

    def _query(self, words: list[str], sql: str) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        start = 0
        while start < len(raw):
            stop, size = start, 0
            while stop < len(raw) and (stop == start or stop - start < self.limits.query_words and size + len(raw[stop]) <= self.limits.query_bytes):
                size += len(raw[stop])
                stop += 1
            lengths = [len(w) for w in raw[start:stop]]
            tok = self.byte_ids[np.frombuffer(b"".join(raw[start:stop]), dtype=np.uint8)]
            word = np.repeat(np.arange(stop - start, dtype=np.int32), lengths)
            pos = np.arange(len(tok), dtype=np.int32)
            last = np.append(word[1:] != word[:-1], True)
            self.con.register("init", pa.table({"w": word, "pos": pos, "right_pos": np.where(last, -1, pos + 1).astype(np.int32), "tok": tok}))
            done = self.con.execute(sql).fetchnumpy()
            self.con.unregister("init")
            ids = np.asarray(done["tok"]).astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(np.asarray(done["w"]), minlength=stop - start)) * 4
            a = 0
            for w, b in zip(words[start:stop], ends.tolist(), strict=True):
                self.words[w] = ids[a:b]
                a = b
            start = stop

    def _split(self, blank: str, part: str) -> list[str]:
        """The pattern's matches; Latin letters, alone or with one mark behind, need no search."""
        if part and max(part) < "\u0250":
            if part.isalpha():
                return [blank + part]
            if part[-1] in ".,;:!?" and part[:-1].isalpha():
                return [blank + part[:-1], part[-1]]
        return self.find(blank + part)

    def encode(self, docs: pa.Array | list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        A blank before a character that is no white space always starts a word, so text is parted there and each distinct part is
        split by the pattern once; a text with a blank before white space, or at its end, is split whole.
        """
        if max(len(self.words), len(self.first), len(self.later)) > self.limits.cache_words:
            self.forget()
        lists = pc.split_pattern((docs if isinstance(docs, pa.Array) else pa.array(docs, pa.string())).fill_null(""), " ")
        coded, counts = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        codes, parts, stops = coded.indices.to_numpy(), coded.dictionary.to_pylist(), np.cumsum(counts)
        starts = stops - counts
        later = np.ones(len(codes), dtype=bool)
        later[starts] = False
        blank = np.array([not p or p[0].isspace() for p in parts], dtype=bool)  # only for what stands behind a blank
        whole = np.unique(np.searchsorted(stops, np.flatnonzero(blank[codes] & later), side="right"))
        used = np.zeros(len(parts), dtype=bool)
        used[codes[later]] = True
        heads = [parts[c] for c in codes[starts].tolist()]
        for k in whole.tolist():
            heads[k] = " ".join([parts[c] for c in codes[starts[k] : stops[k]].tolist()])
        laters = [p for p, u in zip(parts, (used & ~blank).tolist(), strict=True) if u]
        found = [(self.first, p, self._split("", p)) for p in set(heads) if p not in self.first]
        found += [(self.later, p, self._split(" ", p)) for p in laters if p not in self.later]
        self._contract([w for w in dict.fromkeys(w for _, _, ws in found for w in ws) if w not in self.words])
        get = self.words.__getitem__
        for cache, part, ws in found:
            cache[part] = get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))
        # the ids of all texts in a row: each text's head, then its other parts, unless it was split whole
        own = [self.first[h] for h in heads] + [self.later[p] for p in laters]
        place = np.zeros(len(parts), dtype=np.int64)
        place[used & ~blank] = np.arange(len(heads), len(own))
        place = place[codes]
        place[starts] = np.arange(len(heads))
        if len(whole):
            keep = np.ones(len(codes), dtype=bool)
            for k in whole.tolist():
                keep[starts[k] + 1 : stops[k]] = False
            place, stops = place[keep], np.append(0, np.cumsum(keep))[stops]
        return joined(own, place, stops)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for: each distinct run from one id that begins with a blank to the next is decoded once."""
        if len(self.runs) > self.limits.cache_words:
            self.runs.clear()
        ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        if not len(flat):
            return [b""] * len(ids)
        opens = self.opens[flat]
        first = np.append(0, ends[:-1])
        opens[first[first < ends]] = True
        begins = np.flatnonzero(opens)
        offsets = pa.py_buffer(np.append(begins, len(flat)) * 4)
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(flat)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        pieces = list(map(self.runs.get, distinct))
        if None in pieces:
            # new runs go together, hundreds in a row of the query, and are cut by the lengths of their tokens
            new = [r for r, p in zip(distinct, pieces, strict=True) if p is None]
            together = b"".join(self._decode([b"".join(new[k : k + 300]) for k in range(0, len(new), 300)]))
            sizes = np.append(0, np.cumsum(self.sizes[np.frombuffer(b"".join(new), dtype="<u4")]))
            cuts = sizes[np.cumsum([len(r) // 4 for r in new])].tolist()
            self.runs.update(zip(new, [together[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
            pieces = [self.runs[r] if p is None else p for r, p in zip(distinct, pieces, strict=True)]
        return joined(pieces, coded.indices, np.searchsorted(begins, ends))

    def _decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for, by queries over rows of about `decode_ids` ids together (one row at least)."""
        out = [b""] * len(ids)
        stop = 0
        while (start := stop) < len(ids):
            size = 0
            while stop < len(ids) and (stop == start or size + len(ids[stop]) // 4 <= self.limits.decode_ids):
                size += len(ids[stop]) // 4
                stop += 1
            flat = np.frombuffer(b"".join(ids[start:stop]), dtype="<u4").astype(np.int32)
            if len(flat):
                doc = np.repeat(np.arange(start, stop, dtype=np.int32), [len(x) // 4 for x in ids[start:stop]])
                self.con.register("tok", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
                rows = self.con.execute(DECODE).fetchall()
                self.con.unregister("tok")
                for k, piece in rows:
                    out[k] = piece.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def _engine(rank_file: bytes, pattern: str, limits: Limits = SMALL) -> Engine:
    return Engine(rank_file, pattern, limits)


def _pattern(pattern: str | None) -> str:
    import public_tokenizers

    return pattern or public_tokenizers.PATTERN


def _rank_file(spark: SparkSession, path: str | None):
    """The vocabulary (under 1 MB for 50,000 tokens) goes out once from the driver; executors need no file of their own."""
    with open(path or tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't broadcast")
    return spark.sparkContext.broadcast(data)


def _column(values: list[bytes]) -> pa.Array:
    """Ids as list<int>, without a Python integer for each."""
    offsets = np.concatenate([[0], np.cumsum([len(v) // 4 for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), dtype="<u4").astype(np.int32)))


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int> of each text."""
    ranks, pattern = _rank_file(df.sparkSession, path), _pattern(pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(ranks.value, pattern)
        for b in slices(batches, "text"):
            ids = engine.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _column(ids)], names=["doc_id", "ids"])

    return texts(df, key, text).mapInArrow(tidied(run, lambda: _engine(ranks.value, pattern).close()), "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, bytes binary that each row's ids stand for; a null list has no bytes."""
    ranks = _rank_file(df.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(ranks.value, _pattern(None))
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                rows = [np.array(x or [], dtype="<u4").tobytes() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(engine.decode(rows), pa.binary())], names=["doc_id", "bytes"])

    return df.selectExpr(f"CAST(`{key}` AS LONG) AS doc_id", f"CAST(`{ids}` AS ARRAY<INT>) AS ids").mapInArrow(tidied(run, lambda: _engine(ranks.value, _pattern(None)).close()), "doc_id long, bytes binary")


def round_trip(df: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False, key: str = "doc_id", text: str = "text", limits: Limits = SMALL) -> DataFrame:
    """Encode each text, decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for."""
    ranks, pattern = _rank_file(df.sparkSession, path), _pattern(pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(ranks.value, pattern, limits)
        for b in slices(batches, "text", limits.slice_bytes):
            ids = engine.encode(b.column("text"))
            back = engine.decode(ids)
            columns = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in v], pa.string()) for v in (ids, back)]
            yield pa.RecordBatch.from_arrays(columns + [_column(ids)] * with_ids, names=names)

    return texts(df, key, text).mapInArrow(tidied(run, lambda: _engine(ranks.value, pattern, limits).close(), kept=limits == LARGE), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), limits=LARGE)
