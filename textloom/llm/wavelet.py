"""Operator 10: token ids of whole documents in wavelet-matrix files.

Documents are sorted by id over the whole table; each task turns runs of about `shard_tokens` ids into one file image: bit
planes (highest bit first, zeros before ones on each level), each with a directory of the ones before every block of BLOCK bits,
and the documents' ids and lengths, all compressed. An image is one row of a Parquet table in the shared folder, so that Spark's
committer makes retries and lost executors harmless, and any store will do. Readers keep the planes packed: access and count use
rank, occurrence lookup uses select, both by the stored directories; all ids at once come back plane by plane, as the ranks of
neighbouring places are running counts.

Null and empty texts have just the end id. Strings of special tokens in a text give their ids, as the library does. Repeated ids
stay as rows, in an order fixed by their texts; null ids come first. An empty table makes no file. A document is never cut, so
one of more than `shard_tokens` ids has a larger file of its own. Only the key and text columns are read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import coded_words, gathered, slices, table, texts, tidied, tokenizer_file, written

END_ID, SHARD_TOKENS, BLOCK = 1, 1 << 19, 256
#: Words that the cache of a Python worker holds; a full cache starts anew.
CACHE = 400_000
MAGIC = b"WMX2"


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class Plane:
    """A packed bit vector with the number of ones before each block."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        """words: whole blocks of 64-bit words; before: a count for each block, and the total."""
        self.words, self.before = words, before

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        padded = np.zeros((len(bits) // BLOCK + 1) * BLOCK // 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        words = padded.view("<u8")
        counts = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        return cls(words, np.append(0, np.cumsum(counts)).astype("<u4"))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        out, first, rest = self.before[i // BLOCK].astype(np.int64), i // BLOCK * (BLOCK // 64), i % BLOCK
        for k in range(BLOCK // 64):
            n = np.clip(rest - 64 * k, 0, 64)
            mask = np.where(n == 64, np.uint64(0), np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1)
            out += np.bitwise_count(self.words[np.minimum(first + k, len(self.words) - 1)] & mask)
        return out

    def select(self, bit: int, j: np.ndarray) -> np.ndarray:
        """Places of the j-th ones (or zeros), from 0; all of them must exist."""
        counts = self.before.astype(np.int64)
        if not bit:
            counts = np.arange(len(counts), dtype=np.int64) * BLOCK - counts
        block = np.searchsorted(counts, j, side="right") - 1
        left, word = j - counts[block], block * (BLOCK // 64)
        here = lambda w: self.words[w] if bit else ~self.words[w]
        for _ in range(BLOCK // 64 - 1):
            n = np.bitwise_count(here(word)).astype(np.int64)
            on = left >= n
            left, word = np.where(on, left - n, left), word + on
        low = np.zeros(len(j), dtype=np.uint64)  # the place in a word, half by half
        bits = here(word)
        for half in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count((bits >> low) & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= n
            left, low = np.where(on, left - n, left), low + np.where(on, np.uint64(half), np.uint64(0))
        return word * 64 + low.astype(np.int64)


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], before: int = 0) -> bytes:
    """File image: MAGIC, bit width, ids, documents, ids in the earlier files of its part, zeros of each plane, then sizes of the
    parts of the image, then the parts."""
    symbols = ids.astype(np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32)
    width = max(1, int(symbols.max(initial=0)).bit_length())
    parts, zeros = [], []
    for level in range(width - 1, -1, -1):
        ones = (symbols & symbols.dtype.type(1 << level)) != 0
        plane = Plane.of(ones)
        parts += [_zip(plane.words.tobytes()), _zip(plane.before.tobytes())]
        zeros.append(len(symbols) - int(plane.before[-1]))
        symbols = np.concatenate([symbols[~ones], symbols[ones]])
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    parts += [_zip(np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes()), _zip(known.tobytes()), _zip(np.array(lengths, dtype="<i8").tobytes())]
    head = MAGIC + struct.pack("<BQQQ", width, len(ids), len(lengths), before) + struct.pack(f"<{width}Q", *zeros)
    return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class Reader:
    """A file image: packed planes with rank and select, document ids and lengths."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.width, self.n, docs, self.before = struct.unpack_from("<BQQQ", image, 4)
        at = 4 + struct.calcsize("<BQQQ")
        self.zeros = struct.unpack_from(f"<{self.width}Q", image, at)
        at += 8 * self.width
        sizes = struct.unpack_from(f"<{2 * self.width + 3}Q", image, at)
        at += 8 * len(sizes)
        parts = []
        for size in sizes:
            parts.append(_unzip(image[at : at + size]))
            at += size
        self.planes = [Plane(np.frombuffer(parts[2 * k], dtype="<u8"), np.frombuffer(parts[2 * k + 1], dtype="<u4")) for k in range(self.width)]
        ids, known = np.frombuffer(parts[-3], dtype="<i8"), np.frombuffer(parts[-2], dtype=np.uint8)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(parts[-1], dtype="<i8")
        if len(self.doc_ids) != docs or any(self.n - int(p.before[-1]) != z for p, z in zip(self.planes, self.zeros, strict=True)):
            raise ValueError("damaged wavelet-matrix file")

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at the given places."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for k, plane in enumerate(self.planes):
            one, r = plane.get(at), plane.rank(at)
            at = np.where(one, self.zeros[k] + r, at - r)
            symbol = symbol * 2 + one
        return symbol

    def all(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane's zeros and ones are put back where they came from."""
        symbol = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            symbol[self.zeros[k] :] |= symbol.dtype.type(1 << (self.width - 1 - k))
            one, before = np.unpackbits(self.planes[k].words.view(np.uint8), bitorder="little", count=self.n).view(bool), np.empty_like(symbol)
            before[~one], before[one] = symbol[: self.zeros[k]], symbol[self.zeros[k] :]
            symbol = before
        return symbol

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document, without those of others."""
        first = int(self.lengths[:k].sum())
        return self.access(np.arange(first, first + int(self.lengths[k])))

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        for k, plane in enumerate(self.planes):
            a, b = (int(x) for x in plane.rank(np.array([start, stop])))
            if symbol >> (self.width - 1 - k) & 1:
                start, stop = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        """How often the id stands among places start to stop."""
        if symbol >> self.width:
            return 0
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        return b - a

    def occurrences(self, symbol: int) -> np.ndarray:
        """All places of the id, by select on each plane from the last one up."""
        if symbol >> self.width:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(*self._range(symbol, 0, self.n))
        for k in range(self.width - 1, -1, -1):
            one = symbol >> (self.width - 1 - k) & 1
            at = self.planes[k].select(one, at - one * self.zeros[k])
        return at


#: Marks that end many words, and the special token that parts words encoded in one call.
TAIL, MARK = ".,;:!?", "<|endoftext|>"
#: Words of letters that are composed and have a lower case of one character, and parts that end with such a letter or a digit.
PLAIN, LETTER_END = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+$", "[0-9A-Za-zÀ-ÖØ-öø-ÿ]$"


@lru_cache(maxsize=2)
class Encoder:
    """Ids by the tokenizers library, with the file's own settings. Its pattern drops white space, never joins over it, and parts a
    letter or digit from a following mark, and its ASCII letters have no case; so every distinct word of a batch is encoded once
    and kept. A vocabulary for which that doesn't hold must be used with whole=True."""

    def __init__(self, spec: str, whole: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_str(spec), whole
        self.mark = self.tokenizer.token_to_id(MARK)
        # lower-case words of plain letters need neither the normaliser nor the pattern: the same model, words parted by blanks
        blank = json.loads(spec) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.simple = Tokenizer.from_str(json.dumps(blank))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the cache: words' places in a pool of ids."""
        self.words: dict[str, int] = {}
        self.pool, self.first, self.length = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _runs(self, tokenizer, words: list[str], gap: str) -> np.ndarray:
        """Ids of many words, joined in runs by the gap."""
        runs = tokenizer.encode_batch_fast([gap.join(words[k : k + 200]) + gap for k in range(0, len(words), 200)], add_special_tokens=False)
        return np.concatenate([np.zeros(0, dtype=np.uint32), *(np.array(e.ids, dtype=np.uint32) for e in runs)])

    def _keep(self, words: list[str], ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        base = len(self.pool)
        self.words.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.first, self.length, self.pool = np.append(self.first, base + first), np.append(self.length, length), np.append(self.pool, ids)

    def _learn(self, words: list[str]) -> None:
        """Encode words that are new, many in one call: plain ones end with an end-of-word token each, marks part the others."""
        plain = pc.match_substring_regex(pa.array(words, pa.string()), PLAIN).to_pylist()
        others = [w for w, p in zip(words, plain, strict=True) if not p]
        words = [w for w, p in zip(words, plain, strict=True) if p]
        ids = self._runs(self.simple, words, " ")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("a vocabulary without one end-of-word token to a word must be used with whole=True")
        starts = np.append(0, stops)[: len(words)]
        self._keep(words, ids, starts, stops - starts)
        marked = [w for w in others if self.mark is not None and "<|" not in w]
        ids = self._runs(self.tokenizer, marked, MARK)
        stops = np.flatnonzero(ids == self.mark) if marked else np.zeros(0, dtype=np.int64)
        starts = np.append(0, stops + 1)[: len(marked)]
        self._keep(marked, ids, starts, stops - starts)
        special = [w for w in others if self.mark is None or "<|" in w]
        alone = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(special, add_special_tokens=False)]
        stops = np.cumsum([0, *map(len, alone)])
        self._keep(special, np.concatenate([np.zeros(0, dtype=np.uint32), *alone]), stops[:-1], np.diff(stops))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each word is kept; new ones are encoded."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        got = list(map(self.words.get, distinct))
        if None in got:
            self._learn([w for w, k in zip(distinct, got, strict=True) if k is None])
            got = [self.words[w] if k is None else k for w, k in zip(distinct, got, strict=True)]
        return np.array(got, dtype=np.int64)[coded.indices.to_numpy()]

    def encode(self, column: pa.Array, coded: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end. coded: coded_words() of the column with capitals, if known."""
        if self.whole:
            each = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, dtype=np.uint32), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
        ids, n, ends = self.by_word(column, coded)
        return ids, np.append(0, np.cumsum(n))[ends]

    def by_word(self, column: pa.Array, coded: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the number of ids of each word of plain_words(), and where each text's words end."""
        if len(self.words) > CACHE:
            self.forget()
        codes, ends, distinct = coded or coded_words(column, lower=False)
        if not len(codes):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), ends
        parts = distinct.cast(pa.string())
        # marks behind such an end are a word of their own, and plain words have no case
        cores = pc.utf8_rtrim(parts, TAIL)
        marked = pc.and_(pc.less(pc.binary_length(cores), pc.binary_length(parts)), pc.match_substring_regex(cores, LETTER_END))
        cores = pc.if_else(marked, cores, parts)
        cores = pc.if_else(pc.match_substring_regex(cores, PLAIN), pc.utf8_lower(cores), cores)
        place = self._places(cores)
        first, length = self.first[place], self.length[place]
        with_marks = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        if len(with_marks):
            tails = pa.array([p[len(p.rstrip(TAIL)) :] for p in parts.filter(marked).to_pylist()], pa.string())
            tail = self._places(tails)
            first, length = self.first[place], self.length[place]  # the pool has grown at its end only
            # the pieces of each such part are put together once, behind the pool
            both = np.stack([place[with_marks], tail], axis=1)
            pool = np.concatenate([self.pool, gathered(self.pool, self.first[both].ravel(), self.length[both].ravel())])
            sums = self.length[both].sum(axis=1)
            length[with_marks], first[with_marks] = sums, len(self.pool) + np.cumsum(sums) - sums
        else:
            pool = self.pool
        n = length[codes]
        return gathered(pool, first[codes], n), n, ends


def write(df: DataFrame, path: str | None = None, whole: bool = False, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files; returns the written table: part (the writing task), n_tokens, image."""
    with open(path or tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = Encoder(spec.value, whole), TaskContext.get().partitionId(), 0
        docs: list = []
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            image = pack(np.concatenate(ids), docs, lengths, before)
            row = {"part": [part], "n_tokens": [size], "image": [image]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("n_tokens", pa.int64()), ("image", pa.binary())]))

        for b in slices(batches, "text", 8 << 20):
            flat, stops = encoder.encode(b.column("text"))
            flat = np.insert(flat, stops, END_ID)
            ends = stops + np.arange(1, len(stops) + 1)
            first, a = 0, 0
            own = b.column("doc_id").to_pylist()
            while first < len(own):  # as many documents as the file still takes, one at least
                n = max(int(np.searchsorted(ends, a + shard_tokens - size, side="right")) - first, 0 if docs else 1)
                if n:
                    z = int(ends[first + n - 1])
                    docs += own[first : first + n]
                    lengths += np.diff(ends[first : first + n], prepend=a).tolist()
                    ids.append(flat[a:z])
                    size, first, a = size + z - a, first + n, z
                if first < len(own):
                    yield flush()
                    docs, ids, lengths, size, before = [], [], [], 0, before + size
        if docs:
            yield flush()

    ordered = texts(df, key, text).withColumn("tie", F.crc32(F.col("text").cast("binary"))).orderBy("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(tidied(run), "part int, n_tokens long, image binary"), "wavelet")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A part is one task of the writer, so the driver's sums are as many as those tasks; a file knows what its part has before it.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, at = {}, 0
    for r in parts:
        starts[r.part] = at
        at += r.n
    shared = files.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, image in zip(b.column("part"), b.column("image"), strict=True):
                r = Reader(image.as_py())
                flat = memoryview(r.all().astype("<u4")).cast("B")
                ends = np.cumsum(r.lengths)
                first = ends - r.lengths
                crc = [zlib.crc32(flat[a * 4 : z * 4]) for a, z in zip(first.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(r.doc_ids, pa.int64()), pa.array(first + shared.value[part.as_py()] + r.before), pa.array(r.lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "image").mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))
