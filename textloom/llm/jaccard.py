"""Operator 6: n-gram Jaccard join with signature trees.

Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of word shingles. Steps:

1. Every text becomes a set of 64-bit shingle hashes; equal sets (by a 128-bit digest) are one class. Two different sets pass for
   equal, or a shingle for another, with a probability of about n * n / 2**129 and n / 2**64 for n sets, or shingles of a pair.
2. Routing, without loss: in a size class, linked sets differ in at most D shingles. Shingles fall into K > D groups by hash, so
   linked sets agree wholly on K - D groups at least; K is SPARE times D + 1. Each set is sent to the hash of each group's
   content, but for the K - D - M groups that rank lowest by their number of shingles that aren't common (frequent in a
   sample), then by content. Of the groups on which linked sets agree, the M highest have K - D - M others below them in both, so
   both are sent to them; the sample decides how much is sent, never what is found.
3. Sets that share M keys meet; so do all sets of a key that has more than LIST sets, over the least of them. A task sends but one
   set of such a key. Sets that meet, directly or over others, form a block (connected components of the meetings).
4. In each block, a signature tree is built over a tile of sets: leaves hold a bitmap of one set, nodes the OR of their
   children with ranges of sizes. Dual traversal of the tree with itself drops node pairs whose greatest possible overlap is too
   small for their sizes; what is left at the leaves is compared exactly unless already connected. A tile is bounded in sets and
   in shingles; of a set longer than the bitmaps the bound is weaker, never wrong.
5. Blocks beyond one tile: every tile is first joined with itself and a few common sets of the block. Then the sets outside
   the block's largest component meet all others as parity bitmaps, in which linked sets differ in no more bits than the sets in
   shingles. Texts go only to tiles where two sets of different components may still link, so that no link is missed.

Null texts, and texts without words, have the empty set: size 0, linked with nothing. Fewer words than a shingle make the whole
sequence one shingle. Equal texts link by their equal sets. Repeated rows each get a row; a component's id is its smallest
non-null doc_id, or null if all are null. An empty table gives no rows. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import bitmap, coded_words, forget, may_hold, released, slices, table, texts, tidied, written
from textloom.llm.components import components

#: Sets and shingles in a tile, common sets that every tile of a block gets, children of a tree node, most bits of a set's bitmap.
TILE, TILE_SHINGLES, HUBS, FANOUT, BITS = 256, 1 << 20, 4, 8, 1 << 16
#: Parity bitmaps in a tile, for each set in a tile of texts; their most bits.
WIDE, PARITY_BITS = 8, 1 << 14
#: Groups for each shingle, and one more, in which linked sets may differ.
SPARE = 1.5
#: Sets of a key that meet pair by pair; route keys that a task looks through at a time; salts of joins by block.
LIST, SOME_KEYS, SALTS = 12, 600_000, 16
#: Documents of the sample, in how many of them a shingle is common, and how many shingles are kept as common.
SAMPLE, COMMON_IN, MOST_COMMON = 4000, 3, 200_000
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles (of the whole sequence, if shorter)."""
    codes, ends, words = coded_words(column)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))
    total = len(codes)
    flat = np.zeros(total + n, dtype=np.uint64)
    flat[:total] = hashes[codes]
    full = np.full(total, n, dtype=np.uint64)
    for j in range(n):
        full = mix((full + flat[j : total + j]) * M1)
    out, at = [], 0
    for end in ends.tolist():
        if end - at >= n or end == at:
            out.append(np.unique(full[at : max(at, end - n + 1)]))
        else:
            one = np.full(1, end - at, dtype=np.uint64)
            for j in range(at, end):
                one = mix((one + flat[j : j + 1]) * M1)
            out.append(one)
        at = end
    return out


def shingles(text: str | None, n: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), n)[0]


class Router:
    """Size classes, and the groups of each."""

    def __init__(self, percent: int, common: np.ndarray):
        """common: sorted hashes of common shingles."""
        self.percent, self.t, self.common = percent, percent / 100, common
        self.ratio = 1 / self.t**2

    def band(self, size: int) -> int:
        return int(math.log(size) / math.log(self.ratio) + 1e-9)

    def classes(self, size: int) -> list[int]:
        """A pair meets in the class of its larger set; a smaller one is also sent where a larger partner may be."""
        return list(range(self.band(size), self.band(max(size, size * 100 // self.percent)) + 1))

    def groups(self, band: int) -> tuple[int, int, int]:
        """(D, K, M) of a class: most shingles in which linked sets of it differ, number of groups, and of keys that they share."""
        most = math.ceil(self.ratio ** (band + 1) + 1e-6)
        d = math.floor(2 * most * (100 - self.percent) / (100 + self.percent) + 1e-9)
        k = math.ceil(SPARE * (d + 1))
        return d, k, min(4, 1 + (k - d - 1) // 6)

    def keys(self, s: np.ndarray) -> list[np.ndarray]:
        """Route keys by class; the two lowest bits are M - 1."""
        out = []
        if len(self.common):
            rare = self.common[np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)] != s
        else:
            rare = np.ones(len(s), dtype=bool)
        for band in self.classes(len(s)):
            d, k, m = self.groups(band)
            group = ((s >> np.uint64(33)) % np.uint64(k)).astype(np.int64)
            sizes = np.bincount(group[rare], minlength=k)
            # sums of mixed hashes stand for a group's content; they only route, what meets is compared exactly
            content = np.zeros(k, dtype=np.uint64)
            np.add.at(content, group, mix(s * M1 + np.uint64(band)))
            key = mix(content ^ mix(((np.uint64(band) << np.uint64(32)) + np.arange(k, dtype=np.uint64)) * M1))
            key = key[np.lexsort((key, sizes))[k - d - m :]]
            out.append(key & np.uint64(2**64 - 4) | np.uint64(m - 1))
        return out


def weight(key: np.ndarray) -> np.ndarray:
    """Of a pair that shares the key: pairs of 12 together meet."""
    return 12 // ((key & 3) + 1)


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit ids of a set."""
    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8")
    return int(d[0]), int(d[1])


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of shingles that several documents of a bounded sample have, the most frequent ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(b.column("text"), n)).view(np.int64))], names=["h"])

    share = SAMPLE / max(SAMPLE, docs.count())
    counts = docs.select("text").sample(False, share, 7).mapInArrow(tidied(run), "h long").groupBy("h").count().where(F.col("count") >= COMMON_IN)
    return np.sort(np.array([r.h for r in counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()], dtype=np.int64).view(np.uint64))


def _lists(keys: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *keys]).view(np.int64)))


def _sets(n: int, percent: int, common) -> Callable:
    """Each row's set size, ids and route keys; a copy within the task adds no keys. Of more than LIST sets of one key, the first
    is sent alone, as `forced`, and the others point to it in `hubs`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, seen = Router(percent, common.value), set()
        rows: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]] = []
        routes: list[np.ndarray] = []  # of each kept row
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(k) for k in routes])
            key, owner = np.concatenate([np.zeros(0, dtype=np.uint64), *routes]), np.repeat(np.arange(len(routes)), lengths)
            sids = np.concatenate([hi for _, _, hi, _ in rows])
            order = np.argsort(key, kind="stable")
            run_of = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.zeros(0, dtype=np.int64)
            run_length = np.diff(np.append(run_of, len(key)))
            hot = np.repeat(run_length > LIST, run_length)
            first = np.repeat(run_of, run_length)
            lead = hot & (first == np.arange(len(key)))
            forced, hubs = [np.zeros(0, dtype=np.int64)] * len(routes), [np.zeros(0, dtype=np.int64)] * len(routes)
            kept = np.ones(len(key), dtype=bool)
            kept[order[hot]] = False
            follow = hot & ~lead
            for where, value, to in ((order[lead], key[order[lead]].view(np.int64), forced), (order[follow], sids[owner[order[first[follow]]]], hubs)):
                own = np.argsort(owner[where], kind="stable")
                at, value = owner[where][own], value[own]
                starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
                for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(at)][: len(starts)], strict=True):
                    to[at[a]] = np.unique(value[a:z])
            ends = np.cumsum(lengths)
            left = [key[z - c : z][kept[z - c : z]].view(np.int64) for z, c in zip(ends.tolist(), lengths.tolist(), strict=True)]
            at = 0
            for b, size, hi, lo in rows:
                z = at + b.num_rows
                none = pa.array(size == 0)
                columns = [b.column("doc_id"), b.column("h"), pa.array(size), pa.array(hi, mask=none.to_numpy(zero_copy_only=False)), pa.array(lo, mask=none.to_numpy(zero_copy_only=False)), _lists(left[at:z]), _lists(forced[at:z]), _lists(hubs[at:z])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n_shingles", "sid", "check", "keys", "forced", "hubs"])
                at = z
            rows.clear()
            routes.clear()

        for b in slices(batches, "text", 2 << 20):
            sets = shingle_sets(b.column("text"), n)
            ids = np.array([digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            for s, x in zip(sets, ids[:, 0].tolist(), strict=True):
                new = len(s) > 0 and x not in seen
                if new and len(seen) < 200_000:
                    seen.add(x)
                routes.append(np.concatenate(router.keys(s)) if new else np.zeros(0, dtype=np.uint64))
                many += len(routes[-1])
            rows.append((b.select(["doc_id", "h"]), np.array([len(s) for s in sets], dtype=np.int64), ids[:, 0], ids[:, 1]))
            if many > SOME_KEYS:
                yield from flush()
                many = 0
        if rows:
            yield from flush()

    return tidied(run)


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, sid, forced) sorted by key and sid: pairs of sids that share a key, with their weight; of a key with more
    than LIST sets, or a forced one, each sid with the first, and the weight of pairs that meet."""
    pairs: list[np.ndarray] = []
    held, count = None, 0

    def packed() -> pa.RecordBatch:
        nonlocal pairs
        a = np.concatenate(pairs, axis=1)
        order = np.lexsort((a[1], a[0]))
        a = a[:, order]
        starts = np.flatnonzero(np.append(True, (np.diff(a[:2], axis=1) != 0).any(axis=0)))
        sums = np.minimum(np.add.reduceat(a[2], starts), 12)
        pairs = []
        return pa.RecordBatch.from_arrays([pa.array(a[0][starts]), pa.array(a[1][starts]), pa.array(sums)], names=["a", "b", "w"])

    def meet(key: np.ndarray, sid: np.ndarray, forced: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        lengths = np.diff(np.append(starts, len(key)))
        hard = (lengths > LIST) | np.logical_or.reduceat(forced, starts)
        hub = np.repeat(sid[starts], lengths)
        far = np.repeat(hard, lengths) & (sid != hub)
        if far.any():
            pairs.append(np.stack([sid[far], hub[far], np.full(int(far.sum()), 12)]))
        for size in np.unique(lengths[~hard & (lengths > 1)]).tolist():
            first = starts[~hard & (lengths == size)]
            w = weight(key[first])
            for i in range(size):
                for j in range(i + 1, size):
                    x, y = sid[first + i], sid[first + j]
                    apart = x != y
                    pairs.append(np.stack([y[apart], x[apart], w[apart]]))

    for b in batches:
        key, sid, forced = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sid", "forced"))
        if not len(key):
            continue
        if held is not None:
            key, sid, forced = (np.append(x, y) for x, y in zip(held, (key, sid, forced), strict=True))
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if last:
            meet(key[:last], sid[:last], forced[:last])
        held = key[last:], sid[last:], forced[last:]
        if len(held[0]) > LIST:  # its first sid stands for it from now on
            meet(*held)
            held = held[0][:1], held[1][:1], np.ones(1, dtype=bool)
        count += len(key)
        if count > 400_000:
            pairs = [p for p in pairs if p.size]
            if pairs:
                yield packed()
            count = 0
    if held is not None:
        meet(*held)
    pairs = [p for p in pairs if p.size]
    if pairs:
        yield packed()


class SignatureTree:
    """Levels of nodes, leaves first: OR of bitmaps, least and greatest size, most shingles that share bits, common label."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray):
        bits = min(BITS, 1 << max(8, (4 * max(map(len, sets))).bit_length()))
        maps = np.zeros((len(sets), bits), dtype=np.uint8)
        for k, s in enumerate(sets):
            maps[k, (s & np.uint64(bits - 1)).astype(np.int64)] = 1
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        words = np.packbits(maps, axis=1).view(np.uint64)
        loss = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.levels = [(words, sizes, sizes, loss, labels)]
        while len(words) > 1:
            starts = np.arange(0, len(words), FANOUT)
            words = np.bitwise_or.reduceat(words, starts, axis=0)
            _, low, high, loss, labels = self.levels[-1]
            a, b = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            labels = np.where(a == b, a, -1)  # -1: mixed, or none yet
            self.levels.append((words, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(loss, starts), labels))

    def pairs(self, percent: int) -> np.ndarray:
        """Leaf pairs a < b that may link, best bound first: dual traversal from (root, root), level by level."""
        a = b = np.zeros(1, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            words, low, high, loss, labels = self.levels[depth]
            keep, bounds = [], []
            for s in range(0, len(a), step := max(1, (4 << 20) // words.shape[1])):
                x, y = a[s : s + step], b[s : s + step]
                common = np.bitwise_count(words[x] & words[y]).sum(axis=1, dtype=np.int64) + np.minimum(loss[x], loss[y])
                common = np.minimum(common, np.minimum(high[x], high[y]))
                fine = (100 + percent) * common >= percent * (low[x] + low[y])
                fine &= (labels[x] != labels[y]) | (labels[x] < 0)
                keep.append(fine)
                bounds.append(common / (low[x] + low[y]))
            keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
            a, b = a[keep], b[keep]
            if depth:
                n = len(self.levels[depth - 1][0])
                i, j = (k.ravel() for k in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
                a, b = (a[:, None] * FANOUT + i).ravel(), (b[:, None] * FANOUT + j).ravel()
                fine = (a < n) & (b < n) & (a <= b if depth > 1 else a < b)
                a, b = a[fine], b[fine]
            elif len(a):
                order = np.argsort(-np.concatenate(bounds)[keep], kind="stable")
                a, b = a[order], b[order]
        return np.stack([a, b], axis=1) if len(self.levels) > 1 else np.zeros((0, 2), dtype=np.int64)


def tree_join(ids: list[int], sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of the given sets; sets of one label (not -1) are already known to be connected."""
    order = sorted(range(len(ids)), key=lambda k: (int(sets[k][0]), len(sets[k]), ids[k]))
    ids, sets, labels = [ids[k] for k in order], [sets[k] for k in order], np.array([labels[k] for k in order], dtype=np.int64)
    root = list(range(len(ids)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first: dict[int, int] = {}
    for k, label in enumerate(labels.tolist()):
        if label >= 0:
            root[k] = first.setdefault(label, k)
    links = []
    for a, b in SignatureTree(sets, labels).pairs(percent).tolist():
        if (x := find(a)) != (y := find(b)):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(x, y)] = min(x, y)
                links.append((ids[a], ids[b]))
    return links


def _join_units(n: int, percent: int) -> Callable:
    """From rows (unit, node, label, text) sorted by unit: spanning links of each unit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                sets = shingle_sets(pa.array([t for _, t in rows.values()], pa.string()), n)
                links = tree_join(list(rows), sets, [label for label, _ in rows.values()], percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for u, sid, label, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "label", "text")), strict=True):
                if u != unit:
                    yield from flush()
                    unit, rows = u, {}
                rows[sid] = (label, text)
        yield from flush()

    return tidied(run)


def parity(s: np.ndarray) -> bytes:
    """Bitmap of at least as many bits as shingles (up to PARITY_BITS): a bit tells whether an odd number of shingles share it."""
    bits = min(PARITY_BITS, 1 << max(6, (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _parities(n: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            sets = shingle_sets(b.column("text"), n)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary())], names=["node", "n", "bits"])

    return tidied(run)


def near_pairs(sizes: np.ndarray, bits: list[bytes], labels: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of sets in ascending order of size: pairs of places a < b of different labels that may link. A pair is compared in the bits
    of its smaller bitmap; a longer one is folded to it."""
    widths, far = np.array([len(x) for x in bits]), np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)  # neighbours, as bitmaps grow with the sets
        low, high = int(own[0]), int(far[own[-1]])
        maps = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint64).reshape(-1, width // 8), axis=0) for x in bits[low:high]])
        start = low
        while start <= own[-1]:
            stop = min(int(own[-1]) + 1, start + max(1, (8 << 20) // ((high - start) * (width + 32))))
            end = int(far[stop - 1])
            apart = np.bitwise_count(maps[start - low : stop - low, None] ^ maps[None, start - low : end - low]).sum(axis=2, dtype=np.int64)
            both = sizes[start:stop, None] + sizes[None, start:end]
            fine = ((100 + percent) * apart <= (100 - percent) * both) & (labels[start:stop, None] != labels[None, start:end])
            fine &= (np.arange(start, end) > np.arange(start, stop)[:, None]) & (np.arange(start, end) < far[start:stop, None])
            a, b = np.nonzero(fine)
            if len(a):
                yield a + start, b + start
            start = stop


def _near_units(percent: int, tile: int) -> Callable:
    """From rows (unit, node, label, n, bits) sorted by unit: smaller units of only those sets that may link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            rows.sort(key=lambda r: (r[2], r[0]))
            nodes, labels, sizes = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
            part = np.maximum(np.arange(len(rows)) // tile, (np.cumsum(sizes) - sizes) // TILE_SHINGLES)
            count = int(part[-1]) + 1
            needed = [np.zeros(0, dtype=np.int64)]
            for a, b in near_pairs(sizes, [r[3] for r in rows], labels, percent):
                own = (part[a] * count + part[b]) * len(rows)
                needed = [np.unique(np.concatenate([*needed, own + a, own + b]))]
            at, row = np.divmod(needed[0], len(rows))
            seed = np.array([unit], dtype=np.int64).view(np.uint64)
            units = mix((seed ^ mix(at.astype(np.uint64) * M1 + M2)) * M1).view(np.int64)
            for k in range(0, len(at), 100_000):
                cut = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(units[cut]), pa.array(nodes[row[cut]]), pa.array(labels[row[cut]])], names=["unit", "node", "label"])

        for batch in batches:
            for u, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "label", "n", "bits")), strict=True):
                if u != unit:
                    yield from flush()
                    unit, rows = u, []
                rows.append(tuple(row))
        yield from flush()

    return tidied(run)


def _same(n: int) -> Callable:
    """Rows whose text has the set they stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            own = zip(shingle_sets(b.column("text"), n), b.column("sid").to_pylist(), b.column("check").to_pylist(), strict=True)
            yield b.filter(pa.array([len(s) > 0 and digest(s) == (x, y) for s, x, y in own], pa.bool_())).select(["node", "text"])

    return tidied(run)


def join(df: DataFrame, words: int = 4, percent: int = 85, tile: int = TILE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = df.sparkSession
    docs = texts(df, key, text).withColumn("h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = spark.sparkContext.broadcast(common_shingles(docs, words))
    schema = "doc_id long, h long, n_shingles long, sid long, check long, keys array<long>, forced array<long>, hubs array<long>"
    rows = written(docs.mapInArrow(_sets(words, percent, common), schema), "jaccard-sets")
    ids = written(rows.select("doc_id", "n_shingles", "sid", "check"), "jaccard-ids")
    # a class is known by its 128-bit id; its node has 64 bits, other ones where two classes agree in the first 64
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    classes = rows.where("sid IS NOT NULL").groupBy("sid", "check").agg(least.alias("least"), F.min("n_shingles").alias("n"))
    first = F.first("check").over(W.partitionBy("sid").orderBy("check"))
    classes = written(classes.select("sid", "check", "least.doc_id", "least.h", "n", F.when(F.col("check") == first, F.col("sid")).otherwise(F.xxhash64("sid", "check")).alias("node")), "jaccard-classes")
    each = lambda c, sure: rows.select(F.explode(c).alias("key"), "sid", F.lit(sure).alias("forced"))
    routes = each("keys", False).unionAll(each("forced", True))
    met = routes.repartition(parts, "key").sortWithinPartitions("key", "sid").mapInArrow(tidied(_meetings), "a long, b long, w long")
    met = met.unionAll(rows.select(F.col("sid").alias("a"), F.explode("hubs").alias("b"), F.lit(12).cast("long").alias("w")))
    met = written(met.groupBy("a", "b").agg(F.sum("w").alias("w")).where("w >= 12").select("a", "b"), "jaccard-met")
    forget(rows)
    released(spark)
    blocks = components(met, "jaccard-blocks")
    forget(met)
    member = blocks.select(F.col("node").alias("sid"), F.col("root").alias("block")).unionAll(blocks.select("root", "root").distinct())
    member = written(member.join(classes, "sid").select("block", "node", "sid", "check", F.col("doc_id").alias("id"), F.col("h").alias("id_h"), "n"), "jaccard-members")
    # nodes are dealt to blocks and tiles first; texts join them last
    sizes = member.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")).where("tiles > 1")
    placed = written(_by_block(member.select("block", "node"), sizes, "left").select("block", "node", F.coalesce("tiles", F.lit(1)).alias("tiles")), "jaccard-placed")
    # most texts meet nothing: a bitmap keeps them out of the shuffle
    near = may_hold(docs, "h", bitmap(member, "id_h", "jaccard-bitmap")).where("bitmap_hit").drop("bitmap_hit")
    some = near.join(member.drop("block", "n"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("id_h"))).select("node", "sid", "check", "text")
    held = written(some.mapInArrow(_same(words), "node long, text string"), "jaccard-texts")
    released(spark)

    def links(units: DataFrame, name: str) -> DataFrame:
        dealt = units.join(held, "node").select("unit", "node", "label", "text").repartition(parts, "unit").sortWithinPartitions("unit")
        return written(dealt.mapInArrow(_join_units(words, percent), "a long, b long"), name)

    tiled = placed.select("block", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "node").unionAll(_hubs(placed))
    found = links(tiled.select(F.xxhash64("block", "tile").alias("unit"), "node", F.lit(-1).cast("long").alias("label")), "jaccard-links")
    released(spark)
    large = placed.where("tiles > 1")
    if not large.isEmpty():
        # all that may link is found from bitmaps, so that texts aren't sent to all tiles of their block
        bits = written(held.mapInArrow(_parities(words), "node long, n long, bits binary"), "jaccard-parities")
        rest = _rest(large, components(found, "jaccard-first")).join(bits, "node").select("unit", "node", "label", "n", "bits")
        rest = rest.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_near_units(percent, tile), "unit long, node long, label long")
        rest = written(rest, "jaccard-near")
        released(spark)
        found = found.unionAll(links(rest, "jaccard-rest"))
    roots = components(found, "jaccard-components")
    forget(held)
    root_of = classes.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("sid", "check", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = root_of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = _salted(root_of, smallest, "root", "sid", "inner").select("sid", "check", "component_id")
    out = ids.join(named, ["sid", "check"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _salted(rows: DataFrame, by_key: DataFrame, key: str, salt: str, how: str) -> DataFrame:
    """rows joined with a table of one row for each key, so that one key's rows go to SALTS tasks."""
    salts = by_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salts, [key, "salt"], how).drop("salt")


def _by_block(rows: DataFrame, by_block: DataFrame, how: str = "inner") -> DataFrame:
    return _salted(rows, by_block, "block", "node", how)


def _hubs(placed: DataFrame) -> DataFrame:
    """A block's least nodes, one for each of HUBS residues, for every tile of a block with several tiles."""
    several = placed.where("tiles > 1")
    least = several.groupBy("block", "tiles", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(HUBS)).alias("r")).agg(F.min("node").alias("node"))
    return least.select("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "node")


def _rest(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Units of the second round: sets outside a block's largest component, with all others of the block. Tiles have WIDE times
    the block's mean number of sets in a tile, which follows their shingles."""
    labelled = large.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("block", "tiles", "node", F.coalesce("root", "node").alias("root"))
    counts = labelled.groupBy("block", "root").agg(F.count("*").alias("n"), F.first("tiles").alias("tiles"))
    most = counts.groupBy("block").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.first("tiles").alias("tiles"))
    count = lambda c: F.ceil(c * F.col("tiles") / F.col("all") / WIDE).cast("int")
    totals = most.where(F.col("all") > F.col("top.n")).select("block", F.col("top.root").alias("main"), count(F.col("all") - F.col("top.n")).alias("tr"), count(F.col("top.n")).alias("ts"))
    rows = _by_block(labelled.drop("tiles"), totals).withColumn("in_main", F.col("root") == F.col("main")).withColumn("label", F.xxhash64("root").bitwiseAND(F.lit((1 << 62) - 1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("ts")).otherwise(F.col("tr"))).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    main = rows.where("in_main").select("*", each("tr").alias("other")).select(F.xxhash64(F.lit("main"), "block", "other", "mine").alias("unit"), "node", "label")
    rest = rows.where("NOT in_main")
    to_main = rest.select("*", each("ts").alias("other")).select(F.xxhash64(F.lit("main"), "block", "mine", "other").alias("unit"), "node", "label")
    to_rest = rest.select("*", each("tr").alias("other")).select(F.xxhash64(F.lit("rest"), "block", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "node", "label")
    return main.unionAll(to_main).unionAll(to_rest)


def representatives(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns, of the document with the smallest id of each component. Rows of one id are one document; rows
    without an id can't be told apart and all stay."""
    linked = join(df, words, percent, key=key, text=text).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("dropped id"), "component_id")
    dropped = linked.groupBy("dropped id").agg(F.max(F.col("dropped id") == F.col("component_id")).alias("kept")).where("NOT kept")
    dropped = written(dropped.select("dropped id"), "jaccard-dropped")
    # documents outside the bitmap stay where they are; the others are looked up
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(f"`{key}`").cast("long").alias("bitmap_key"))
    rows = may_hold(rows, "bitmap_key", bitmap(dropped, "dropped id", "jaccard-bitmap"))
    found = rows.where("bitmap_hit").join(dropped, F.col("bitmap_key") == F.col("dropped id"), "left_anti")
    both = rows.where("NOT bitmap_hit").select("doc").unionAll(found.select("doc"))
    return both.select(*[F.col("doc").getField(c).alias(c) for c in df.columns])


def op6_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
