"""Benchmark decontamination: SimHash of item-sized windows, a multi-index on Hamming blocks, exact verification.

Every window of as many words as an item has is a candidate for that item; a document with fewer words is one window, as
long as it has enough shingles for the similarity. Its 64-bit SimHash over weighted shingles is
looked up in eight blocks of eight bits: fingerprints within a distance of `radius` agree in some block up to
radius // 8 bits, and a window is looked up under every block value within that many errors, so no fingerprint within the
radius is missed. What the look-ups find is verified by the similarity of weighted shingles (sum of the smaller over sum of
the larger counts). Windows that hold too few benchmark shingles to reach the similarity are passed over before they are
fingerprinted; that bound is exact.

The benchmark is a query set: it is read in blocks of `block_bytes` at most (or of one item, if that is larger), each broadcast
and held against all rows, without any shuffle of documents; a benchmark up to that size costs one scan of them.
Words are runs of letters, digits and non-ASCII characters, A-Z in lower case, so ASCII case and punctuation make no
difference.

Defined cases: null and empty texts and items without words match nothing; items of fewer words than a shingle are one
shingle and match exactly; repeated items each match; repeated rows match alike; a null id is kept as such; very long
texts are compared whole; of equally similar windows the first is told; an empty table or benchmark gives no matches, and
`without_leaks` then returns all rows; other columns pass through it whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._store import spread
from siftwell.llm._text import ALNUM, U64, Words, column, shingles, slices

BLOCKS, BITS = 8, 8
RADIUS = 23
BLOCK_BYTES = 16 << 20


def fingerprints(shingle_hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash of the m shingles from each start, by prefix sums over the 64 bits."""
    bits = np.unpackbits(shingle_hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(shingle_hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts + m] - sums[starts]) > m, axis=1, bitorder="little").view("<u8").ravel()


def near_values(errors: int) -> np.ndarray:
    return np.array([x for x in range(1 << BITS) if x.bit_count() <= errors])


class SizeIndex:
    """Items with the same number of words: fingerprints, their numbers by block value, and their shingle counts."""

    def __init__(self, m: int, idents: list, shingle_lists: list[np.ndarray]):
        self.m, self.idents = m, idents
        self.prints = np.concatenate([fingerprints(s, np.zeros(1, dtype=np.int64), m) for s in shingle_lists])
        values = [((self.prints >> U64(b * BITS)) & U64((1 << BITS) - 1)).astype(np.int64) for b in range(BLOCKS)]
        self.members = [np.argsort(v, kind="stable") for v in values]
        self.bounds = [np.searchsorted(v[order], np.arange((1 << BITS) + 1)) for v, order in zip(values, self.members, strict=True)]
        counted = [np.unique(s, return_counts=True) for s in shingle_lists]
        self.at = np.concatenate([[0], np.cumsum([len(k) for k, _ in counted])])
        self.keys, self.counts = np.concatenate([k for k, _ in counted]), np.concatenate([c for _, c in counted]).astype(np.int32)

    def look_up(self, prints: np.ndarray, near: np.ndarray, radius: int) -> Iterator[tuple[int, int, int]]:
        """(place, item, distance) of each fingerprint and item that meet in a block and are within the radius."""
        found = [np.zeros(0, dtype=np.int64)]
        for block in range(BLOCKS):
            probes = ((prints >> U64(block * BITS)) & U64((1 << BITS) - 1)).astype(np.int64)[:, None] ^ near[None, :]
            lo = self.bounds[block][probes].ravel()
            n = self.bounds[block][probes + 1].ravel() - lo
            place = np.repeat(np.arange(len(prints)).repeat(len(near)), n)
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.unique(place * len(self.prints) + self.members[block][at]))
        place, item = np.divmod(np.unique(np.concatenate(found)), len(self.prints))
        distance = np.bitwise_count(prints[place] ^ self.prints[item])
        close = distance <= radius
        yield from zip(place[close].tolist(), item[close].tolist(), distance[close].tolist(), strict=True)

    def shared(self, item: int, window: np.ndarray) -> int:
        """Sum of the smaller counts of the shingles of an item and a window."""
        a, b = self.at[item], self.at[item + 1]
        keys, counts = np.unique(window, return_counts=True)
        _, x, y = np.intersect1d(self.keys[a:b], keys, assume_unique=True, return_indices=True)
        return int(np.minimum(self.counts[a:b][x], counts[y]).sum())


class ItemIndex:
    """Items of one block of the benchmark, by their number of words."""

    def __init__(self, items: list[tuple], k: int, similarity: float, radius: int):
        self.k, self.similarity, self.radius = k, similarity, radius
        by_size = defaultdict(list)
        for ident, text in items:
            raw = (text or "").encode()
            words = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), ALNUM)
            if n := len(words.hashes):
                by_size[n].append((ident, shingles(words.hashes, min(k, n))))
        self.near = near_values(radius // BLOCKS)
        self.sizes = {n: SizeIndex(max(1, n - k + 1), [i for i, _ in group], [s for _, s in group]) for n, group in by_size.items()}
        self.known = {}
        for width in {min(k, n) for n in self.sizes}:
            own = [s for n, g in by_size.items() if min(k, n) == width for _, s in g]
            exact = np.unique(np.concatenate(own))
            rough = np.zeros(1 << 20, dtype=bool)
            rough[(exact >> U64(44)).astype(np.int64)] = True
            self.known[width] = exact, rough

    def flags(self, hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of `width` words and whether the benchmark has them, false where one would cross rows."""
        s = shingles(hashes, width)
        exact, rough = self.known[width]
        flag = rough[(s >> U64(44)).astype(np.int64)]
        at = np.flatnonzero(flag)
        flag[at] = np.isin(s[at], exact)
        for i in range(1, width):
            crossing = bounds[1:] - i
            flag[crossing[(crossing >= 0) & (crossing < len(flag))]] = False
        return s, flag

    def need(self, m: int, w: int) -> int:
        """Of an item of m and a window of w shingles at a similarity s at least (m + w) s / (1 + s) are shared."""
        return max(1, math.ceil((m + w) * self.similarity / (1 + self.similarity) - 1e-9))

    def matches(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, object, int, int, float, int]]:
        """(row, item, first word, words, similarity, distance) of every window that meets the similarity."""
        for width, _ in self.known.items():
            if len(hashes) < width:
                continue
            s, flag = self.flags(hashes, bounds, width)
            total = np.concatenate([[0], np.cumsum(flag)])
            upto = np.minimum(bounds, len(flag))
            for row in np.flatnonzero(total[upto[1:]] > total[upto[:-1]]).tolist():
                a, b = int(bounds[row]), int(bounds[row + 1])
                for n, g in self.sizes.items():
                    m, length = g.m, min(n, b - a)  # a row shorter than the item is one window
                    w = length - width + 1
                    if min(self.k, n) != width or w < 1 or self.need(m, w) > w:
                        continue
                    starts = np.arange(a, b - length + 1)
                    starts = starts[total[starts + w] - total[starts] >= self.need(m, w)]
                    for part in (starts[i : i + 1024] for i in range(0, len(starts), 1024)):
                        base = int(part[0])
                        prints = fingerprints(s[base : int(part[-1]) + w], part - base, w)
                        for place, item, distance in g.look_up(prints, self.near, self.radius):
                            both = g.shared(item, s[part[place] : part[place] + w])
                            if both and both >= self.similarity * (m + w - both) - 1e-9:
                                yield row, g.idents[item], int(part[place]) - a, length, both / (m + w - both), distance


def item_blocks(benchmark: DataFrame, id_col: str, text: str, most: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of `most` bytes at most, or of one larger item; the driver holds one block and one partition."""
    block, size = [], 0
    for ident, body in benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text}`").alias("text")).toLocalIterator():
        n = len((body or "").encode()) + 16
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((ident, body))
        size += n
    if block:
        yield block


class ItemBlock(list):
    """The items of a block; a Python worker builds their index once and keeps it with the broadcast block."""

    def index(self, *settings) -> ItemIndex:
        if getattr(self, "built", (None,))[0] != settings:
            self.built = settings, ItemIndex(self, *settings)
        return self.built[1]


def batch_matches(index: ItemIndex, array) -> Iterator[tuple]:
    data, offsets = column(array)
    for i, j in slices(offsets, 1 << 20):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
        for row, *rest in index.matches(words.hashes, words.bounds):
            yield i + row, *rest


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity and distance of the best window of each row and item."""
    spark = docs.sparkSession
    d = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    kind, item_kind = d.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, n_words long, similarity double, distance int"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(ItemBlock(items))  # of block_bytes at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value.index(words, similarity, radius)
            for batch in batches:
                best: dict[tuple, tuple] = {}
                for row, ident, first, n, s, distance in batch_matches(index, batch.column(1)):
                    if (row, ident) not in best or (-s, first) < (-best[row, ident][2], best[row, ident][0]):
                        best[row, ident] = first, n, s, distance
                if best:
                    rows = pa.array([r for r, _ in best])
                    values = list(best.values())
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column(0).take(rows), "item_id": pa.array([i for _, i in best]),
                        "first_word": pa.array([v[0] for v in values], pa.int64()), "n_words": pa.array([v[1] for v in values], pa.int64()),
                        "similarity": pa.array([v[2] for v in values], pa.float64()), "distance": pa.array([v[3] for v in values], pa.int32()),
                    })

        out = out.unionByName(d.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = RADIUS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a window similar to an item."""
    spark, at, names, schema = docs.sparkSession, docs.columns.index(text), docs.columns, docs.schema
    for items in item_blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(ItemBlock(items))  # of block_bytes at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value.index(words, similarity, radius)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in batch_matches(index, batch.column(at)):
                    clean[row] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(clean)).columns, names)

        docs = docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)  # whatever the columns are called
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
