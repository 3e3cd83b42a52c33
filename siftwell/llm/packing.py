"""Best-fit packing with exact complements.

Texts become token ids and an end id; those longer than a sequence are cut into full pieces and a rest. Only the
histogram of piece lengths (at most `capacity` rows per salt) reaches the driver, where a plan is made of patterns,
each with a number of times: an index of single lengths and of the sums of two and three available lengths tells what fills a
gap exactly. Longest first, each length fills the gaps that it closes alone or with one or two shorter ones, as
long as all are available; what finds no such gap goes where it fits best, or opens a sequence. Pieces get a rank within their length in salted
groups, so that a length that holds a third of all pieces is ranked by many tasks, and their place follows from the
rank. Nothing is cut but what exceeds a sequence.

Each step of the plan uses up a length or a group of open sequences, so patterns are a few for each length, and a pattern
has at most 63 different lengths (64 would exceed 2048 tokens): the table of places that is broadcast is bounded
by the capacity, whatever the number of documents.

Defined cases: a null or empty text is one piece with the end id alone; very long texts are encoded whole; repeated rows
are pieces of their own; rows with equal ids, pieces and tokens take their places in any order; an empty table gives no
pieces; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._store import spread, written
from siftwell.llm._text import column
from siftwell.llm._tokens import encoder, tokenizer_path

SALTS = 64


Pattern = tuple[tuple[int, int], ...]  # (length, how often), in the order of their places


class ComplementIndex:
    """Available lengths, and for each sum of two of them the next pair to try; with a third length these are its triples.

    Availability only shrinks, and so does the longest length that may take part, so a pair that was passed over is never
    tried again: for each sum the place is kept where the search goes on. Lengths that are nearly equal come
    first, as the shortest pieces are what fits best later.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.at = [(s + 1) // 2 for s in range(len(left))]

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths up to `most` with this sum, the longer first."""
        at = self.at[total]
        while at <= most and at < total and (not self.left[at] or self.left[total - at] < 1 + (2 * at == total)):
            at += 1
        self.at[total] = at
        return (at, total - at) if at <= most and at < total else None

    def fill(self, gap: int, longest: int) -> tuple[int, ...] | None:
        """One, two or three available lengths, `longest` the longest of them, whose sum is the gap."""
        rest = gap - longest
        if rest == 0:
            return (longest,)
        if rest <= longest and self.left[rest] >= 1 + (rest == longest):
            return (longest, rest)
        two = self.pair(rest, longest) if 1 < rest <= 2 * longest else None
        return (longest, *two) if two and self.left[longest] > two.count(longest) else None

    def take(self, lengths: tuple[int, ...], most: int) -> int:
        """How often the lengths can be taken, `most` at most; they are used up."""
        times = min(most, *(int(self.left[x]) // lengths.count(x) for x in lengths))
        for x in lengths:
            self.left[x] -= times
        return times


def longer(pattern: Pattern, lengths: tuple[int, ...]) -> Pattern:
    out = list(pattern)
    for x in lengths:
        if out and out[-1][0] == x:
            out[-1] = x, out[-1][1] + 1
        else:
            out.append((x, 1))
    return tuple(out)


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, times): longest first, each length fills gaps exactly, alone or with one or two shorter ones, then goes where it fits best."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    index, plan = ComplementIndex(left), []
    if left[capacity]:
        plan.append((((capacity, 1),), int(left[capacity])))
        left[capacity] = 0
    open_: dict[int, list[list]] = defaultdict(list)  # by gap: [pattern, times]
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, pattern: Pattern, times: int) -> None:
        if gap:
            open_[gap].append([pattern, times])
            gaps[gap] = True
        elif times:
            plan.append((pattern, times))

    def grow(gap: int, lengths: tuple[int, ...]) -> None:
        """The lengths into the last opened sequences with this gap, as many as there are of both."""
        pattern, times = open_[gap].pop()
        n = index.take(lengths, times)
        if n < times:
            open_[gap].append([pattern, times - n])
        gaps[gap] = bool(open_[gap])
        put(gap - sum(lengths), longer(pattern, lengths), n)

    for x in range(capacity, 0, -1):
        if not left[x]:
            continue
        for gap in (x + np.flatnonzero(gaps[x : 3 * x + 1])).tolist():
            while left[x] and gaps[gap] and (found := index.fill(gap, x)):
                grow(gap, found)
        while left[x]:
            fits = np.flatnonzero(gaps[x:])
            if len(fits):
                grow(x + int(fits[0]), (x,))
            else:
                each = min(capacity // x, int(left[x]))
                n = int(left[x]) // each
                left[x] -= n * each
                put(capacity - each * x, ((x, each),), n)
    return plan + [(p, n) for bins in open_.values() for p, n in bins]


def places(plan: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, how often in a sequence, first sequence, offset), sorted: pieces of a length take them in rank order."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for x, each in pattern:
            rows.append((x, used[x], each, base, offset))
            used[x] += times * each
            offset += x * each
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, id_col: str, text: str, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """The pieces of each text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            data, offsets = column(batch.column(1))
            row, piece, start, length, crc, all_ids = [], [], [], [], [], []
            for r, ids in enumerate(encode.rows(data, offsets)):
                n = len(ids) + 1
                for k, a in enumerate(range(0, n, capacity)):
                    b = min(n, a + capacity)
                    check = zlib.crc32(ids[a:b].astype("<u4").tobytes())
                    row.append(r), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(b"\0\0\0\0", check) if b == n else check)
                    if with_ids:
                        all_ids.append(np.append(ids[a:b], 0).astype(np.int32) if b == n else ids[a:b].astype(np.int32))
            made = {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                made["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(made)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).mapInArrow(pieces, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = "word_bpe_49k.json", folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each piece with its sequence and its offset there."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")
    pieces = written(token_pieces(docs, id_col, text, capacity, tokenizer_path(tokenizer, folder), with_ids).withColumn("salt", salt), "pieces")
    counts = pieces.groupBy("length", "salt").count().collect()  # at most capacity * SALTS rows
    histogram: dict[int, int] = defaultdict(int)
    before = []
    for length, salt, n in sorted(counts):
        before.append((length, salt, histogram[length]))
        histogram[length] += n
    table = places(packing_plan(histogram, capacity))
    spark = docs.sparkSession
    offsets = spark.createDataFrame(before, "length long, salt int, before long")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within)).join(F.broadcast(offsets), ["length", "salt"])
    extra = ["ids"] * with_ids
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *extra, (F.col("before") + F.col("rank") - 1).alias("rank"))
    if len(table) > 63 * 8 * capacity:  # see above: patterns are a few for each length
        raise ValueError(f"a plan of {len(table)} places for sequences of {capacity}")
    sent = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        ends = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        stride = int(table[:, 1].max(initial=0)) + 1
        key = table[:, 0] * stride + table[:, 1] if len(table) else np.zeros(0, dtype=np.int64)
        for batch in batches:
            length, rank = (np.asarray(batch.column(x)).astype(np.int64) for x in ("length", "rank"))
            at = np.searchsorted(key, length * stride + np.minimum(rank, stride - 1), side="right") - 1
            at = np.maximum(at, ends[length])
            turn, each = rank - table[at, 1], table[at, 2]
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(table[at, 3] + turn // each)).append_column("offset", pa.array(table[at, 4] + turn % each * length))

    id_type = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
