"""Removal of repeated byte strings by prefix-free parsing, ordered only as deep as the strings are long.

A rolling hash of eight bytes triggers phrases: a position is a trigger if its hash is the least of a run of
`length - 72` positions, so triggers depend on local content alone, equal strings are parsed equally, and no string of
`length` bytes is without one (its anchor). A suffix starts with the rest of its phrase up to the anchor and goes on
with what the parse holds there. To find suffixes that share `length` bytes, corpus order is needed to that depth
only; so the classes of the dictionary (all starts that share an anchor) and of the parse (what follows an anchor) are
combined by grouping instead of one global array, which no single machine could hold:

1. anchors are grouped by the 73 bytes that every string through them shares; an anchor seen once has no repeats,
2. anchors with equal whole contexts (first start to last end) repeat for all their starts at once,
3. where one anchor has several contexts, its starts are cut into groups of sixteen by their distance from the anchor,
   and each group is treated as an anchor of its own: dropped if what all its strings share stands once, done if its
   context repeats, else cut again, into single starts. Of equal contexts only one goes on.

Groups are counted with partial sums; a passage that a third of all documents share costs one row for each place in the
first count and one for each of its contexts in the joins, which adaptive execution deals to several tasks. Texts are read whole; a text travels only when its own starts are compared and when it is cut.

Defined cases: a null or empty text has no bytes and no spans; texts shorter than `length` have no spans; repeated
rows are copies of each other, so all of them lose what they share; very long texts are read whole; a null id is a value
like any other; an empty table gives no rows; other columns are not read by `remove_repeats` and pass through `cut_repeats`. `cut_text` removes whole characters only, so what is left is valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._names import fresh
from siftwell.llm._store import discard, release, spread, written
from siftwell.llm._text import U64, Rolling, column, mix, slices

GRAM = 8
CORE = 73
SHAPE = "k long, c long, r1 long, r2 int, lo int, hi int, t int, rep boolean"


def gram_keys(data: np.ndarray) -> np.ndarray:
    """At each position the hash of the next eight bytes (33 bits) over the position itself (31 bits)."""
    n = len(data)
    padded = np.zeros(n + 2 * GRAM, dtype=np.uint8)
    padded[:n] = data
    grams = np.empty(n + GRAM, dtype=np.uint64)
    for i in range(GRAM):
        part = padded[i:]
        whole = np.frombuffer(part[: len(part) // GRAM * GRAM].tobytes(), dtype="<u8")
        into = grams[i::GRAM]
        into[:] = whole[: len(into)]
    grams = grams[:n]
    grams = (grams ^ (grams >> U64(29))) * U64(0x9E3779B97F4A7C15)
    grams ^= grams >> U64(32)
    grams *= U64(0xD6E8FEB86659FD93)
    return (grams & U64(0xFFFFFFFF80000000)) | np.arange(n, dtype=np.uint64)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of each run of starts with one anchor; starts have `length` bytes in their row."""
    width = length - CORE + 1
    low = gram_keys(data)
    have, step = 1, 1
    while have < width:  # the least of `have` positions, doubled until it spans the width
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(data)) + length <= ends)
    if not len(starts):
        return starts, starts, starts
    anchor = (low[starts] & U64(0x7FFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(starts)) - 1
    return anchor[first], starts[first], starts[last]


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, text and two hashes that name the row; rows with equal ids and texts share them and are equal anyway."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return d.withColumn("r1", F.xxhash64("doc_id", "text")).withColumn("r2", F.hash("text", "doc_id"))


def anchors(rows: DataFrame, length: int) -> DataFrame:
    """For each anchor the hashes of its core and its context, its row, its starts and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(2))
            for i, j in slices(offsets, 1 << 20):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                t, lo, hi = anchor_runs(part, at, length)
                if not len(t):
                    continue
                rolling = Rolling(part)
                c = mix(rolling.of(lo, hi + length) + (t - lo).astype(np.uint64) * U64(0xFF51AFD7ED558CCD))
                row = np.searchsorted(at, lo, side="right") - 1
                take = pa.array(row + i)
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array(rolling.of(t, t + CORE).view(np.int64)), "c": pa.array(c.view(np.int64)),
                    "r1": batch.column(0).take(take), "r2": batch.column(1).take(take),
                    "lo": pa.array((lo - at[row]).astype(np.int32)), "hi": pa.array((hi - at[row]).astype(np.int32)),
                    "t": pa.array((t - at[row]).astype(np.int32)), "rep": pa.array(np.zeros(len(t), dtype=bool)),
                })

    return rows.select("r1", "r2", "text").mapInArrow(run, SHAPE)


def finer(rows: DataFrame, length: int, grid: int) -> DataFrame:
    """The listed runs of each text in groups of at most `grid` starts, by distance from the anchor; columns as of anchors()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(2))
            runs = batch.column(3)
            fields = [runs.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi", "t", "k", "rep")]
            bounds = np.concatenate([[0], np.cumsum(np.array([len(x) for x in runs], dtype=np.int64))])
            for r in range(batch.num_rows):
                lo, hi, t, k, rep = (f[bounds[r] : bounds[r + 1]] for f in fields)
                rolling = Rolling(data[offsets[r] : offsets[r + 1]], 1)
                near, far = (t - hi) // grid, (t - lo) // grid
                n = (far - near + 1).astype(np.int64)
                of = np.repeat(np.arange(len(n)), n)
                g = near[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                last, first = np.minimum(hi[of], t[of] - g * grid), np.maximum(lo[of], t[of] - (g + 1) * grid + 1)
                shared = rolling.of(t[of] - g * grid, t[of] - (g + 1) * grid + 1 + length)
                key = mix(k[of].view(np.uint64) + g.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) ^ shared
                context = mix(rolling.of(first, last + length) + (t[of] - first).astype(np.uint64) * U64(0xFF51AFD7ED558CCD))
                each = pa.array(np.full(len(of), r))
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array(key.view(np.int64)), "c": pa.array(context.view(np.int64)), "r1": batch.column(0).take(each), "r2": batch.column(1).take(each),
                    "lo": pa.array(first.astype(np.int32)), "hi": pa.array(last.astype(np.int32)), "t": pa.array(t[of].astype(np.int32)), "rep": pa.array(rep[of].astype(bool)),
                })

    return rows.select("r1", "r2", "text", "runs").mapInArrow(run, SHAPE)


def repeated_ranges(rows: DataFrame, length: int) -> DataFrame:
    """(r1, r2, ranges): for each row with repeats the ranges (a, b) of bytes that repeated strings cover."""
    if length < CORE + GRAM:
        raise ValueError(f"strings are {CORE + GRAM} bytes at least")
    every, done = anchors(spread(rows), length), []
    for grid in (16, 1, 0):
        every = written(every, "anchors")
        # written on its own, so that the join is one of two tables, which adaptive execution can split by anchor
        again = written(every.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("k"), "again")
        some = written(every.join(again, "k", "left_semi"), "anchors-again")
        discard(every)
        discard(again)
        one = F.min(F.struct("r1", "r2", "lo", "hi", "t", "rep")).alias("one")
        contexts = written(some.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), one), "contexts")
        release(rows.sparkSession)
        whole = some.filter(~F.col("rep")).join(contexts.filter(F.col("n") > 1).select("k", "c"), ["k", "c"], "left_semi")
        done.append(whole.select("r1", "r2", F.col("lo").alias("a"), (F.col("hi") + length).alias("b")))
        if not grid:
            break
        several = written(contexts.groupBy("k").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") > 1).select("k"), "several")
        run = F.struct("one.lo", "one.hi", "one.t", "k", (F.col("one.rep") | (F.col("n") > 1)).alias("rep")).alias("run")
        runs = contexts.join(several, "k", "left_semi").select("one.r1", "one.r2", run)
        runs = runs.groupBy("r1", "r2").agg(F.collect_list("run").alias("runs"))  # no more than the text has bytes
        every = finer(rows.join(runs, ["r1", "r2"]), length, grid)
    found = done[0].unionByName(done[1]).unionByName(done[2])
    found = written(found.groupBy("r1", "r2").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    release(rows.sparkSession)
    return found


def removed_mask(n: int, ranges) -> np.ndarray:
    depth = np.zeros(n + 1, dtype=np.int64)
    if ranges is not None and len(ranges):
        a, b = (ranges.field(f).to_numpy(zero_copy_only=False) for f in ("a", "b"))
        np.add.at(depth, a, 1)
        np.add.at(depth, b, -1)
    return np.cumsum(depth)[:n] > 0


def each_mask(batch: pa.RecordBatch, text: int, ranges: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = column(batch.column(text))
    for r in range(batch.num_rows):
        part = data[offsets[r] : offsets[r + 1]]
        yield part, removed_mask(len(part), batch.column(ranges)[r].values)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256: bytes covered by a string that also starts elsewhere go."""
    rows = keyed(docs, id_col, text)
    found = repeated_ranges(rows, length)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(part), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()), hashlib.sha256(part[~gone].tobytes()).hexdigest()) for part, gone in each_mask(batch, 1, 2)]
            made = {"doc_id": batch.column(0)} | {name: pa.array([x[c] for x in out], kind) for c, (name, kind) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))}
            yield pa.RecordBatch.from_pydict(made)

    joined = rows.join(found, ["r1", "r2"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """docs with repeated strings cut from `text`, by whole characters; a null text stays null."""
    name = f"`{text}`"
    keys = F.xxhash64(F.col(f"`{id_col}`"), F.col(name)), F.hash(F.col(name), F.col(f"`{id_col}`"))
    r1, r2, ranges = fresh(docs, "r1", "r2", "ranges")
    found = repeated_ranges(keyed(docs, id_col, text), length).toDF(r1, r2, ranges)
    joined = docs.withColumn(r1, keys[0]).withColumn(r2, keys[1]).join(found, [r1, r2], "left").drop(r1, r2)
    at, ranges_at, names = joined.columns.index(text), joined.columns.index(ranges), docs.columns
    joined = joined.toDF(*[f"c{i}" for i in range(len(joined.columns))])  # whatever the columns are called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r, (part, gone) in enumerate(each_mask(batch, at, ranges_at)):
                if not gone.any():
                    texts.append(batch.column(at)[r].as_py())
                    continue
                inner = (part & 0xC0) == 0x80  # a character goes only if all its bytes do
                head = np.flatnonzero(~inner)
                whole = np.logical_and.reduceat(gone, head)
                texts.append(part[~np.repeat(whole, np.diff(np.append(head, len(part))))].tobytes().decode())
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(batch.num_columns) if c != ranges_at]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
