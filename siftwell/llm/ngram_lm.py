"""Deleted interpolation: maximum-likelihood estimates of each n-gram order mixed by weights of context-frequency buckets.

p(w | h) = sum over orders k of a_k(b) c(h_k w) / c(h_k) + z(b) / (V + 1), where h_k are the last k - 1 tokens and b tells the
longest of these contexts that was seen and the binary order of magnitude of its count. The weights maximise the
likelihood of held-out counts by expectation-maximisation: of the training documents those of fold 0 are deleted, the
other folds are counted, and the deleted ones' tokens are the held-out data; scores then use the counts of all
training documents. Counts, held-out statistics and scores cover all documents; nothing is cut off.

Documents are packed into blocks. A block sends the sorted keys of its n-grams with their counts in 256 ranges of the
keys; a node of the tree above adds up one range of its blocks (2048 at most) and sends that on to the node above it, cut
into 2048 ranges more. The root holds a range's totals over the corpus; they go back the same way, at each node
in the order of each child's keys. So the size of a message and of a task's work do not grow with the corpus, and
what is moved grows in proportion to it, times the levels of the tree (one up to 2048 blocks, three up to 8 billion).
A frequent n-gram costs one entry for each block. N-grams are told apart by 63-bit hashes.

Defined cases: null and empty texts have one token, the end; a very long text is a block of its own, read whole; a null
id counts as an empty one for its fold; without training documents every estimate but the uniform one is 0 and the scores
stay finite; repeated rows count twice and get equal scores; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._blocks import text_blocks, unpack_table
from siftwell.llm._store import LARGE_ROWS, discard, spread, written
from siftwell.llm._text import U64, Words, column, mix, slices

FOLDS, HELD_OUT, DELETED = 5, 1, 0
END, BEGIN = U64(0x0E0D), U64(0xBE61)
MAGNITUDES = 40
BLOCK_BYTES = 1 << 20
#: Bits of the ranges of a block, and of the children and ranges of a node.
FIRST, FAN = 8, 11
MESSAGE = "child long, parent long, range long, n long, keys binary, kept binary, deleted binary"
ANSWER = "child long, range long, n long, kept binary, deleted binary, tokens long, types long, kept_tokens long"


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, compressed: small numbers cost little."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


class BlockTokens:
    """Tokens of a block: for each order the distinct keys of its n-grams, sorted, and the place there of each token's."""

    def __init__(self, raw: bytes, order: int):
        table = unpack_table(raw)
        self.ids, self.fold = table.column("doc_id"), table.column("fold").to_numpy()
        data, offsets = column(table.column("text"))
        hashes, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for i, j in slices(offsets, 1 << 20):  # the arrays of a slice are many times its bytes
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashes.append(np.insert(words.hashes, words.bounds[1:], END))
            sizes.append(np.diff(words.bounds) + 1)
        del data, offsets, table
        tokens = np.concatenate(hashes)
        del hashes
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.n = len(tokens)
        self.keys: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        gram, earlier = tokens.copy(), tokens
        for k in range(1, order + 1):
            if k > 1:  # the token k - 1 before this one; a text is preceded by begins
                shifted = np.empty_like(earlier)
                shifted[1:] = earlier[:-1]
                shifted[self.bounds[:-1]] = BEGIN
                earlier = shifted
                gram = mix(gram) * U64(0xFF51AFD7ED558CCD) + earlier
            keys, back = np.unique(mix(gram + U64(k)) & ~U64(1) | U64(k > 1), return_inverse=True)
            self.keys.append(keys)
            self.places.append(back.astype(np.int32))
        self.end = int(np.searchsorted(self.keys[0], mix(np.array([END]) + U64(1)) & ~U64(1))[0])

    def counts(self, folds) -> np.ndarray:
        """How often each key, order by order, stands in documents of the given folds."""
        take = np.repeat(np.isin(self.fold, folds), np.diff(self.bounds))
        return np.concatenate([np.bincount(place[take], minlength=len(keys)) for place, keys in zip(self.places, self.keys, strict=True)])

    def estimates(self, counts: np.ndarray) -> np.ndarray:
        """For each token, from the highest order down, the counts of its n-gram and of that one's context; last its own count."""
        out, at = [], 0
        each = []
        for place, keys in zip(self.places, self.keys, strict=True):
            each.append(counts[at : at + len(keys)][place])
            at += len(keys)
        ends = counts[self.end]
        for k in range(len(each) - 1, 0, -1):
            before = np.empty_like(each[k - 1])
            before[1:] = each[k - 1][:-1]
            before[self.bounds[:-1]] = ends  # the begin of a text is a context as often as there are ends
            out += [each[k], before]
        return np.stack([*out, each[0]])


def messages(child: int, parent: int, above: int, bits: int, cut: int, keys: np.ndarray, kept: np.ndarray, deleted: np.ndarray) -> pa.RecordBatch:
    """The sorted keys of a node (those below `above`, the range of the highest `bits` bits) with their counts, in 2**cut ranges."""
    top = (keys >> U64(64 - bits - cut)).astype(np.int64)
    first = above << cut
    cuts = np.searchsorted(top, np.arange(first, first + (1 << cut) + 1))
    rows = []
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if b > a:
            rows.append((child, parent, first + i, b - a, squeeze(np.diff(keys[a:b], prepend=U64(0))), squeeze(kept[a:b]), squeeze(deleted[a:b])))
    kinds = [pa.int64()] * 4 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], kind) for c, kind in enumerate(kinds)], ["child", "parent", "range", "n", "keys", "kept", "deleted"])


def sent_counts(blocks: DataFrame, order: int, fan: int, bits: int) -> DataFrame:
    """The messages of all blocks; a block's node is told by the highest bits of the hash of its number."""
    kept = [f for f in range(FOLDS) if f not in (HELD_OUT, DELETED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.column(0)[r].as_py()
                t = BlockTokens(batch.column(1)[r].as_py(), order)
                k, d, keys = t.counts(kept), t.counts([DELETED]), np.concatenate(t.keys)
                del t
                mine = np.argsort(keys)
                parent = int(mix(np.array([block], dtype=np.uint64))[0]) >> (64 - bits) >> fan
                yield messages(block, parent, 0, 0, FIRST, keys[mine], k[mine], d[mine])

    return blocks.mapInArrow(run, MESSAGE)


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the messages of one range: distinct keys, the place there of each key sent, totals of both counts, bounds of the messages."""
    n = table.column("n").to_numpy()
    read = lambda c: [unsqueeze(x, m) for x, m in zip(table.column(c).to_pylist(), n, strict=True)]
    distinct, back = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read("keys")]), return_inverse=True)
    totals = []
    for c in ("kept", "deleted"):
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, back, np.concatenate(read(c)).astype(np.int64))
        totals.append(total)
    return distinct, back, totals, np.concatenate([[0], np.cumsum(n)])


def answers(table: pa.Table, back: np.ndarray, totals: list[np.ndarray], cuts: np.ndarray, whole: tuple[int, int, int]) -> pa.Table:
    """The totals for each message in the order of its keys, and a row (child -1) with a range's own N, V and N without deleted ones."""
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    columns = [[*table.column("child").to_pylist(), -1], [*table.column("range").to_pylist(), -1], [*[b - a for a, b in spans], 0]]
    columns += [[*[squeeze(t[back[a:b]]) for a, b in spans], None] for t in totals] + [[0] * len(spans) + [x] for x in whole]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 3
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["child", "range", "n", "kept", "deleted", "tokens", "types", "kept_tokens"])


def corpus_counts(sent: DataFrame, fan: int, bits: int) -> DataFrame:
    """The answers to the messages of the blocks: up the tree to the root and back. bits: of block numbers' hashes."""
    levels, depth = [sent], 1

    def upward(at: int):
        def up(table: pa.Table) -> pa.Table:
            distinct, _, totals, _ = summed(table)
            node, above = table.column("parent")[0].as_py(), table.column("range")[0].as_py()
            return pa.Table.from_batches([messages(node, node >> fan, above, at, fan, distinct, *totals)])

        return up

    while bits > depth * fan:  # not yet the root
        levels[-1] = written(levels[-1], "messages", LARGE_ROWS)  # read once more on the way back
        levels.append(levels[-1].groupBy("parent", "range").applyInArrow(upward(FIRST + (depth - 1) * fan), MESSAGE))
        depth += 1

    def root(table: pa.Table) -> pa.Table:
        distinct, back, totals, cuts = summed(table)
        one = (distinct & U64(1)) == 0
        train = (totals[0] + totals[1])[one]
        return answers(table, back, totals, cuts, (int(train.sum()), int((train > 0).sum()), int(totals[0][one].sum())))

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        _, back, _, cuts = summed(table)
        order = np.argsort(above.column("range").to_numpy())
        n, totals = above.column("n").to_numpy(), []
        for c in ("kept", "deleted"):
            raw = above.column(c).to_pylist()
            totals.append(np.concatenate([unsqueeze(raw[i], n[i]) for i in order]).astype(np.int64))
        return answers(table, back, totals, cuts, (0, 0, 0))

    found = written(levels.pop().groupBy("parent", "range").applyInArrow(root, ANSWER), "totals", LARGE_ROWS)
    while levels:
        below, before = levels.pop(), found
        above = before.filter("child >= 0").select(F.col("child").alias("parent"), F.shiftright("range", fan).alias("up"), "range", "n", "kept", "deleted")
        told = below.groupBy("parent", "range").cogroup(above.groupBy("parent", "up")).applyInArrow(down, ANSWER)
        whole = before.filter("child < 0").groupBy("child", "range").agg(F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("binary").alias(c) for c in ("kept", "deleted")], *[F.sum(c).alias(c) for c in ("tokens", "types", "kept_tokens")])
        found = written(told.unionByName(whole), "totals", LARGE_ROWS)
        discard(below)
        discard(before)
    return found


def token_counts(blocks: DataFrame, totals: DataFrame, id_type: str, order: int) -> DataFrame:
    """The counts of each document's tokens; for each block (is_stats) its held-out statistics."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = BlockTokens(left.column("docs")[0].as_py(), order)
        mine, order_of, n, sums = np.argsort(np.concatenate(t.keys)), np.argsort(right.column("range").to_numpy()), right.column("n").to_numpy(), []
        for c in ("kept", "deleted"):
            raw, total = right.column(c).to_pylist(), np.empty(len(mine), dtype=np.int64)
            total[mine] = np.concatenate([unsqueeze(raw[i], n[i]) for i in order_of])
            sums.append(total)
        kept, train = sums[0], sums[0] + sums[1]
        held = np.flatnonzero(np.repeat(t.fold == DELETED, np.diff(t.bounds)))
        h = t.estimates(kept)[:, held].T
        stats, times = np.unique(h, axis=0, return_counts=True) if len(h) else (h, np.zeros(0, dtype=np.int64))
        del h, held
        found = t.estimates(train)
        spans = list(zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True))
        rows = len(spans)
        return pa.table({
            "doc_id": pa.chunked_array([*t.ids.chunks, pa.nulls(1, t.ids.type)]),
            "held_out": pa.array([*(t.fold == HELD_OUT).tolist(), None], pa.bool_()),
            "n_tokens": pa.array([*[b - a for a, b in spans], len(stats)], pa.int64()),
            "is_stats": pa.array([False] * rows + [True]),
            "counts": pa.array([*[squeeze(found[:, a:b].ravel()) for a, b in spans], squeeze(np.concatenate([*stats.T, times]).astype(np.uint64))], pa.binary()),
        })

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, is_stats boolean, counts binary"
    return blocks.groupBy("block").cogroup(totals.groupBy("child")).applyInArrow(run, schema)


def bucket_of(found: np.ndarray) -> np.ndarray:
    """0 without a context that was seen; else the order of the longest one and the binary magnitude of its count, as a number."""
    bucket = np.zeros(found.shape[1], dtype=np.int64)
    for k, context in enumerate(found[-2:0:-2], 2):  # longer contexts later, so the longest that was seen stands
        bucket = np.where(context > 0, 1 + (k - 2) * MAGNITUDES + np.minimum(MAGNITUDES, np.frexp(context)[1]) - 1, bucket)
    return bucket


def mixture_parts(found: np.ndarray, n: int, v: int) -> np.ndarray:
    """A row for each token: the estimates of all orders, highest first, and the uniform one."""
    high = [np.divide(c, h, out=np.zeros_like(c), where=h > 0) for c, h in zip(found[:-1:2], found[1::2], strict=True)]
    return np.stack([*high, found[-1] / max(n, 1), np.full_like(found[-1], 1 / (v + 1))], axis=1)


def learn_weights(stats: DataFrame, order: int, n: int, v: int, rounds: int = 30, tolerance: float = 1e-5) -> np.ndarray:
    """Mixture weights (orders from the highest, uniform) of each bucket by expectation-maximisation over all held-out counts.

    Each round is a map over the written statistics; a task returns one sum for each bucket and weight."""
    size = 1 + (order - 1) * MAGNITUDES
    seen = np.concatenate([[1], np.repeat(np.arange(2, order + 1), MAGNITUDES)])  # the highest order a bucket has estimates of
    allowed = np.concatenate([np.arange(order, 0, -1)[None, :] <= seen[:, None], np.ones((size, 1), dtype=bool)], axis=1).astype(float)
    weights = allowed / allowed.sum(axis=1, keepdims=True)
    before = None
    for _ in range(rounds):
        sent = weights.copy()

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums, likelihood, tokens = np.zeros_like(sent), 0.0, 0
            for batch in batches:
                for m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    *found, times = unsqueeze(raw, 2 * order * m).astype(np.float64).reshape(2 * order, m)
                    found = np.stack(found)
                    b = bucket_of(found)
                    parts = sent[b] * mixture_parts(found, n, v)
                    p = parts.sum(axis=1)
                    parts *= (times / p)[:, None]
                    for c in range(order + 1):
                        sums[:, c] += np.bincount(b, weights=parts[:, c], minlength=size)
                    likelihood += float((times * np.log(p)).sum())
                    tokens += int(times.sum())
            yield pa.RecordBatch.from_pydict({"b": pa.array([*range(size), -1], pa.int32()), **{f"s{c}": pa.array([*sums[:, c].tolist(), (likelihood, float(tokens), *[0.0] * order)[c]]) for c in range(order + 1)}})

        schema = "b int, " + ", ".join(f"s{c} double" for c in range(order + 1))
        got = stats.mapInArrow(expect, schema).groupBy("b").agg(*[F.sum(f"s{c}") for c in range(order + 1)]).collect()  # size + 1 rows
        by = {r[0]: np.array(r[1:]) for r in got}
        likelihood, tokens = by.pop(-1, np.zeros(order + 1))[:2]
        for b, s in by.items():
            if s.sum() > 0:
                weights[b] = (s + 1e-3 * allowed[b]) / (s.sum() + 1e-3 * allowed[b].sum())
        if not tokens or before is not None and (likelihood - before) / tokens < tolerance:
            break
        before = likelihood
    return weights


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = 2, block_bytes: int = BLOCK_BYTES, fan: int = FAN, rounds: int = 30) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document. 2**fan: children of a node."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    ident = F.col(f"`{id_col}`")
    fold = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    rows = docs.select(ident.alias("doc_id"), fold.alias("fold"), F.col(f"`{text}`").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    blocks = text_blocks(spread(rows), block_bytes)
    bits = max(fan, (blocks.select("block").count() - 1).bit_length())
    totals = corpus_counts(sent_counts(blocks, order, fan, bits), fan, bits)
    whole = totals.filter("child < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "kept_tokens")]).first()
    n_train, n_types, n_kept = (int(x) for x in whole)
    told = totals.filter("child >= 0").select("child", "range", "n", "kept", "deleted")
    tokens = written(token_counts(blocks, told, id_type, order), "token-counts", LARGE_ROWS)
    discard(blocks)
    discard(totals)
    stats = written(tokens.filter("is_stats").select("n_tokens", "counts"), "held-out-counts", LARGE_ROWS)
    weights = learn_weights(stats, order, n_kept, n_types, rounds)
    discard(stats)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, base, scores = [], [], []
            for m, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = unsqueeze(raw, (2 * order - 1) * m).astype(np.float64).reshape(2 * order - 1, m)
                p = (weights[bucket_of(found)] * mixture_parts(found, n_train, n_types)).sum(axis=1)
                known.append(int((found[-1] > 0).sum()))
                base.append(float(np.log10((found[-1] + 0.5) / (n_train + 0.5 * (n_types + 1))).sum()))
                scores.append(float(np.log10(p).sum()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(1), "n_tokens": batch.column(2), "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([n_train] * len(scores), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64()),
            })

    kept = tokens.filter(~F.col("is_stats")).select("doc_id", "held_out", "n_tokens", "counts")
    return kept.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
