"""MinHash near-duplicates by a multi-index Hamming join, links confirmed on full shingle sets.

A signature has `components` MinHash values of 16 bits; its distance is the number of differing components. Signatures
are split into chunks of four components. Two signatures with a distance of less than twice the number of chunks
have, by the pigeonhole principle, a chunk with at most one differing component; so each chunk is indexed four times, each
time with one component left out, and every such pair meets in at least one bucket. At a Jaccard similarity of exactly
0.8 a pair is beyond that distance (20 or more of 40 components) with a probability of 2.2e-5, less above it.

Rows with the same set are first collapsed into a class. Buckets never emit all their pairs: a few hubs for each bucket
(members with the smallest hash, another for each chunk) are paired with the members; then only members that
are still in different components are compared, in tiles of bounded size, by signature distance; what passes is
confirmed on the full texts, in the tile itself where the bucket is large. So a bucket that holds a third of all rows costs a few pairs for each row, and no
link that joins two components is lost.

Defined cases: without words or text the set is empty and the row is linked with nothing; a row with a null id is
linked with nothing, has a null component and is kept; rows that share an id are one vertex, whatever their texts; repeated
rows get equal results; very long texts are read whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._graph import components
from siftwell.llm._store import discard, spread, written
from siftwell.llm._text import U64, column, mix, shingle_sets

CHUNK = 4
COMPONENTS = 40
#: Members of a tile, and the size of a bucket from which its texts travel to the tile instead of its pairs to the texts.
TILE = 1000
LARGE = 100


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return s[:n, None], s[n:, None] | U64(1)


def signature(shingle_set: np.ndarray, seeds) -> np.ndarray:
    """b-bit MinHash: the top 16 bits of the mixed minimum of each hash function."""
    low = ((shingle_set[None, :] ^ seeds[0]) * seeds[1])
    low ^= low >> U64(29)
    return (mix(low.min(axis=1)) >> U64(48)).astype(np.uint16)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each chunk and each component left out: 6 bits say which, 48 hold the rest."""
    chunks = sig.astype(np.int64).reshape(-1, CHUNK)
    keys = []
    for out in range(CHUNK):
        a, b, c = (chunks[:, i] for i in range(CHUNK) if i != out)
        keys.append((np.arange(len(chunks)) * CHUNK + out) << 48 | a << 32 | b << 16 | c)
    return np.stack(keys, axis=1).ravel()


def signatures(docs: DataFrame, k: int, n: int) -> DataFrame:
    """doc_id, n_shingles, two sums that tell sets apart, and the signature, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(n)
        for batch in batches:
            data, offsets = column(batch.column(1))
            size, a, b, sigs = [], [], [], []
            for s in shingle_sets(data, offsets, k):
                size.append(len(s))
                a.append(int(mix(s ^ U64(0x5EED)).sum().view(np.int64)))
                b.append(int(mix(s + U64(0xBEEF)).sum().view(np.int64)))
                sigs.append(signature(s, seeds).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_shingles": pa.array(size, pa.int64()), "s1": pa.array(a, pa.int64()), "s2": pa.array(b, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long, sig binary")


def bucketed(reps: DataFrame) -> DataFrame:
    """(key, node): a row for each bucket of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = [bucket_keys(np.frombuffer(s, dtype=np.uint16)) for s in batch.column(1).to_pylist()]
                rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in keys])
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "node": batch.column(0).take(pa.array(rows))})

    return reps.select("node", "sig").mapInArrow(run, f"key long, node {reps.schema['node'].dataType.simpleString()}")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full shingle sets."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_sets(*column(batch.column(c)), k) for c in (2, 3)]
            good = []
            for x, y in zip(*sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def first_bucket(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The first bucket that a signature shares with each of the others (which share one)."""
    equal = (others == sig).reshape(len(others), -1, CHUNK)
    n = equal.sum(axis=2)
    chunk = (n >= CHUNK - 1).argmax(axis=1)
    there = np.arange(len(others)), chunk
    return chunk * CHUNK + np.where(n[there] == CHUNK, 0, equal[there].argmin(axis=1))


def close_in_tiles(members: DataFrame, most: int, k: int, percent: int) -> DataFrame:
    """(x, y, sure): pairs of members of a tile in different components whose signatures differ in at most `most`
    components, each in the first bucket that it shares only.

    members: key, t1, t2, node, comp, sig, side (0: both, 1 or 2: only compared with the other side) and text, dealt by
    tile and sorted by it, so a tile is a run of rows. Where texts are given, pairs are confirmed here and then `sure`,
    and only links that join two components of the tile are returned: fewer than the tile has members.
    """
    kind = members.schema["node"].dataType.simpleString()

    def tile(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp = t.column("node").combine_chunks(), t.column("comp").combine_chunks()
        code = comp.dictionary_encode().indices.to_numpy().copy()
        side, bucket = t.column("side").to_numpy(), t.column("key")[0].as_py() >> 48
        sig = np.stack([np.frombuffer(s, dtype=np.uint16) for s in t.column("sig").to_pylist()])
        texts = t.column("text").combine_chunks()
        sets = None if texts.null_count else list(shingle_sets(*column(texts), k))
        x: list[int] = []
        y: list[int] = []
        for i in range(len(sig) - 1):
            ok = (code[i + 1 :] != code[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0))
            j = np.flatnonzero(ok) + i + 1
            distance = (sig[j] != sig[i]).sum(axis=1)
            near = np.flatnonzero(distance <= most)
            j = j[near[np.argsort(distance[near], kind="stable")]]
            j = j[first_bucket(sig[i], sig[j]) == bucket] if len(j) else j
            if sets is None:
                x += [i] * len(j)
                y += j.tolist()
                continue
            for o in j.tolist():
                if code[o] == code[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[o], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[o]) - both):
                    x.append(i)
                    y.append(o)
                    code[code == code[o]] = code[i]
        if x:
            yield pa.RecordBatch.from_pydict({"x": node.take(pa.array(x)), "y": node.take(pa.array(y)), "sure": pa.array([sets is not None] * len(x))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = np.stack([table.column(c).to_numpy() for c in ("key", "t1", "t2")])
            cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), table.num_rows], strict=True):
                if b - a > 1:
                    yield from tile(table.slice(a, b - a))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "t1", "t2")])
            changes = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
            table = pa.Table.from_batches([batch])
            same = last is not None and (ids[:, 0] == last).all()
            if held and not same:
                yield from done(pa.concat_tables(held))
                held = []
            cut = int(changes[-1]) if len(changes) else 0
            if cut:
                yield from done(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            held.append(table.slice(cut))
            last = ids[:, -1].copy()
        if held:
            yield from done(pa.concat_tables(held))

    return members.select("key", "t1", "t2", "node", "comp", "sig", "side", "text").mapInArrow(run, f"x {kind}, y {kind}, sure boolean")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, n: int = COMPONENTS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    if n % CHUNK or not 0 < percent <= 100:
        raise ValueError("components come in chunks of four; percent lies in 1..100")
    most = 2 * (n // CHUNK) - 1
    made: list[DataFrame] = []  # tables that the result does not read

    def held(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sigs = written(signatures(spread(docs), words, n), "signatures")
    linkable = sigs.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = ["n_shingles", "s1", "s2"]
    classes = written(linkable.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    reps = (
        linkable.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", *same])
        .select(F.col("doc_id").alias("node"), "sig").distinct()
    )
    reps = held(reps, "representatives")
    keys = bucketed(reps)
    # counts and choices by bucket are written: a join of written tables is one that adaptive execution can split by key
    shared = held(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "shared")
    hits = held(keys.join(shared, "key").select("key", "n", "node"), "buckets")

    # hubs: in buckets of one chunk the same order, so a homogeneous group has one hub for each chunk
    order = F.struct(F.xxhash64("node", F.shiftright("key", 50)).alias("h"), F.col("node").alias("hub"))
    hubs = held(hits.groupBy("key").agg(F.min(order)["hub"].alias("hub")), "hubs")
    stars = hits.join(hubs, "key").filter(F.col("node") != F.col("hub")).select(*ordered("hub", "node")).distinct()
    stars = held(stars, "stars")
    nodes = hits.select("node").distinct()
    texts = docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    texts = held(texts.select(F.col("doc_id").alias("node"), "text"), "texts")
    # an id with several sets links their classes
    several = linkable.join(held(sigs.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).filter("lo != hi").select("doc_id"), "several"), "doc_id", "left_semi")
    own = several.join(classes, same).select(*ordered("doc_id", "node")).filter("a != b")
    links = held(confirmed(stars, texts, words, percent).unionByName(own), "star-links")
    labels = components(links)

    # what hubs did not settle: members of a bucket in different components, compared in tiles
    member = held(hits.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "members")
    # the members of a bucket's largest component are compared with the others only, not among themselves
    each = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_ = each.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("m")).filter("comps > 1")
    open_ = held(open_.select("key", "all", F.col("m.c").alias("most"), F.col("m.comp").alias("major")), "open")
    left = member.join(open_, "key").join(reps, "node")
    split = F.col("all") > TILE  # what fits in a tile is one
    major = split & (F.col("comp") == F.col("major"))
    others = F.when(split, F.ceil((F.col("all") - F.col("most")) / TILE)).otherwise(1).cast("int")
    majors = F.when(split, F.ceil(F.col("most") / TILE)).otherwise(0).cast("int")
    mine = F.when(major, others + F.pmod(F.xxhash64("node"), F.greatest(majors, F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), others)).cast("int")
    left = left.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(major, others).otherwise(others + majors) - 1)))
    left = left.select("key", "n", "node", "comp", "sig", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"),
                       F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"))
    left = held(left, "open-buckets")
    few = left.filter(F.col("n") <= LARGE).withColumn("text", F.lit(None).cast("string"))
    many = left.filter(F.col("n") > LARGE).join(texts, "node")
    dealt = few.unionByName(many).repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    found = held(close_in_tiles(dealt, most, words, percent), "rest")
    rest = found.filter(~F.col("sure")).select(*ordered("x", "y")).distinct().join(stars, ["a", "b"], "left_anti")
    more = confirmed(rest, texts, words, percent).unionByName(found.filter("sure").select(*ordered("x", "y")))
    more = held(more, "rest-links")
    labels = components(links.unionByName(more))
    for table in made:
        discard(table)

    out = sigs.join(classes, same, "left").withColumn("node", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("node", "doc_id"))).join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
