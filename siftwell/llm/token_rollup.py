"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch is a set of changes: inserts count texts positively, deletes negatively, revisions both ways. Each task adds up
its own signed counts, so a shuffle moves one row for each task and group, however large a source is. Changes carry texts,
or counts kept from an earlier count: a deleted or revised document then needs neither its text nor its tokenizer. A batch is
committed by renaming its written deltas to a folder named by its id; a batch that is already there, and a second
attempt that loses the race, change nothing. Totals are sums over committed batches, so the order of commits does not matter.

`compact` folds them into a snapshot, so that totals need not read every batch for ever. The rename has to be atomic, as it
is on HDFS and local disks; on an object store without it, writers of one id must be kept apart by other means.

Defined cases: a null or empty text has no tokens and counts as a document; null sources and languages are groups of
their own; repeated rows count each; a batch without changes commits an empty set; an id that was committed is ignored,
whatever it brings; very long texts are counted whole; groups whose documents and tokens are all zero are left out of
the totals; an empty table has no totals; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._store import new_path, spread, written
from siftwell.llm._text import Words, column, slices
from siftwell.llm._tokens import encoder, tokenizer_path

GROUP = ["source", "lang", "tokenizer"]
SHAPE = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Versions and the files of their tokenizers; None counts white-space words.
TOKENIZERS = {"words-1": None, "word_bpe_49k-1": "word_bpe_49k.json"}


def word_counts(data, offsets) -> list[int]:
    out: list[int] = []
    for i, j in slices(offsets, 1 << 20):
        bounds = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).bounds
        out += (bounds[1:] - bounds[:-1]).tolist()
    return out


def deltas(changes: DataFrame, tokenizers: dict[str, str | None] | None = None, folder: str | None = None) -> DataFrame:
    """Signed counts of changes (source, lang, sign, and text or counts); counts bring their own versions."""
    if "counts" in changes.columns:
        each = changes.select("source", "lang", "sign", F.explode("counts").alias("tokenizer", "n"))
        return each.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))
    versions = {k: v and tokenizer_path(v, folder) for k, v in (TOKENIZERS if tokenizers is None else tokenizers).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            source, lang, sign = (batch.column(c).to_pylist() for c in (0, 1, 3))
            data, offsets = column(batch.column(2))
            for version, path in versions.items():
                n = word_counts(data, offsets) if path is None else encoder(path).counts(data, offsets).tolist()
                for s, la, d, x in zip(source, lang, sign, n, strict=True):
                    total = sums[s, la, version]
                    total[0] += d
                    total[1] += d * x
        if sums:
            columns = [[k[c] for k in sums] for c in range(3)] + [[v[c] for v in sums.values()] for c in range(2)]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [*GROUP, "n_docs", "n_tokens"])

    counted = changes.select("source", "lang", "text", F.col("sign").cast("int").alias("sign")).mapInArrow(run, SHAPE)
    return counted.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, keep: tuple[str, ...] = (), tokenizers: dict[str, str | None] | None = None, folder: str | None = None) -> DataFrame:
    """The columns `keep`, source, lang and `counts` (tokens by version) of each document, in place of its text."""
    versions = {k: v and tokenizer_path(v, folder) for k, v in (TOKENIZERS if tokenizers is None else tokenizers).items()}
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    schema = rows.withColumn("counts", F.lit(None).cast("map<string,bigint>")).drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, text = batch.columns
            data, offsets = column(text)
            n = [word_counts(data, offsets) if path is None else encoder(path).counts(data, offsets).tolist() for path in versions.values()]
            maps = pa.array([list(zip(versions, x, strict=True)) for x in zip(*n, strict=True)], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*others, maps], schema.names)

    return spread(rows).mapInArrow(run, schema)


def signed(docs: DataFrame, sign: int) -> DataFrame:
    """Inserts (1) or deletes (-1) of documents, by their counts where they have been counted."""
    content = "counts" if "counts" in docs.columns else "text"
    return docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), content, F.lit(sign).alias("sign"))


def revised(docs: DataFrame, new_text) -> DataFrame:
    """The old text of each document out, the new one in; a document stays one."""
    return signed(docs, -1).unionByName(signed(docs.withColumn("text", new_text), 1))


class TokenRollup:
    """Totals in a folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batch(self, batch_id: str) -> str:
        if not batch_id or any(not (c.isalnum() or c in "-_") for c in batch_id):
            raise ValueError("batch ids are made of letters, digits, - and _")
        return f"{self.path}/batches/{batch_id}"

    def committed(self, batch_id: str) -> bool:
        return self.fs.exists(self._path(self._batch(batch_id)))

    def commit(self, batch_id: str, changes: DataFrame, tokenizers: dict[str, str | None] | None = None) -> bool:
        """Whether this call committed the batch; false if it was there before, and then nothing is computed."""
        if self.committed(batch_id):
            return False
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        deltas(changes, tokenizers).write.parquet(staged)
        self.fs.mkdirs(self._path(f"{self.path}/batches"))
        target = self._path(self._batch(batch_id))
        won = not self.fs.exists(target) and self.fs.rename(self._path(staged), target)
        if won and self.fs.exists(self._path(f"{self._batch(batch_id)}/{staged.rpartition('/')[2]}")):
            # another writer was first and the rename moved this attempt inside its folder
            self.fs.delete(self._path(f"{self._batch(batch_id)}/{staged.rpartition('/')[2]}"), True)
            won = False
        if not won:
            self.fs.delete(self._path(staged), True)
        return bool(won)

    def _listed(self, folder: str) -> list[str]:
        root = self._path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(root)) if self.fs.exists(root) else []

    def _state(self) -> tuple[str | None, list[str]]:
        """The newest snapshot and the committed batches that it does not hold."""
        snapshots, batches = self._listed("snapshots"), self._listed("batches")
        if not snapshots:
            return None, batches
        at = f"{self.path}/snapshots/{snapshots[-1]}"
        held = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{at}/batches").collect()}  # as many as were committed
        return at, [x for x in batches if x not in held]

    def compact(self) -> None:
        """Write the totals of all committed batches as a snapshot; later totals read it and the batches that came after.

        Batches stay where they are, so an id that was committed stays known. A snapshot is complete before it has its name."""
        snapshots, (_, new) = self._listed("snapshots"), self._state()
        if not new:
            return
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        known = self._listed("batches")  # listed before the totals are: what comes in between is not held
        self._sums(known).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(x,) for x in known], "batch string").coalesce(1).write.parquet(f"{staged}/batches")
        self.fs.mkdirs(self._path(f"{self.path}/snapshots"))
        number = int(snapshots[-1].split("-")[0]) + 1 if snapshots else 1
        self.fs.rename(self._path(staged), self._path(f"{self.path}/snapshots/{number:012d}-{uuid.uuid4().hex}"))

    def _sums(self, only: list[str] | None = None) -> DataFrame:
        at, new = self._state()
        names = [f"{self.path}/batches/{x}" for x in new if only is None or x in only] + ([f"{at}/totals"] if at else [])
        if not names:
            return self.spark.createDataFrame([], SHAPE)
        return self.spark.read.schema(SHAPE).parquet(*names).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        return self._sums().filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents inserted; those with repeated lines revised to distinct lines; those labelled toxic deleted; one batch sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select("doc_id").distinct()
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    lines = F.split("text", "\n")
    repeats = F.coalesce(F.size(F.array_distinct(lines)) < F.size(lines), F.lit(False))
    # each version of a text is counted once; ids and counts, not texts, meet the labels
    loaded = written(counted(docs.withColumn("repeats", repeats), ("doc_id", "repeats")), "counts")
    after = docs.filter(repeats).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    after = written(counted(after, ("doc_id",)), "revised-counts")
    rollup.commit("load", signed(loaded, 1))
    revisions = signed(loaded.filter("repeats"), -1).unionByName(signed(after, 1))
    rollup.commit("revise", revisions)
    rollup.commit("revise", revisions)
    now = loaded.filter("NOT repeats").drop("repeats").unionByName(after)
    rollup.commit("delete", signed(now.join(toxic, "doc_id", "left_semi"), -1))
    return rollup.totals()
