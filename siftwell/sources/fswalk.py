"""File trees as tables: a Python data source that walks roots on executors, directories, and content readers."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.functions.hashing import file_digest
from siftwell.sources.tables import under
from siftwell.store import written

FILES = "path string, root string, kind string, size bigint, modified_unix bigint, device_id string, inode string, error string"
SYSTEM_NAMES = ("thumbs.db", "desktop.ini")


def is_hidden(name: str) -> bool:
    return name.startswith(".") or name.lower() in SYSTEM_NAMES


def walk(root: str, ignore_hidden: bool, start: str | None = None, deep: bool = True) -> Iterator[tuple]:
    """Entries below a root, or below `start` in it: files, directories and errors; links are not followed and hidden
    folders not entered. Not deep: without what folders hold."""
    top = os.path.realpath(root)
    if ignore_hidden and is_hidden(os.path.basename(top)):
        return
    stack = [start or top]
    if start is None and os.path.isfile(top):
        stack = []
        yield entry(top, root)
    while stack:
        folder = stack.pop()
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            yield folder, root, "error", None, None, None, None, str(e)
            continue
        for e in found:
            if ignore_hidden and is_hidden(e.name):
                yield e.path, root, "hidden", None, None, None, None, None
            elif e.is_dir(follow_symlinks=False):
                yield e.path, root, "dir", None, None, None, None, None
                if deep:
                    stack.append(e.path)
            elif e.is_file(follow_symlinks=False):
                yield entry(e.path, root)
            else:
                yield e.path, root, "other", None, None, None, None, None


def entry(path: str, root: str) -> tuple:
    try:
        s = os.stat(path, follow_symlinks=False)
    except OSError as e:
        return path, root, "error", None, None, None, None, str(e)
    assert stat.S_ISREG(s.st_mode)
    return path, root, "file", s.st_size, int(s.st_mtime) if s.st_mtime >= 0 else None, str(s.st_dev), str(s.st_ino), None


class _Part(InputPartition):
    def __init__(self, root: str, start: str | None, deep: bool):
        self.root, self.start, self.deep = root, start, deep


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], ignore_hidden: bool):
        self.roots, self.ignore_hidden = roots, ignore_hidden

    def partitions(self):
        """A part for what each root holds itself, and one for each folder in it."""
        out = []
        for root in self.roots:
            out.append(_Part(root, None, False))
            out += [_Part(root, path, True) for path, _, kind, *_ in walk(root, self.ignore_hidden, deep=False) if kind == "dir"]
        return out

    def read(self, partition):
        yield from walk(partition.root, self.ignore_hidden, partition.start, partition.deep)


class FileTree(DataSource):
    """Options: roots (one a line) and ignore_hidden. One partition for each root and each folder in it."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema):
        return _Reader(self.options["roots"].split("\n"), self.options.get("ignore_hidden", "true").lower() == "true")


def entries(spark: SparkSession, roots: list[str], ignore_hidden: bool = True, missing_ok: bool = False) -> DataFrame:
    """All entries of the roots; a missing root is an error unless `missing_ok`."""
    missing = [r for r in roots if not os.path.exists(r)]
    if missing and not missing_ok:
        raise FileNotFoundError(f"path does not exist: {missing[0]}")
    roots = [r for r in roots if r not in missing]
    if not roots:
        return spark.createDataFrame([], FILES)
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("roots", "\n".join(roots)).option("ignore_hidden", str(ignore_hidden)).load()


def file_index(found: DataFrame, protected: list[str]) -> DataFrame:
    """Files once each, overlapping roots or not: path, size, modified_unix, identity and is_protected."""
    roots = [os.path.realpath(p) for p in protected if os.path.exists(p)]
    files = found.filter("kind = 'file'").dropDuplicates(["path"])
    return files.select("path", "size", "modified_unix", F.struct("device_id", "inode").alias("identity"), under(F.col("path"), roots).alias("is_protected"))


def read_content(files: DataFrame, most: int | None = None, column: str = "content") -> DataFrame:
    """files with their bytes (or the first `most`) and an error text where they cannot be read; read on executors."""
    schema = files.withColumn(column, F.lit(None).cast("binary")).withColumn("read_error", F.lit(None).cast("string")).schema
    at = files.columns.index("path")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                data, error = None, None
                try:
                    with open(batch.column(at)[r].as_py(), "rb") as f:
                        data = f.read() if most is None else f.read(most)
                except OSError as e:
                    error = str(e)
                one = batch.slice(r, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary()), pa.array([error], pa.string())], [*one.schema.names, column, "read_error"])

    return files.mapInArrow(run, schema)


def read_digests(files: DataFrame, algorithm: str, most: int | None = None) -> DataFrame:
    """files with `hash`, the digest of their bytes (or the first `most`), and an error text; executors read in steps and send digests only."""
    schema = files.withColumn("hash", F.lit(None).cast("string")).withColumn("read_error", F.lit(None).cast("string")).schema
    at = files.columns.index("path")

    def run(batches):
        for batch in batches:
            found = []
            for path in batch.column(at).to_pylist():
                try:
                    found.append((file_digest(path, algorithm, most), None))
                except OSError as e:
                    found.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[c] for x in found], pa.string()) for c in (0, 1)]], [*batch.schema.names, "hash", "read_error"])

    return files.mapInArrow(run, schema)


def same_bytes(left: str, right: str) -> bool:
    with open(left, "rb") as a, open(right, "rb") as b:
        while True:
            x, y = a.read(1 << 20), b.read(1 << 20)
            if x != y:
                return False
            if not x:
                return True


def split_by_bytes(items: DataFrame, keys: list[str]) -> DataFrame:
    """items with `bytes_of`, the first path of those in their group that have equal bytes, and `read_error`; files are compared in steps.

    Each round compares a group with its first file; what differs is the next round's, so a round more is run for each
    collision of a hash."""
    names = [c for c in items.columns if c not in ("bytes_of", "read_error")]
    left, done = items.select(*names), None
    while True:
        first = left.groupBy(*keys).agg(F.min("path").alias("bytes_of"))
        pairs = left.join(first, keys).select(*names, "bytes_of")
        schema = pairs.withColumn("read_error", F.lit(None).cast("string")).withColumn("same", F.lit(None).cast("boolean")).schema
        at = pairs.columns.index("path"), pairs.columns.index("bytes_of")

        def run(batches, at=at):
            for batch in batches:
                found = []
                for a, b in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                    try:
                        found.append((None, a == b or same_bytes(a, b)))
                    except OSError as e:
                        found.append((str(e), True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())], [*batch.schema.names, "read_error", "same"])

        compared = written(pairs.mapInArrow(run, schema), "compared")
        equal = compared.filter("same").drop("same")
        done = equal if done is None else done.unionByName(equal)
        left = compared.filter("NOT same").select(*names)
        if left.isEmpty():
            return done


def empty_folders(found: DataFrame) -> DataFrame:
    """Folders without any entry; hidden entries count as content."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return found.filter("kind = 'dir'").select("path").distinct().join(found.select(parent.alias("path")).distinct(), "path", "left_anti")
