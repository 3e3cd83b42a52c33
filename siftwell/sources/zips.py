"""Members of ZIP archives as rows, within limits on their number and sizes."""

from __future__ import annotations

import hashlib
import zipfile

import pandas as pd
from pyspark.sql import DataFrame

# Members of an archive, bytes of a member, bytes of an archive.
MOST_MEMBERS, MOST_MEMBER_BYTES, MOST_ARCHIVE_BYTES = 10_000, 512 << 20, 2 << 30


def members(path: str, min_size: int = 0):
    """(path, size, hash, error) of each file; a limit ends an archive with an error but keeps the rows before it."""
    try:
        with zipfile.ZipFile(path) as z:
            infos, total = z.infolist(), 0
            if len(infos) > MOST_MEMBERS:
                yield path, None, None, f"{path}: {len(infos)} members, above safety limit {MOST_MEMBERS}"
                return
            for i in infos:
                if i.is_dir():
                    continue
                total += i.file_size
                if i.file_size > MOST_MEMBER_BYTES or total > MOST_ARCHIVE_BYTES:
                    yield path, None, None, f"{path}: sizes are above safety limit"
                    return
                if i.file_size < min_size:
                    continue
                digest = hashlib.sha256()
                with z.open(i) as f:
                    while part := f.read(1 << 20):
                        digest.update(part)
                yield f"{path}!{i.filename}", i.file_size, digest.hexdigest(), None
    except (OSError, zipfile.BadZipFile) as e:
        yield path, None, None, f"{path}: {e}"


def member_rows(archives: DataFrame, min_size: int = 0) -> DataFrame:
    def run(frames):
        for frame in frames:
            for path in frame["path"]:
                rows = list(members(path, min_size))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "size", "hash", "error"]).astype({"size": "Int64"})

    return archives.select("path").mapInPandas(run, "path string, size bigint, hash string, error string")


def is_empty(path: str) -> bool:
    """Whether an archive that can be opened has no file; one that cannot is not empty."""
    try:
        with zipfile.ZipFile(path) as z:
            return all(i.is_dir() for i in z.infolist())
    except (OSError, zipfile.BadZipFile):
        return False


def empty_archives(archives: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            yield frame[[is_empty(p) for p in frame["path"]]]

    return archives.mapInPandas(run, archives.schema)
