"""WARC records in ZIP archives: written as stored members with an index, read by ranges without extraction.

An archive holds `archive/data.warc.gz` (one gzip member per record) and `indexes/index.cdxj` (place of each
record), both stored. The reader parses the end record, the ZIP64 records where there are any, and the central
directory, finds the data of a member behind its local header, reads the index, and then range-reads single records.

Of records with equal payloads of at least `least` bytes the one with the smallest page_id is a response and the others
are revisits of it. Groups are found by partial aggregation on payload digests; the payloads themselves are
only joined with the groups that have more than one member, so a payload that a third of all pages
share costs one row. Archives are closed by size and written under names of their own, then renamed; a task that
is run again writes others, and only archives named by the committed catalogue are read.

Defined cases: a null html is an empty payload; rows with equal page_id and payload are all responses if that id is
the smallest; a null page_id is never the target of a revisit unless all ids of its group are null, and then all its
records are responses; a null url is written as `urn:none`; a very long html is one record; ids are percent-encoded in
headers, so any text comes back as it was; an empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._store import new_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- ZIP directories -------------------------------------------------------------------------------------------


class ZipMembers:
    """The members of a ZIP archive in a random-access file, from its directories alone."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m[0]: m[1:] for m in self._directory()}

    def _read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("a ZIP record lies outside the archive")
        self.file.seek(at)
        return self.file.read(n)

    def _ends(self) -> tuple[int, int, int]:
        """(entries, bytes, offset) of the central directory."""
        tail_at = max(0, self.size - 22 - 0xFFFF)
        tail = self._read(tail_at, self.size - tail_at)
        at = len(tail)
        while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        if at < 0:
            raise ValueError("no end record: not a ZIP archive")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            locator = self._read(tail_at + at - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                (end64,) = struct.unpack_from("<Q", locator, 8)
                record = self._read(end64, 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 locator points at no end record")
                entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        return entries, length, offset

    def _directory(self) -> Iterator[tuple[str, int, int, int, int]]:
        entries, length, offset = self._ends()
        raw, at = self._read(offset, length), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            (header,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = next(values) if plain == 0xFFFFFFFF else plain
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                e += 4 + n
            yield name, method, packed, plain, header
            at += 46 + n_name + n_extra + n_comment

    def stored(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many there are."""
        method, packed, _, header = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        local = self._read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, packed

    def range(self, name: str, offset: int, length: int) -> bytes:
        begin, size = self.stored(name)
        if offset < 0 or offset + length > size:
            raise ValueError("the range lies outside its member")
        return self._read(begin + offset, length)


# --- WARC records ----------------------------------------------------------------------------------------------


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value) or "urn:none"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {quote(str(page_id), safe='')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {quote(str(refers_to), safe='')}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields, the HTTP fields of the block and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {"fields": fields, "http": http_fields, "payload": payload}


# --- operator --------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, html, revisit and refers_to of each page."""
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    body = F.encode("html", "UTF-8")
    keyed = p.withColumn("k1", F.sha1(body)).withColumn("k2", F.xxhash64(body)).withColumn("n", F.octet_length("html"))
    groups = written(
        keyed.filter(F.col("n") >= least).groupBy("k1", "k2", "n").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first"))
        .filter((F.col("copies") > 1) & F.col("first").isNotNull()).drop("copies"),
        "payloads",
    )
    # ids meet the groups, and bodies meet ids: a payload that many pages share is dealt by their ids, not by itself
    key = ["k1", "k2", "n"]
    told = keyed.select("page_id", *key).distinct().join(groups, key).select(F.col("page_id").alias("p_id"), *[F.col(c).alias(f"g_{c}") for c in key], "first")
    same = F.col("page_id").eqNullSafe(F.col("p_id"))
    for c in key:
        same = same & (F.col(c) == F.col(f"g_{c}"))
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return keyed.join(told, same, "left").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write the records into archives under `folder`; a committed catalogue of (path, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            made = io.BytesIO()
            with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                for name, body in ((DATA, data.getvalue()), (INDEX, "\n".join(index).encode())):
                    with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                        f.write(body)
            name = f"{base}/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{name}.part") as f:
                f.write(made.getbuffer())
            store.move(f"{name}.part", f"{name}.zip")
            row = {"path": [f"{folder.rstrip('/')}/{name.rpartition('/')[2]}.zip"], "records": [len(index)], "bytes": [made.tell()]}
            data.seek(0), data.truncate(), index.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, html, revisit, refers_to = (batch.column(c)[r].as_py() for c in range(5))
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                packed = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to, revisit), 6, mtime=0)
                index.append(json.dumps({"offset": data.tell(), "length": len(packed), "url": clean(url or "")}))
                data.write(packed)
                if data.tell() >= archive_bytes:
                    yield close()
        if index:
            yield close()

    return written(records.mapInArrow(write, "path string, records long, bytes long"), "catalogue")


def read_archives(catalogue: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """One row per record of the archives named in `path`, each range-read on its own; response payloads are checked against their digests.

    Ids stand in headers as text, percent-encoded, and come back as `id_type`, any type that a string can be cast to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    members = ZipMembers(file, file.size())
                    _, n_index = members.stored(INDEX)
                    lines = members.range(INDEX, 0, n_index).decode().splitlines()
                    for at in range(0, len(lines), 256):
                        rows = []
                        for entry in map(json.loads, lines[at : at + 256]):
                            r = parse_record(zlib.decompress(members.range(DATA, entry["offset"], entry["length"]), 31))
                            f, kind = r["fields"], r["fields"]["WARC-Type"]
                            digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                                raise ValueError(f"{path}: a payload does not match its digest")
                            page_id, refers_to = (None if f.get(k) is None else unquote(f[k]) for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID"))
                            rows.append((page_id, int(r["http"]["Content-Length"]), digest, kind, refers_to, f["WARC-Target-URI"], r["payload"]))
                        ids = [pa.array([x[c] for x in rows], pa.string()) for c in (0, 4)]
                        made = {
                            "page_id": ids[0], "payload_bytes": pa.array([x[1] for x in rows], pa.int64()), "payload_digest": pa.array([x[2] for x in rows]),
                            "record_type": pa.array([x[3] for x in rows]), "refers_to": ids[1], "target_uri": pa.array([x[5] for x in rows]),
                        }
                        if with_payload:
                            made["payload"] = pa.array([x[6] for x in rows], pa.binary())
                        yield pa.RecordBatch.from_pydict(made)

    found = catalogue.select("path").mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, target_uri string" + ", payload binary" * with_payload)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write all pages as WARC records in ZIP archives in the shared folder and read them back."""
    spark = pages.sparkSession
    catalogue = write_archives(with_revisits(pages, id_col, url, html, least), new_path(spark, "warc"), archive_bytes)
    # one archive a task: the catalogue is small, its rows are not
    spread = catalogue.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return read_archives(spread, pages.schema[id_col].dataType.simpleString())


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
