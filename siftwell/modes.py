"""The scan modes over file trees, each a composition of sources, operators and one report."""

from __future__ import annotations

import dataclasses
import json
import threading
import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import bits, magic, names, tags
from siftwell.operators import ranking, refine, report, simjoin
from siftwell.sources import fswalk, media, zips
from siftwell.sources.stores import HashCache
from siftwell.store import written


@dataclasses.dataclass(frozen=True)
class ScanConfig:
    paths: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    mode: str = "exact"
    algorithm: str = "blake3"
    min_size: int = 1
    prefix_bytes: int = 1 << 20
    ignore_hidden: bool = True
    byte_verify: bool = False
    include_archives: bool = False
    name_threshold: int = 85
    folder_threshold: int = 85
    image_threshold: int = 12
    image_size: int = 8
    rotations: bool = False
    duration_tolerance: float = 2.0
    media_threshold: int = 32
    ignore_patterns: tuple[str, ...] = ()
    cache: bool = False
    cache_path: str | None = None
    cache_tolerance: int = 0


#: Where hashes are kept if a cache is asked for without a place, and the modes that use one.
CACHE_PATH = ".siftwell-cache"
CACHED_MODES = ("exact", "similar-images", "similar-videos", "similar-audio")


class Cached:
    """The hash cache of a scan, if it has one, and how often it knew a hash."""

    def __init__(self, spark: SparkSession, c: ScanConfig):
        self.store = HashCache(spark, c.cache_path or CACHE_PATH) if c.cache else None
        self.tolerance, self.hits, self.misses = c.cache_tolerance, 0, 0

    def hashed(self, files: DataFrame, algorithm: str, scope: str, bytes_hashed: int, compute: Callable[[DataFrame], DataFrame], by_identity: bool = True) -> DataFrame:
        """files with `hash` and `read_error`: known ones from the cache, the others by compute(files), and then kept."""
        asked = files.withColumn("device_id", F.col("identity.device_id")).withColumn("inode", F.col("identity.inode")) if by_identity else files.withColumns({x: F.lit(None).cast("string") for x in ("device_id", "inode")})
        if self.store is None:
            out = written(compute(asked).withColumn("hit", F.lit(False)), "hashes")
        else:
            looked = written(self.store.lookup(asked, algorithm, scope, bytes_hashed, self.tolerance), "looked-up")
            known = looked.filter(F.col("hash").isNotNull()).withColumn("read_error", F.lit(None).cast("string")).withColumn("hit", F.lit(True))
            new = compute(looked.filter(F.col("hash").isNull()).drop("hash")).withColumn("hit", F.lit(False))
            out = written(known.unionByName(new), "hashes")
            kept = out.filter("NOT hit AND hash IS NOT NULL").select(
                "path", "device_id", "inode", "size", "modified_unix", F.lit(algorithm).alias("algorithm"), F.lit(scope).alias("scope"),
                F.lit(bytes_hashed).cast("long").alias("bytes_hashed"), "hash", F.lit(int(time.time())).cast("long").alias("created_unix"),
            )
            if not kept.isEmpty():
                self.store.store(kept)
        hits, misses = out.filter("read_error IS NULL").agg(F.count_if(F.col("hit")), F.count_if(~F.col("hit"))).first()
        self.hits, self.misses = self.hits + hits, self.misses + misses
        return out.drop("hit", "device_id", "inode")


class Canceled(RuntimeError):
    pass


class CancelToken:
    def __init__(self):
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    def is_set(self) -> bool:
        return self._event.is_set()

    def check(self) -> None:
        if self._event.is_set():
            raise Canceled("scan canceled")


#: mode: (risk, whether min_size applies, whether a missing root is passed over)
MODES = {
    "exact": ("low", True, False), "similar-names": ("high", True, False), "similar-images": ("high", True, False),
    "raw-jpeg-pairs": ("medium", False, False), "similar-videos": ("high", True, False), "similar-audio": ("high", True, False),
    "duplicate-folders": ("medium", False, True), "empty-files": ("low", False, False), "empty-folders": ("low", False, True),
    "large-files": ("low", True, False), "bad-extensions": ("medium", False, False), "duplicate-archive-members": ("medium", True, True),
    "empty-archives": ("low", False, True),
}

FLAT = ["size", "algorithm", "hash", "reason", "path", "modified_unix", "is_protected", "suggested_keep", "rank"]


def review(items: DataFrame, label: str, reason: str, order=None) -> DataFrame:
    """All items as one group; ranks come from a range-partitioned sort."""
    ranked = ranking.global_rank(items, order or ranking.item_order()).withColumn("rank", F.col("rank").cast("int"))
    return ranked.withColumn("suggested_keep", F.col("rank") == 1).withColumn("algorithm", F.lit(label)).withColumn("hash", F.lit(label)).withColumn("reason", F.lit(reason)).withColumn("group_key", F.lit(label))


def linked(files: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """Components of pairs (a, b, score, reason) of paths; a group tells its best pair's score and reason."""
    pairs = written(pairs.select("a", "b", "score", "reason"), "pairs")
    labels = simjoin.grouped(pairs)
    order = F.struct((-F.col("score")).alias("s"), "a", "b", "reason")
    best = pairs.join(labels.withColumnRenamed("node", "a"), "a").groupBy("comp").agg(F.min(order).alias("m"))
    best = best.select("comp", (-F.col("m.s")).cast("string").alias("hash"), F.when(F.col("m.s") == 0, "matched by threshold").otherwise(F.col("m.reason")).alias("reason"))
    items = files.join(labels.select(F.col("node").alias("path"), "comp"), "path").join(best, "comp")
    return ranking.ranked(items.withColumn("group_key", F.col("comp")), ["group_key"]).withColumn("algorithm", F.lit(label))


def _exact(spark, found, files, c: ScanConfig, cached: Cached, told, cancel):
    """Files of one size by the hash of their first bytes, then of all of them; only what is left is read on. (items, errors)"""
    told("group by size")
    sized = refine.at_least_two(files, ["size"])
    told("hash first bytes")
    start = cached.hashed(sized, c.algorithm, "partial", c.prefix_bytes, lambda f: fswalk.read_digests(f, c.algorithm, c.prefix_bytes))
    cancel.check()
    told("hash whole files")
    same = refine.at_least_two(start.filter("read_error IS NULL").withColumnRenamed("hash", "prefix"), ["size", "prefix"]).drop("read_error")

    def whole(f: DataFrame) -> DataFrame:  # what is no longer than its first bytes has been hashed
        short = F.col("size") <= c.prefix_bytes
        rest = fswalk.read_digests(f.filter(~short), c.algorithm)
        return rest.unionByName(f.filter(short).withColumn("hash", F.col("prefix")).withColumn("read_error", F.lit(None).cast("string")))

    full = cached.hashed(same, c.algorithm, "full", -1, whole)
    failed = start.filter("read_error IS NOT NULL").select("path", "read_error").unionByName(full.filter("read_error IS NOT NULL").select("path", "read_error"))
    groups, keys = full.filter("read_error IS NULL").drop("prefix", "read_error"), ["size", "hash"]
    groups = refine.at_least_two(groups, keys)
    if c.byte_verify:
        cancel.check()
        told("compare bytes")
        groups, keys = fswalk.split_by_bytes(groups, keys), [*keys, "bytes_of"]
        failed = failed.unionByName(groups.filter("read_error IS NOT NULL").select("path", "read_error"))
        groups = refine.at_least_two(groups.filter("read_error IS NULL").drop("read_error"), keys)
    groups = groups.withColumn("group_key", F.concat_ws(":", *[F.col(k).cast("string") for k in keys])).withColumn("reason", F.lit("same size + same full hash" + ", byte-by-byte verified" * c.byte_verify))
    out = ranking.ranked(groups, ["group_key"]).withColumn("algorithm", F.lit(c.algorithm))
    if c.include_archives:
        told("read archives")
        out = out.select("group_key", *FLAT).unionByName(_archive_members(spark, found, files, c).select("group_key", *FLAT))
    return out, [f"{r.path}: {r.read_error}" for r in failed.collect()]


def _archive_members(spark, found, files, c: ScanConfig):
    rows = zips.member_rows(found.filter("kind = 'file'").filter(F.lower("path").endswith(".zip")).select("path").distinct(), c.min_size)
    same = refine.at_least_two(rows.filter("error IS NULL"), ["size", "hash"])
    same = same.withColumn("modified_unix", F.lit(None).cast("long")).withColumn("is_protected", F.lit(True)).withColumn("group_key", F.concat_ws(":", F.col("size").cast("string"), "hash"))
    ranked = ranking.ranked(same, ["group_key"], [F.split("path", "/"), F.col("path")])
    return ranked.withColumn("algorithm", F.lit("sha256")).withColumn("reason", F.lit("same archive member size + same full hash"))


def _names(files, c: ScanConfig):
    named = files.withColumn("stem", names.stem(names.base_name(F.col("path")))).withColumn("norm", names.normalized(F.col("stem")))
    first = named.groupBy("norm").agg(F.min(F.struct("path", "stem")).alias("f")).select("norm", F.col("f.path").alias("p"), F.col("f.stem").alias("s"))
    same = named.join(first, "norm").filter("path != p").select(F.col("p").alias("a"), F.col("path").alias("b"), F.lit(100).alias("score"), F.lit("normalized filename match").alias("reason"))
    pairs = simjoin.name_pairs(first.select("norm"), c.name_threshold)
    x, y = first.select(F.col("norm").alias("a"), F.col("p").alias("pa"), F.col("s").alias("sa")), first.select(F.col("norm").alias("b"), F.col("p").alias("pb"), F.col("s").alias("sb"))
    reason = names.name_reason(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"))
    near = pairs.join(x, "a").join(y, "b").select(F.col("pa").alias("x"), F.col("pb").alias("y"), "score", reason.alias("reason")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score", "reason")
    return linked(files, same.filter(F.lit(c.name_threshold <= 100)).unionByName(near), "similar-names")


def _raw_pairs(files):
    named = files.select("path", names.extension(names.base_name(F.col("path"))).alias("ext"), names.normalized(names.stem(names.base_name(F.col("path")))).alias("norm"))
    raw, jpeg = named.filter(magic.of_kind(F.col("ext"), magic.RAW)), named.filter(magic.of_kind(F.col("ext"), magic.JPEG))
    pairs = raw.select(F.col("path").alias("x"), "norm").join(jpeg.select(F.col("path").alias("y"), "norm"), "norm")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(100).alias("score"), F.concat(F.lit("RAW + JPEG pair: "), "norm").alias("reason"))


def triangle(size: int, into: int):
    """The matrix that samples `size` pixels down (or up) to `into` with a triangle filter."""
    import numpy as np

    ratio = size / into
    reach = max(ratio, 1.0)
    centre = (np.arange(into) + 0.5) * ratio
    at = np.arange(size)
    inside = (at >= np.maximum(0, np.floor(centre - reach))[:, None]) & (at < np.minimum(size, np.ceil(centre + reach))[:, None])
    weight = np.maximum(0, 1 - np.abs((at[None, :] - (centre - 0.5)[:, None]) / reach)) * inside
    return weight / weight.sum(axis=1, keepdims=True)


def grey_levels(height: int, width: int, channels: int, raw: bytes, side: int) -> list[int]:
    """An image (blue, green, red) as side * side grey levels of eight bits."""
    import numpy as np

    px = np.frombuffer(raw, dtype=np.uint8).reshape(height, width, channels).astype(np.int64)
    grey = px[:, :, 0] if channels == 1 else (722 * px[:, :, 0] + 7152 * px[:, :, 1] + 2126 * px[:, :, 2]) // 10000
    small = triangle(height, side) @ grey @ triangle(width, side).T
    return np.clip(np.floor(small + 0.5), 0, 255).astype(np.int64).ravel().tolist()


def _images(spark, files, c: ScanConfig, cached: Cached):
    n, rotations = c.image_size, c.rotations
    if n < 4:
        raise ValueError("image hashes have 4 by 4 bits at least")

    @F.pandas_udf("array<long>")
    def shrunk(h: pd.Series, w: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([grey_levels(*x, n) for x in zip(h, w, channels, data, strict=True)])

    @F.pandas_udf("string")
    def taken(paths: pd.Series) -> pd.Series:
        def one(path):
            try:
                with open(path, "rb") as f:
                    return media.exif_date(f.read())
            except OSError:
                return None

        return paths.map(one).astype(object)

    def decoded(wanted: DataFrame) -> DataFrame:
        """The hashes of images as text: variants apart by semicolons, their words by commas."""
        paths = [f"file://{r.path}" for r in wanted.select("path").toLocalIterator()]  # the reader takes a list
        none = wanted.withColumn("hash", F.lit(None).cast("string"))
        if paths:
            read = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
            read = read.select(F.regexp_replace("origin", "^file:/+", "/").alias("path"), shrunk("height", "width", "nChannels", "data").alias("px"))
            variants = bits.hash_variants(F.col("px"), n, rotations)
            text = F.array_join(F.transform(variants, lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")), ";")
            none = wanted.join(read.select("path", text.alias("hash")), "path", "left")
        return none.withColumn("read_error", F.when(F.col("hash").isNull(), F.lit("image cannot be decoded")))

    raw = _raw_pairs(files)
    wanted = files.filter(magic.of_kind(names.extension(names.base_name(F.col("path"))), magic.IMAGE))
    found = cached.hashed(wanted, f"image-ahash-{n}" + "-rot" * rotations, "full", -1, decoded, by_identity=False)
    failed = found.filter("read_error IS NOT NULL").select("path", F.col("read_error").alias("error"))
    words = F.transform(F.split("hash", ";"), lambda v: F.transform(F.split(v, ","), lambda x: x.cast("long")))
    hashes = written(found.filter("hash IS NOT NULL").select("path", words.alias("hs"), taken("path").alias("date")), "image-hashes")
    variants = hashes.select("path", F.explode("hs").alias("h"))
    pairs = simjoin.hamming_pairs(variants, "path", "h", c.image_threshold, n * n).withColumnRenamed("distance", "d")
    x, y = (hashes.select(F.col("path").alias(side), F.col("date").alias(f"date_{side}")) for side in "ab")
    dated = F.when(F.col("date_a") == F.col("date_b"), F.concat(F.lit(" with matching EXIF date "), "date_a"))
    reason = F.concat(F.format_string("perceptual hash distance %d", F.col("d")), F.coalesce(dated, F.lit("")))
    near = pairs.join(x, "a").join(y, "b").select("a", "b", bits.image_score(F.col("d"), n).alias("score"), reason.alias("reason"))
    return linked(files, raw.unionByName(near), "similar-images"), failed


TAGGED = "struct<duration:double,title:string,artist:string,album:string,fingerprint:string>"


def _media(files, c: ScanConfig, video: bool, cached: Cached):
    def analyzed(wanted: DataFrame) -> DataFrame:
        """What the tools tell of each file, as JSON."""
        schema = wanted.withColumn("hash", F.lit(None).cast("string")).withColumn("read_error", F.lit(None).cast("string")).schema
        at = wanted.columns.index("path")

        def run(batches):
            for batch in batches:
                rows = []
                for p in batch.column(at).to_pylist():
                    try:
                        rows.append((json.dumps(media.analyze(p, video)), None))
                    except Exception as e:  # noqa: BLE001 - an unreadable file is an error of the report
                        rows.append((None, str(e) or type(e).__name__))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[i] for x in rows], pa.string()) for i in (0, 1)]], [*batch.schema.names, "hash", "read_error"])

        return wanted.mapInArrow(run, schema)

    kind = magic.VIDEO if video else magic.AUDIO
    wanted = files.filter(magic.of_kind(names.extension(names.base_name(F.col("path"))), kind))
    found = cached.hashed(wanted, "video-fingerprint" if video else "audio-fingerprint", "full", -1, analyzed, by_identity=False)
    found = found.select(F.col("path").alias("id"), F.from_json("hash", TAGGED).alias("m"), F.col("read_error").alias("error")).select("id", "m.*", "error")
    read = found.filter("error IS NULL")
    pairs = simjoin.band_pairs(read, c.duration_tolerance, c.media_threshold)
    label = "similar-videos" if video else "similar-audio"
    reason = F.format_string("duration delta %.2fs, fingerprint distance %d", F.col("delta"), F.col("distance"))
    if not video:
        x, y = (read.select(F.col("id").alias(side), *[F.col(t).alias(f"{side}_{t}") for t in tags.AUDIO_TAGS]) for side in "ab")
        pairs = pairs.join(x, "a").join(y, "b")
        left, right = ({t: F.col(f"{side}_{t}") for t in tags.AUDIO_TAGS} for side in "ab")
        reason = F.concat(reason, F.coalesce(F.concat(F.lit(", metadata "), tags.shared_tags(left, right, values=True)), F.lit("")))
    failed = found.filter("error IS NOT NULL").select(F.col("id").alias("path"), "error")
    return linked(wanted, pairs.select("a", "b", bits.media_score(F.col("distance")).alias("score"), reason.alias("reason")), label), failed


def _folders(spark, c: ScanConfig):
    found = fswalk.entries(spark, list(c.paths), c.ignore_hidden, missing_ok=True).filter("kind = 'file'")
    relative = F.expr("substring(path, length(root) + 2)")
    kept = found.filter(~magic.ignored(relative, list(c.ignore_patterns)))
    name = names.base_name(F.col("path"))
    entry = kept.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), names.signature(name, F.col("size")).alias("entry"), "size", "modified_unix", "path")
    folders = entry.groupBy("folder").agg(F.sum("size").alias("size"), F.max("modified_unix").alias("modified_unix"))
    folders = fswalk.file_index(folders.select(F.col("folder").alias("path"), "size", "modified_unix", F.lit("").alias("device_id"), F.lit("").alias("inode"), F.lit("file").alias("kind")), list(c.protected))
    pairs = simjoin.set_pairs(entry, "folder", "entry", max(1, c.folder_threshold)).select("a", "b", "score", "both")
    if c.folder_threshold <= 0:  # every pair matches: one group, and links to its first folder tell so without all the pairs
        first = entry.agg(F.min("folder")).first()[0]
        rest = entry.select("folder").distinct().filter(F.col("folder") != F.lit(first))
        pairs = pairs.unionByName(rest.select(F.lit(first).alias("a"), F.col("folder").alias("b"), F.lit(0).alias("score"), F.lit(0).cast("long").alias("both")))
    reason = F.format_string("folder similarity %d%%: %d shared entries", F.col("score"), F.col("both"))
    return linked(folders, pairs.withColumn("reason", reason), "duplicate-folders"), entry.count()


def scan_table(spark: SparkSession, c: ScanConfig, cancel: CancelToken | None = None, on_progress: Callable[[str], None] | None = None) -> tuple[DataFrame | None, dict]:
    """The items of one scan with the numbers of their groups, as a table of any size, and the report without its groups."""
    cancel, told = cancel or CancelToken(), on_progress or (lambda _: None)
    risk, sized, missing_ok = MODES[c.mode]
    errors: list[str] = []
    empty = {"mode": c.mode, "scanned_files": 0, "candidate_size_groups": 0, "cache_hits": 0, "cache_misses": 0, "duplicate_groups": [], "errors": errors, "risk": risk}
    cancel.check()
    if c.mode in ("similar-videos", "similar-audio") and (error := media.missing_tool()):
        errors.append(error)
        return None, empty
    told("collect")
    found = written(fswalk.entries(spark, list(c.paths), c.ignore_hidden, missing_ok), "entries")
    errors += [f"{r.path}: {r.error}" for r in found.filter("kind = 'error'").select("path", "error").collect()]
    files = fswalk.file_index(found, list(c.protected))
    if sized and c.mode != "duplicate-archive-members":
        files = files.filter(F.col("size") >= c.min_size)
    ext = names.extension(names.base_name(F.col("path")))
    scanned, candidates = None, 0
    cancel.check()
    told("match")
    cached = Cached(spark, c)
    if c.mode == "exact":
        items, failed = _exact(spark, found, files, c, cached, told, cancel)
        candidates = files.groupBy("size").count().filter("count > 1").count()
        errors += failed
    elif c.mode == "similar-names":
        items = _names(files, c)
    elif c.mode == "similar-images":
        files = files.filter(magic.of_kind(ext, magic.IMAGE) | magic.of_kind(ext, magic.RAW))
        items, failed = _images(spark, files, c, cached)
        errors += [f"{r.path}: {r.error}" for r in failed.collect()]
    elif c.mode == "raw-jpeg-pairs":
        files = files.filter(magic.of_kind(ext, magic.IMAGE) | magic.of_kind(ext, magic.RAW))
        items = linked(files, _raw_pairs(files), "raw-jpeg-pairs")
    elif c.mode in ("similar-videos", "similar-audio"):
        files = files.filter(magic.of_kind(ext, magic.VIDEO if c.mode == "similar-videos" else magic.AUDIO))
        items, failed = _media(files, c, c.mode == "similar-videos", cached)
        errors += [f"{r.path}: {r.error}" for r in failed.collect()]
    elif c.mode == "duplicate-folders":
        items, scanned = _folders(spark, c)
    elif c.mode == "empty-files":
        items = review(files.filter("size = 0"), "empty-files", "file is empty")
    elif c.mode == "empty-folders":
        folders = fswalk.empty_folders(found).select("path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("modified_unix"), F.lit("").alias("device_id"), F.lit("").alias("inode"), F.lit("file").alias("kind"))
        items = review(fswalk.file_index(folders, list(c.protected)), "empty-folders", "folder is empty")
        scanned = fswalk.empty_folders(found).count()
    elif c.mode == "large-files":
        items = review(files, "large-files", f"file is {c.min_size} bytes or larger", ranking.large_order())
    elif c.mode == "bad-extensions":
        heads = fswalk.read_content(files.filter("size > 0"), 16).withColumn("ext", ext)
        items = review(heads.filter(magic.bad_extension(F.col("ext"), F.col("content"))).drop("content", "read_error", "ext"), "bad-extensions", "content does not match the extension")
    else:
        archives = files.filter(F.lower("path").endswith(".zip"))
        scanned = archives.count()
        if c.mode == "empty-archives":
            items = review(zips.empty_archives(archives.drop("identity")).withColumn("is_protected", F.lit(False)), "empty-archives", "archive has no files")
        else:
            items = _archive_members(spark, found, files, c)
            errors += [r.error for r in zips.member_rows(archives).filter("error IS NOT NULL").select("error").collect()]
    cancel.check()
    items = items.select("group_key", *FLAT)
    sizes = items.groupBy("group_key").agg(F.max("size").alias("group_size"), F.min(F.when(F.col("rank") == 1, F.col("path"))).alias("first"))
    numbered = ranking.global_rank(sizes, [F.col("group_size").desc(), F.split("first", "/")]).select("group_key", F.col("rank").cast("int").alias("group_number"))
    n_groups = sizes.count() if c.mode == "duplicate-archive-members" else candidates
    told("report")
    return items.join(numbered, "group_key"), empty | {
        "scanned_files": files.count() if scanned is None else scanned, "candidate_size_groups": n_groups, "cache_hits": cached.hits, "cache_misses": cached.misses,
    }


def scan(spark: SparkSession, c: ScanConfig, cancel: CancelToken | None = None, on_progress: Callable[[str], None] | None = None) -> dict:
    """The report of one scan, as a dictionary: all of its groups reach the driver, as a report that is shown or stored needs them."""
    flat, report_ = scan_table(spark, c, cancel, on_progress)
    if flat is None:
        return report_
    groups = [r.asDict(recursive=True) for r in report.nested(flat).collect()]
    for g in groups:
        del g["group_number"]
    if cancel is not None:
        cancel.check()
    return report_ | {"duplicate_groups": groups}
