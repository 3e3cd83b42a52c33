"""Kinds of files, by extension and by first bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each kind.
IMAGE = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff")
RAW = ("arw", "cr2", "cr3", "dng", "nef", "nrw", "orf", "raf", "rw2", "srw")
VIDEO = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg", "mpeg", "wmv")
AUDIO = ("mp3", "flac", "wav", "m4a", "aac", "ogg", "opus", "wma")
JPEG = ("jpg", "jpeg")

# Fixed values: (offset, first bytes, second offset or None, second bytes, extensions), first match wins.
SIGNATURES = (
    (0, "FFD8FF", None, "", ("jpg", "jpeg")),
    (0, "89504E470D0A1A0A", None, "", ("png",)),
    (0, "474946383761", None, "", ("gif",)),
    (0, "474946383961", None, "", ("gif",)),
    (0, "424D", None, "", ("bmp",)),
    (0, "52494646", 8, "57454250", ("webp",)),
    (0, "504B0304", None, "", ("zip",)),
    (0, "25504446", None, "", ("pdf",)),
    (0, "494433", None, "", ("mp3",)),
    (0, "664C6143", None, "", ("flac",)),
    (0, "52494646", 8, "57415645", ("wav",)),
    (0, "4F676753", None, "", ("ogg", "opus")),
)


def of_kind(ext: Column, kind: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(ext).isin(*kind), F.lit(False))


def expected_extensions(content: Column) -> Column:
    """The extensions that fit the first bytes of a binary column; null if they are unknown."""
    here = lambda at, raw: F.hex(F.substring(content, at + 1, len(raw) // 2)) == raw
    rules = [F.when(here(a, x) & (here(b, y) if b is not None else F.lit(True)), F.array(*map(F.lit, exts))) for a, x, b, y, exts in SIGNATURES]
    return F.coalesce(*rules)


def bad_extension(ext: Column, content: Column) -> Column:
    expected = expected_extensions(content)
    return F.coalesce(ext.isNotNull() & expected.isNotNull() & ~F.array_contains(expected, ext), F.lit(False))


def wildcard_regex(pattern: str) -> str:
    """`*` is any run of characters, `/` included, `?` any one; ASCII case does not matter; the whole string must match."""
    parts = {"*": ".*", "?": "."}
    return "(?is)^" + "".join(parts.get(c) or re.escape(c) for c in pattern) + "$"


def ignored(relative: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | relative.rlike(wildcard_regex(p))
    return out
