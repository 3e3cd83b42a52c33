"""Perceptual hashes and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_hash(pixels: Column, n: int = 8) -> Column:
    """One bit for each of n*n grey levels (whole numbers): at least their mean, rounded down; in 64-bit words, the first pixel highest."""
    total = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    mean = F.floor(total / (n * n))
    bits = F.array_join(F.transform(pixels, lambda x: F.when(x >= mean, F.lit("1")).otherwise(F.lit("0"))), "")
    return F.array(*[F.conv(F.substring(bits, i + 1, 64), 2, -10).cast("long") for i in range(0, n * n, 64)])


def permuted(pixels: Column, order: list[int]) -> Column:
    return F.array(*[pixels[i] for i in order])


def orientations(n: int) -> dict[str, list[int]]:
    """Index permutations of an n by n image: as it is, rotated, and mirrored."""
    at = lambda f: [f(r, c) for r in range(n) for c in range(n)]
    return {
        "base": at(lambda r, c: r * n + c),
        "rot90": at(lambda r, c: (n - 1 - c) * n + r),
        "rot180": at(lambda r, c: (n - 1 - r) * n + n - 1 - c),
        "rot270": at(lambda r, c: c * n + n - 1 - r),
        "flip": at(lambda r, c: r * n + n - 1 - c),
    }


def hash_variants(pixels: Column, n: int = 8, rotations: bool = False) -> Column:
    orders = orientations(n)
    return F.array(*[average_hash(permuted(pixels, o), n) for o in (orders.values() if rotations else [orders["base"]])])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def words_distance(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda s, x: s + x)


def hex_words(value: Column, n_hex: int = 64) -> Column:
    """A hex digest as 64-bit words."""
    word = lambda i: F.conv(F.substring(value, i + 1, 16), 16, -10).cast("long")
    return F.array(*[word(i) for i in range(0, n_hex, 16)])


def image_score(distance: Column, n: int = 8) -> Column:
    return F.round(F.lit(100.0) * (n * n - F.least(distance, F.lit(n * n))) / (n * n)).cast("int")


def media_score(distance: Column) -> Column:
    return F.round(F.lit(100.0) * (256 - F.least(distance, F.lit(256))) / 256).cast("int")
