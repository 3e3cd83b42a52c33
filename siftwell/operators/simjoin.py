"""Similarity self-joins without comparing all pairs: each is a union of equi-joins that loses no pair above the threshold."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import bits, names
from siftwell.operators.components import components


def name_candidates(norms: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a < b) of distinct normal forms that can reach the threshold by tokens or by edits.

    Tokens: a score of t needs a shared token in the rarest part of both names (prefix filter). Edits: at most
    k = maxlen * (100.5 - t) / 100 edits leave one of k + 1 equal segments untouched (partition filter), found at a shift of at most k.
    """
    t = max(1, threshold)
    tokened = norms.withColumn("tokens", names.tokens(F.col("norm")))
    exploded = tokened.select("norm", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("norm").orderBy("f", "token")  # a name's own tokens: a few rows
    # of n tokens, all but ceil(n * s) + 1 of the rarest may be left out at a Jaccard similarity of s
    keep = F.col("n") - F.ceil(F.col("n") * ((t - 0.5) / 100.0) - 1e-9) + 1
    prefix = exploded.join(frequency, "token").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= keep).select("token", "norm")
    by_token = prefix.alias("x").join(prefix.alias("y"), "token").filter("x.norm < y.norm").select(F.col("x.norm").alias("a"), F.col("y.norm").alias("b"))

    sized = norms.withColumn("len", F.length("norm"))
    slack = (100.5 - t) / 100.0
    # the longer name has `len` characters: k edits, k + 1 segments; a shorter one is probed for each length it can meet
    k = F.floor(F.col("len") * slack + 1e-9).cast("int")
    begin = lambda i, n, parts: F.floor(i * n / parts).cast("int")
    segments = sized.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    lo, hi = begin(F.col("i"), F.col("len"), F.col("k") + 1), begin(F.col("i") + 1, F.col("len"), F.col("k") + 1)
    segments = segments.select(F.col("norm").alias("long"), "len", "i", F.substring("norm", lo + 1, hi - lo).alias("piece"))
    probes = sized.select("norm", F.col("len").alias("own")).withColumn("len", F.explode(F.sequence(F.col("own"), F.floor(F.col("own") / max(0.01, 1 - slack) + 1).cast("int"))))
    probes = probes.withColumn("k", k).filter(F.col("len") - F.col("own") <= F.col("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    lo, hi = begin(F.col("i"), F.col("len"), F.col("k") + 1), begin(F.col("i") + 1, F.col("len"), F.col("k") + 1)
    probes = probes.withColumn("lo", lo).withColumn("w", hi - lo)
    probes = probes.withColumn("p", F.explode(F.sequence(F.greatest(F.lit(0), F.col("lo") - F.col("k")), F.col("lo") + F.col("k")))).filter(F.col("p") + F.col("w") <= F.col("own"))
    probes = probes.select("norm", "len", "i", F.substring("norm", F.col("p") + 1, F.col("w")).alias("piece")).distinct()
    by_edit = probes.join(segments, ["len", "i", "piece"]).filter(F.col("norm") != F.col("long"))
    by_edit = by_edit.select(F.least("norm", "long").alias("a"), F.greatest("norm", "long").alias("b"))
    return by_token.unionByName(by_edit).distinct()


def name_pairs(norms: DataFrame, threshold: int) -> DataFrame:
    """(a, b, score) of distinct normal forms; a threshold of 0 admits every pair and so compares them all."""
    if threshold <= 0:
        x, y = norms.select(F.col("norm").alias("a")), norms.select(F.col("norm").alias("b"))
        pairs = x.join(y, F.col("a") < F.col("b"))
    else:
        pairs = name_candidates(norms, threshold)
    return pairs.withColumn("score", names.name_score(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)


def set_pairs(entries: DataFrame, owner: str, entry: str, threshold: int, order: Column | None = None) -> DataFrame:
    """(a, b, both, n_a, n_b, score): owners whose entry sets have a Jaccard score of at least `threshold` (1 or more).

    Prefix filter: owners must share one of their rarest entries, so a common entry makes no pairs by itself.
    """
    distinct = entries.select(F.col(owner).alias("o"), F.col(entry).alias("e")).distinct()
    sizes = distinct.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    frequency = distinct.groupBy("e").agg(F.count(F.lit(1)).alias("f"))
    ordered = distinct.join(frequency, "e").join(sizes, "o").withColumn("i", F.row_number().over(Window.partitionBy("o").orderBy("f", "e")))
    need = F.ceil(F.col("n") * ((threshold - 0.5) / 100.0) - 1e-9)
    prefix = ordered.filter((F.col("i") <= F.col("n") - need + 1) & (F.col("f") > 1)).select("o", "e", "n")
    x, y = prefix.alias("x"), prefix.alias("y")
    ratio = (threshold - 0.5) / 100.0
    close = (F.col("x.n") >= F.col("y.n") * ratio - 1e-9) & (F.col("y.n") >= F.col("x.n") * ratio - 1e-9)
    pairs = x.join(y, F.col("x.e") == F.col("y.e")).filter((F.col("x.o") < F.col("y.o")) & close)
    pairs = pairs.select(F.col("x.o").alias("a"), F.col("y.o").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()
    left, right = distinct.select(F.col("o").alias("a"), "e"), distinct.select(F.col("o").alias("b"), F.col("e").alias("e2"))
    both = pairs.join(left, "a").join(right, (right.b == pairs.b) & (F.col("e") == F.col("e2"))).drop(right.b)
    counted = both.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("both"))
    score = names.jaccard_score(F.col("both"), F.col("n_a"), F.col("n_b"))
    return counted.withColumn("score", score).filter(F.col("score") >= threshold)


def near_words(values: DataFrame, most: int, width: int) -> DataFrame:
    """(p, q, distance): distinct values p < q of `width` bits (column w, an array of 64-bit words) within `most` bits.

    Pigeonhole: cut into more than most // 3 chunks, a pair within the distance differs by two bits at most in some
    chunk; both sides are looked up under each chunk and each change of one of its bits, so such a pair meets. Rows
    grow with the distinct values only.
    """
    most = min(most, width)
    n_chunks = most // 3 + 1
    cuts = sorted({round(i * width / n_chunks) for i in range(n_chunks + 1)} | set(range(0, width, 64)))
    chunks, widest = [], max(hi - lo for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = F.shiftrightunsigned(F.col("w")[lo // 64], lo % 64).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
        chunks.append(F.struct(F.lit(i).alias("i"), F.lit(hi - lo).alias("n"), part.alias("v")))
    cut = values.select("w", F.explode(F.array(*chunks)).alias("c"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(widest)])
    probes = cut.select("w", "c", F.posexplode(flips).alias("b", "flip")).filter(F.col("b") <= F.col("c.n"))
    probes = probes.select("c.i", F.col("c.v").bitwiseXOR(F.col("flip")).alias("v"), "w")
    met = probes.withColumnRenamed("w", "p").join(probes.withColumnRenamed("w", "q"), ["i", "v"]).filter(F.col("p") < F.col("q"))
    return met.select("p", "q", bits.words_distance(F.col("p"), F.col("q")).alias("distance")).filter(F.col("distance") <= most).distinct()


def hamming_pairs(hashes: DataFrame, id_col: str, hash_col: str, most: int, width: int = 64) -> DataFrame:
    """(a, b, distance): ids with hashes (arrays of 64-bit words, `width` bits) within `most` bits; the least distance where an id has several.

    Equal hashes are one value while they are compared.
    """
    each = hashes.select(F.col(id_col).alias("id"), F.col(hash_col).alias("w")).distinct()
    values = each.select("w").distinct()
    found = near_words(values, most, width).unionByName(values.select(F.col("w").alias("p"), F.col("w").alias("q"), F.lit(0).alias("distance")))
    x, y = each.select(F.col("id").alias("x"), F.col("w").alias("p")), each.select(F.col("id").alias("y"), F.col("w").alias("q"))
    pairs = found.join(x, "p").join(y, "q").filter(F.col("x") != F.col("y"))
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("distance").alias("distance"))


def band_pairs(media: DataFrame, tolerance: float, most: int) -> DataFrame:
    """(a, b, delta, distance): media whose durations differ by at most `tolerance` and fingerprints by `most` bits.

    media: id, duration, fingerprint (64 hex digits, parsed once). Distinct fingerprints are compared first; then media
    are joined by fingerprint and duration band (as wide as the tolerance; each is compared with its own band and its
    neighbours). What shares both is a match, so work grows with the result; adaptive execution splits a fingerprint
    and band that many media share. NaN durations are outside every band.
    """
    width = max(tolerance * (1 + 1e-9), 1e-9)  # a little wider, so that no rounding parts a pair by two bands
    m = media.filter(~F.isnan("duration") & F.col("fingerprint").isNotNull()).withColumn("band", F.floor(F.col("duration") / width).cast("long"))
    m = m.select("id", "duration", "band", bits.hex_words(F.col("fingerprint")).alias("w"))
    x = m.select(F.col("id").alias("x"), F.col("duration").alias("dx"), F.col("w").alias("p"), F.col("band").alias("bx"))
    y = m.select(F.col("id").alias("y"), F.col("duration").alias("dy"), F.col("w").alias("q"), "band")
    own_or_next = y.withColumn("bx", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumnRenamed("q", "p")
    same = x.join(own_or_next, ["p", "bx"]).filter((F.col("band") > F.col("bx")) | (F.col("x") < F.col("y")))
    near = near_words(m.select("w").distinct(), most, 256)
    around = y.withColumn("bx", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    other = x.join(near, "p").join(around, ["q", "bx"])
    columns = ["x", "y", F.abs(F.col("dx") - F.col("dy")).alias("delta")]
    pairs = same.select(*columns, F.lit(0).alias("distance")).unionByName(other.select(*columns, "distance")).filter(F.col("delta") <= tolerance)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "delta", "distance").filter("a != b")


def grouped(pairs: DataFrame) -> DataFrame:
    """(node, comp) over the pairs' links; comp is the smallest node of a component."""
    return components(pairs.select("a", "b"))
