"""Decontamination against all windows: near matches, trimmed items, empty inputs."""

import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import decontaminate

random.seed(11)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "zu", "x")]


def prose(n):
    return [random.choice(WORDS) for _ in range(n)]


def changed(words, n):
    words = list(words)
    for i in random.sample(range(len(words)), n):
        words[i] = f"w{random.randrange(10**6)}"
    return words


def grams(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def best(doc, item, k=5):
    """(similarity, first word, words) of the best window, by all of them."""
    n, found = min(len(item), len(doc)), None
    if len(item) >= k > n or not doc:
        return None
    for i in range(len(doc) - n + 1):
        a, b = grams(doc[i : i + n], min(k, len(item))), grams(item, min(k, len(item)))
        both = (a & b).total()
        s = both / (a.total() + b.total() - both)
        if both and s >= 0.8 - 1e-9 and (found is None or s > found[0]):
            found = s, i, n
    return found


def test_near_matches_against_all_windows(spark):
    items = {i: prose(n) for i, n in enumerate((3, 5, 9, 20, 20, 40, 40, 64, 96))}
    items[9] = ["again", "and"] * 20  # repeated shingles
    items[10] = list(items[3])
    docs = {}
    for i, w in items.items():
        for n in (0, 1, 2, 3):
            if n < len(w):
                docs[len(docs)] = prose(random.randint(0, 30)) + changed(w, n) + prose(random.randint(0, 30))
        docs[len(docs)] = w[:-1]
        docs[len(docs)] = w * 2
    docs[len(docs)] = prose(200)
    want = {(d, i): found for d, doc in docs.items() for i, item in items.items() if (found := best(doc, item))}
    assert any(0.8 <= s < 0.9 for s, *_ in want.values()) and len(want) > 20
    table = lambda rows, shape: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], shape).repartition(3)
    for block_bytes in (decontaminate.BLOCK_BYTES, 300):
        got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in decontaminate.leaks(table(docs, "doc_id long, text string"), table(items, "item_id long, text string"), block_bytes=block_bytes).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == (pytest.approx(want[k][0]), *want[k][1:]) for k in want)


def test_radius_holds_what_is_similar_enough():
    """Recall of the radius at the lowest similarity admitted, over random shingles and repeated ones."""
    rng = np.random.default_rng(4)
    missed = pairs = 0
    for m in (9, 16, 36, 64, 128):
        for spread in (1 << 63, m):  # shingles that hardly repeat, and such as repeat
            for _ in range(400):
                pool = decontaminate.shingles(rng.integers(0, 1 << 63, spread if spread == m else 2 * m).astype(np.uint64), 1)
                a = rng.choice(pool, m)
                b, change = a.copy(), rng.permutation(m)
                for i in change[: m // 9]:  # both / (2m - both) stays at 0.8 or above
                    b[i] = rng.integers(0, 1 << 63)
                print_a, print_b = (decontaminate.fingerprints(x, np.zeros(1, dtype=np.int64), m)[0] for x in (a, b))
                missed += int(np.bitwise_count(print_a ^ print_b)) > decontaminate.RADIUS
                pairs += 1
    assert missed / pairs < 1e-3


def test_look_ups_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 1 << 63, 16).astype(np.uint64) for _ in range(50)]
    index = decontaminate.SizeIndex(16, list(range(50)), lists)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(200)]
    prints = np.array([int(index.prints[i % 50]) ^ f for i, f in enumerate(flips)], dtype=np.uint64)
    got = {(p, i): d for p, i, d in index.look_up(prints, decontaminate.near_values(23 // decontaminate.BLOCKS), 23)}
    assert got == {(p, i): d for p, x in enumerate(prints) for i, y in enumerate(index.prints) if (d := (int(x) ^ int(y)).bit_count()) <= 23}


def test_empty_inputs_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 2, "x")], "doc_id long, text string, c0 int, item_id string")
    none, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, None), (2, ""), (3, "!?")], "item_id long, text string")
    for bench in (none, items):
        assert decontaminate.leaks(d, bench).collect() == [] and decontaminate.without_leaks(d, bench).collect() == d.collect()
    item = spark.createDataFrame([(1, "A b, c d e F")], "item_id long, text string")
    assert decontaminate.leaks(d.limit(0), item).collect() == [] and decontaminate.without_leaks(d, item).collect() == []
