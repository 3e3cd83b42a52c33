"""Operators against brute force, on texts with nulls, empties, ties, copies and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import decontaminate, license_scan, near_dedup, ngram_lm, packing, quality, suffix_dedup, token_rollup, url_filter, warc_zip
from siftwell.llm._store import new_path
from siftwell.llm._tokens import tokenizer_path

random.seed(5)
WORDS = [f"{a}{b}" for a in ("ta", "mé", "ro", "ßi", "lu") for b in ("ka", "no", "ri", "été", "s")]


def prose(n):
    return " ".join(random.choice(WORDS) + ("." if random.random() < 0.1 else "") for _ in range(n)) + "."


ITEM = prose(30)
LONG = prose(3000)
SHARED = prose(60)
TEXTS = [prose(random.randint(20, 80)) for _ in range(12)]
TEXTS += [TEXTS[0], TEXTS[0], TEXTS[1].upper(), TEXTS[2] + " tail.", None, "", "  \n ", "one", "One", LONG, f"{prose(20)} {ITEM} {prose(9)}", ITEM]
TEXTS += [f"{prose(15)} {SHARED} {prose(9)}" for _ in range(4)] + ["a" * 450, "a" * 450, "x | y | z | w\nAll rights reserved.", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "\U0001f600 " * 120]
ROWS = [(i, t, "en" if i % 2 else None, "s0", len(t or ""), i) for i, t in enumerate(TEXTS)] + [(None, "no id at all here.", None, None, 1, 1), (3, TEXTS[3], "en", "s0", 1, 3)]
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, `a.b` long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE).repartition(3).cache()


def none(spark):
    return spark.createDataFrame([], SHAPE)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_license_scan(spark, docs):
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_scan(docs).collect()}
    assert len(got) == len({(r[0], len(license_scan.tokens_of(r[1] or ""))) for r in ROWS})
    r = next(r for (_, n), r in got.items() if r.base_labels == "cc-by,mit")
    assert (r.n_base, r.first_word, r.last_word, r.labels, r.score) == (2, 3, 7, "cc-by,cc-by-nc,mit", 1.0)
    assert license_scan.license_scan(none(spark)).collect() == []


def test_license_notices_over_several_lines(spark):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n#\n# are met:"
    mit = " * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation\n * files (the \"Software\"), to deal in the\n * Software without restriction"
    apart = "Redistribution and use in source and binary forms, with or without\n" + prose(40) + "\nmodification, are permitted provided that the following conditions are met"
    texts = [f"{prose(30)}\n{bsd}\n{prose(30)}", f"{prose(9)}\n{mit}", f"{bsd}\n{mit}", "all or\nno rights\nare reserved", "All rights\nreserved.", apart]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(d).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("mit", 1.0), 2: ("bsd,mit", 1.0), 3: ("", 0.0), 4: ("proprietary", 1.0), 5: ("", 0.0)}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode
    rows = packing.pack(docs, capacity=512).collect()
    by = Counter()
    for r in rows:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 512 and len(by) == math.ceil(sum(by.values()) / 512)
    at = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(o == (0 if i == 0 or at[i - 1][0] != s else at[i - 1][1] + at[i - 1][2]) for i, (s, o, _) in enumerate(at))
    want = Counter()
    for ident, text, *_ in ROWS:
        ids = [*encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            want[ident, k, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack(none(spark)).collect() == []


def test_archives(spark, tmp_path):
    d = spark.createDataFrame([(1, "http://a/ \n", "x"), (2, None, "x"), (0, "u", None), (None, "u", ""), (5, "u", "é"), (5, "u", "é"), (7, "z", "é")], "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_zip.round_trip(d, archive_bytes=10).collect())
    assert got == Counter({(0, 0, "response", None): 1, (None, 0, "revisit", 0): 1, (1, 1, "response", None): 1, (2, 1, "revisit", 1): 1, (5, 2, "response", None): 2, (7, 2, "revisit", 5): 1})
    assert warc_zip.round_trip(d.limit(0)).collect() == []
    import io
    import struct
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as z:
        for n in ("a", "b"):
            with z.open(zipfile.ZipInfo(n), "w", force_zip64=True) as f:
                f.write(n.encode() * 5)
        z.comment = b"PK\x05\x06 not the end"
    raw = bytearray(made.getvalue())
    m = warc_zip.ZipMembers(io.BytesIO(raw), len(raw))
    assert m.range("b", 1, 3) == b"bbb" and sorted(m.members) == ["a", "b"]
    entries, length, offset = m._ends()  # the same directory behind ZIP64 records
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, length, offset)
    wide = bytes(raw[: offset + length]) + end64 + struct.pack("<4sIQI", b"PK\x06\x07", 0, offset + length, 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc_zip.ZipMembers(io.BytesIO(wide), len(wide)).range("a", 0, 5) == b"aaaaa"


def test_scores(spark, docs):
    got = {}
    for r in ngram_lm.score_documents(docs, block_bytes=2000).collect():
        got[r.doc_id] = r
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t, *_ in ROWS]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base) and -1e9 < r.score <= 0
    chain = {w: random.sample(WORDS, 3) for w in WORDS}  # words that tell what follows them
    rows = []
    for i in range(150):
        w = [random.choice(WORDS)]
        while len(w) < 60:
            w.append(random.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    out = [r for r in ngram_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.6 * sum(r.base_score for r in out)  # held-out accuracy
    assert ngram_lm.score_documents(none(spark)).collect() == []


@pytest.mark.parametrize(("order", "fan"), [(1, 8), (2, 1), (2, 2), (3, 8)])
def test_scores_by_brute_force(spark, order, fan):  # trees of one, three and more levels
    rows = [(i, t) for i, t, *_ in ROWS] + [(50 + i, prose(40)) for i in range(30)]
    folds = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i, _ in rows]
    texts = [["<s>"] * (order - 1) + [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for _, t in rows]
    grams = lambda t: [[tuple(t[i - k : i]) for k in range(order, 0, -1)] for i in range(order, len(t) + 1)]

    def model(use):
        c, h = Counter(), Counter()
        for t, f in zip(texts, folds, strict=True):
            for each in grams(t) if f in use else []:
                c.update(each)
                h.update(g[:-1] for g in each)
        return c, h, h[()]

    def look(counted, each, v):
        c, h, n = counted
        longest = next((g[:-1] for g in each[:-1] if h[g[:-1]]), ())
        bucket = (len(longest), h[longest].bit_length() if longest else 0)
        return bucket, [c[g] / h[g[:-1]] if h[g[:-1]] else 0.0 for g in each[:-1]] + [c[each[-1]] / max(n, 1), 1 / (v + 1)]

    full = model({0, 2, 3, 4})
    v = sum(len(g) == 1 for g in full[0])
    part = model({2, 3, 4})
    held = [look(part, each, v) for t, f in zip(texts, folds, strict=True) if f == 0 for each in grams(t)]
    seen = lambda b: [float(order - k <= b[0] + 1) for k in range(order)] + [1.0]
    weights = {}
    weight = lambda b: weights.get(b) or [x / sum(seen(b)) for x in seen(b)]
    for _ in range(5):
        sums = {}
        for b, parts in held:
            each = [x * y for x, y in zip(weight(b), parts, strict=True)]
            into = sums.setdefault(b, [0.0] * (order + 1))
            for k, x in enumerate(each):
                into[k] += x / sum(each)
        weights |= {b: [(x + 1e-3 * s) / (sum(into) + 1e-3 * sum(seen(b))) for x, s in zip(into, seen(b), strict=True)] for b, into in sums.items()}
    want = Counter()
    for (i, _), t in zip(rows, texts, strict=True):
        found = [look(full, each, v) for each in grams(t)]
        want[i, round(sum(math.log10(sum(x * y for x, y in zip(weight(b), parts, strict=True))) for b, parts in found), 6)] += 1
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_lm.score_documents(d, order=order, block_bytes=3000, fan=fan, rounds=5).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want


def test_decontamination(spark, docs):
    loud = ITEM.translate({ord("a"): "A", ord("."): "!", ord("r"): "R"})
    bench = spark.createDataFrame([(1, loud), (2, None), (3, ""), (4, "one"), (1, loud)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_bytes=50).collect())
    with_item = {i for i, t, *_ in ROWS if t and ITEM in t}
    assert set(got) == {(i, 1) for i in with_item} | {(i, 4) for i, t, *_ in ROWS if t and t.lower() == "one"} and len(with_item) == 2
    left = decontaminate.without_leaks(docs, bench)
    assert left.count() == len(ROWS) - 4 and left.columns == docs.columns


def test_decontamination_of_trimmed_items(spark):
    w = ITEM.split()  # 30 words, 26 shingles of 5: 21 of them are the least at 0.8
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([w[:-1], w[1:], w[2:-3], w[:24], w[:4], w[:12] + w[13:]])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: (r.first_word, r.n_words, round(r.similarity, 6)) for r in decontaminate.leaks(d, bench).collect()}
    assert got == {0: (0, 29, round(25 / 26, 6)), 1: (0, 29, round(25 / 26, 6)), 2: (0, 25, round(21 / 26, 6))}
    assert {r.doc_id for r in decontaminate.without_leaks(d, bench).collect()} == {3, 4, 5}


def test_rollup(spark, docs):
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "test"))
    words = {"w": None}
    assert rollup.totals().collect() == []
    assert rollup.commit("a", token_rollup.signed(docs, 1), words) and not rollup.commit("a", token_rollup.signed(docs, 1), words)
    assert rollup.commit("b", token_rollup.revised(docs.filter("doc_id = 19"), F.lit("two words")), words)
    assert rollup.commit("c", token_rollup.signed(docs.filter("doc_id < 3"), -1), words)
    want = Counter()
    for i, t, lang, source, *_ in ROWS:
        if i is None or i >= 3:
            want[source, lang] += len((("two words" if i == 19 else t) or "").encode().split())
    assert {(r.source, r.lang): r.n_tokens for r in rollup.totals().collect()} == dict(want)
    kept = token_rollup.counted(docs, ("doc_id",), words)
    assert kept.columns == ["doc_id", "source", "lang", "counts"] and token_rollup.counted(none(spark)).collect() == []
    assert rollup.commit("d", token_rollup.signed(kept.filter("doc_id IS NULL OR doc_id >= 3 AND doc_id <> 19"), -1))
    assert {(r.source, r.lang, r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {("s0", "en", 1, 2)}  # the revised one is left


def test_suffix_dedup(spark, docs):
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect())
    raw = [(i, (t or "").encode()) for i, t, *_ in ROWS]
    seen = Counter(b[j : j + 200] for _, b in raw for j in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    assert got == want and sum(r[2] for r in want) > 2000
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert suffix_dedup.remove_repeats(none(spark)).collect() == []


@pytest.mark.parametrize("limits", [(1500, 100), (40, 10)])
def test_near_dedup(spark, docs, monkeypatch, limits):
    monkeypatch.setattr(near_dedup, "TILE", limits[0])
    monkeypatch.setattr(near_dedup, "LARGE", limits[1])
    base = [f"w{i}" for i in range(120)]
    rows = [(i, t) for i, t, *_ in ROWS]
    for d in range(60):
        w = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 5, 8])):
            w[random.randrange(120)] = f"x{random.randrange(10**6)}"
        rows.append((1000 + d, " ".join(w)))
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    low = {i: i for i in sets}

    def find(x):
        return x if low[x] == x else find(low[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))


def test_urls(spark):
    d = spark.createDataFrame([(1, "http://A.example.net/es/1?x"), (2, None), (3, "no scheme"), (4, "https://www.example.com/en/2#t"), (5, "https://example.com/en/3"), (6, "ftp://example.org")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(d).collect()}
    assert got == {
        1: ("a.example.net", "/es/1", "net/es/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        5: ("example.com", "/en/3", "example.com/en/", "block"), 6: ("example.org", "", None, "allow"),
    }


def test_urls_without_labels_are_not_judged_by_labelled_siblings(spark):
    firsts = ["es"] * 4 + ["fr"] * 4 + ["en", "de", "7"] * 2  # rules label es and fr only, and only as block
    d = spark.createDataFrame([(i, f"http://shop.net/{s}/{i}.html") for i, s in enumerate(firsts)], "page_id long, url string")
    got = {r.page_id: (r.template, r.purity, r.verdict) for r in url_filter.url_verdicts(d).collect()}
    of = {"es": ("/*?/*", 0.7, "block"), "fr": ("/*?/*", 0.7, "block"), "en": ("/en/*", 0.1, "allow"), "de": ("/de/*", 0.1, "allow"), "7": ("/*/*", 0.1, "allow")}
    assert got == {i: of[s] for i, s in enumerate(firsts)}
    plain = {r.page_id: r.template for r in url_filter.url_verdicts(d.filter("url NOT LIKE '%/7/%'")).collect()}
    assert plain == {i: "/*/*" if s in ("es", "fr") else f"/{s}/*" for i, s in enumerate(firsts) if s != "7"}


def test_urls_below_the_third_segment_by_a_label_column(spark):
    rows = [(i, f"http://blog.org/a/b/c/{('spam', 'good')[i % 2]}/{i}", i % 2 == 0 if i < 20 else None) for i in range(24)]
    d = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: (r.rule, r.template, r.verdict) for r in url_filter.url_verdicts(d, label="bad").collect()}
    assert got == {i: (None, f"/*/*/*/{('spam', 'good')[i % 2]}/*", ("block", "allow")[i % 2]) for i in range(24)}
    assert {r.template for r in url_filter.url_verdicts(d, label="bad", depth=3).collect()} == {"/*/*/*/**"}
    assert url_filter.url_verdicts(d.limit(0)).collect() == []


def test_quality(spark, docs):
    got = quality.line_first_clean(docs).select("doc_id", "text", "quality.*", "`a.b`").collect()
    assert len(got) == len(ROWS)
    for r in got:
        w = (r.text or "").encode().split()
        at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {i + o for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for o in range(5)}
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (len(w), len(repeated), failed)
        assert not (r.kept and r.base_failed)


def test_pipeline(spark, docs, tmp_path):
    d = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, d)
        assert after.columns == now.columns, name
        after.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
    left = {r.doc_id: r.text for r in now.collect()}
    assert not any(ITEM in t for t in left.values()) and 0 in left and 12 not in left and 13 not in left
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in pieces} == set(left)
