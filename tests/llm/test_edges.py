"""Empty tables, clashing columns, repeated rows, long texts and odd ids, for the operators and each stage of the pipeline."""

import base64
import datetime
import decimal
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import ngram_lm, packing, quality, suffix_dedup, token_rollup, url_filter, warc_zip
from siftwell.llm._store import new_path

CLASH = "words string, lines string, `left` string, repeat string, clean string, chars string, quality string, row string, r1 long, r2 long, ranges string, c0 int, none int, rest string, `a.b` string"
SHAPE = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
OWN = ("w", "l", "f", "p", "c", "h", "q", "o", 1, 2, "g", 3, 4, "t", "d")
SENTENCE = "This is a plain sentence, one of several, with words enough to be kept as it stands. "


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), *OWN)


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, "which of these seven words would a careful reader of the text not expect")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, bench, stage):
    apply = dict(corpus_pipeline.STAGES)[stage]
    none = spark.createDataFrame([], SHAPE)
    assert apply(spark, none, bench).collect() == []
    text = " ".join(f"Word{i} goes{i} with{i} others{i}." for i in range(30))
    rows = [row(1, text), row(1, text, "other"), row(1, text), row(2, None), row(3, ""), row(None, "A row without an id that still has ten words or more in it."), row(4, text.upper()), row(5, SENTENCE + "x" * 300_000 + ".")]
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    out = apply(spark, docs, bench).collect()
    if stage == "packing":
        assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, None} and all(0 < r.length <= 2048 for r in out)
        return
    assert all(tuple(r)[5:] == OWN and list(r.asDict()) == docs.columns for r in out)
    ids = Counter(r.doc_id for r in out)
    if stage == "quality_rules":
        assert ids == {1: 3, 5: 1, None: 1}  # without words, or all in capitals: rejected
    elif stage == "near_duplicates":  # rows of one id and text are one; the least of what else they hold stays
        assert ids == {1: 1, 2: 1, 3: 1, 5: 1, None: 1} and next(r.source for r in out if r.doc_id == 1) == "other"
    elif stage == "repeated_strings":
        assert ids == {1: 3, 2: 1, 3: 1, 4: 1, 5: 1, None: 1} and all(len(r.text or "") == r.n_chars or r.text is None for r in out)
        assert all(r.text == "" for r in out if r.doc_id == 1)
    else:
        assert sum(ids.values()) == len(rows)


def test_quality_keeps_what_has_the_names_of_its_own_columns(spark):
    (r,) = quality.line_first_clean(spark.createDataFrame([row(1, SENTENCE)], SHAPE), into="judged").collect()
    assert tuple(r)[5:-1] == OWN and r.judged.kept
    assert quality.line_first_clean(spark.createDataFrame([], SHAPE)).collect() == []
    (r,) = suffix_dedup.cut_repeats(spark.createDataFrame([row(1, SENTENCE)], SHAPE)).collect()
    assert tuple(r)[5:] == OWN and r.text == SENTENCE


def test_archives_of_odd_ids_and_long_pages(spark):
    html = {"a\r\nX: y": "same", "%41": "same", "é ü": "z" * 3_000_000, "": "same"}
    d = spark.createDataFrame([(k, "http://h/", v, 1, "x") for k, v in html.items()], "page_id string, url string, html string, k1 int, `first` string")
    got = {r.page_id: r for r in warc_zip.round_trip(d).collect()}
    assert got.keys() == html.keys() and [k for k, r in got.items() if r.record_type == "response"] and all(got[k].refers_to == "" for k in ("%41", "a\r\nX: y"))
    for k, r in got.items():
        assert (r.payload_bytes, r.payload_digest) == (len(html[k]), base64.b32encode(hashlib.sha1(html[k].encode()).digest()).decode())
    days = spark.createDataFrame([(datetime.date(2020, 1, 2), decimal.Decimal("1.50"), "u", "x"), (datetime.date(2020, 1, 1), decimal.Decimal("0.10"), "u", "x")], "d date, n decimal(9,2), url string, html string")
    assert {(r.page_id, r.refers_to) for r in warc_zip.round_trip(days, "d").collect()} == {(datetime.date(2020, 1, 1), None), (datetime.date(2020, 1, 2), datetime.date(2020, 1, 1))}
    assert {(r.page_id, r.refers_to) for r in warc_zip.round_trip(days, "n").collect()} == {(decimal.Decimal("0.10"), None), (decimal.Decimal("1.50"), decimal.Decimal("0.10"))}


def test_rollup_snapshots(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", f"s{i % 2}") for i in range(6)], "doc_id long, text string, lang string, source string")
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "test"))
    rollup.compact()
    told = lambda: {(r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert rollup.commit("a", token_rollup.signed(docs, 1), {"w": None})
    rollup.compact()
    rollup.compact()
    assert told() == {("s0", 3, 9), ("s1", 3, 9)} and not rollup.commit("a", token_rollup.signed(docs, 1), {"w": None})
    assert rollup.commit("b", token_rollup.signed(docs.filter("doc_id < 2"), -1), {"w": None}) and told() == {("s0", 2, 6), ("s1", 2, 6)}
    rollup.compact()
    assert rollup.commit("c", token_rollup.signed(docs.filter("source = 's0' AND doc_id > 1"), -1), {"w": None}) and told() == {("s1", 2, 6)}


def test_a_hot_host_and_clashing_columns(spark):
    rows = [(i, f"http://hot.net/{'es' if i % 2 else 'en'}/{i}", "x", 1) for i in range(3000)] + [(-i - 1, f"http://h{i}.net/fr/{i}", "x", 1) for i in range(20)]
    d = spark.createDataFrame(rows, "page_id long, url string, host string, template int").repartition(5)
    got = {r.page_id: (r.host, r.verdict) for r in url_filter.url_verdicts(d).collect()}
    assert got == {i: ("hot.net", "block" if i % 2 else "allow") if i >= 0 else (f"h{-i - 1}.net", "block") for i, *_ in rows}


def test_scores_and_packing_of_long_and_repeated_texts(spark):
    rows = [(1, "a b " * 200_000), (2, "a b"), (2, "a b"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("fold", F.lit("x"))
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 4)) for r in ngram_lm.score_documents(d).collect())
    assert sorted(n for _, n, _ in got.elements()) == [1, 3, 3, 400_001] and max(got.values()) == 2
    pieces = packing.pack(d.withColumn("length", F.lit(5)).withColumn("salt", F.lit(5))).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) > 200_000 and Counter(r.doc_id for r in pieces)[2] == 2
