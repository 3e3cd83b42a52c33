"""License scan against brute force over all runs of words, with vocabulary that is dense, spread and repeated."""

import random

from siftwell.llm import license_scan
from siftwell.llm.license_scan import TEMPLATES, template_sets, tokens_of

random.seed(21)
VOCABULARY = sorted({w for _, t in TEMPLATES for w in tokens_of(t)})


def judged(text):
    words, labels, score = tokens_of(text or ""), set(), 0.0
    for label, width, need, tokens in template_sets(TEMPLATES, 0.8):
        held = max((len(set(words[i : i + width]) & set(tokens)) for i in range(len(words))), default=0)
        if held >= need:
            labels.add(label)
            score = max(score, held / len(tokens))
    return labels, round(score, 6)


def test_against_all_runs(spark):
    texts = [None, "", "\n", " ".join(random.choices(VOCABULARY, k=3000))]
    for _, t in TEMPLATES:
        words = t.split()
        wrapped = "".join(w + random.choice([" ", "\n# ", "\n"]) for w in words)
        texts += [t, wrapped.upper(), f"{t} {t}", " ".join(words[: len(words) * 4 // 5]), "\n".join(w + " filler" * 3 for w in words)]
        texts.append(" ".join(random.choices(VOCABULARY + ["other"] * 60, k=200)) + f" {t}")
        texts.append(" ".join(w if random.random() < 0.85 else "x" for w in words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    base = set(license_scan.PHRASES.values())
    for r in license_scan.license_scan(d).collect():
        labels, score = judged(texts[r.doc_id])
        own = set(r.base_labels.split(",")) - {""}
        assert own <= base and set(r.labels.split(",")) - {""} == labels | own, texts[r.doc_id]
        assert abs(r.score - score) < 1e-6, texts[r.doc_id]


def test_words_over_a_long_line_are_no_notice(spark):
    spread = " ".join(f"{w} {'word ' * 20}" for w in ("all", "rights", "reserved"))
    (row,) = license_scan.license_scan(spark.createDataFrame([(1, spread, "x")], "doc_id long, text string, norm string")).collect()
    assert (row.labels, row.score) == ("", 0.0)
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string, held int")).collect() == []
