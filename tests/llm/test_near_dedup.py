"""Near duplicates among rows that share ids, and on tables without rows or with clashing names."""

from siftwell.llm import near_dedup

A, B, C = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")


def test_rows_that_share_an_id_are_one_vertex(spark):
    rows = [(1, A), (5, A), (0, B), (1, B), (7, C), (7, None), (8, C), (6, C), (None, C), (9, ""), (3, "short"), (3, "short")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(1, 2, 0, False), (5, 2, 0, False), (0, 2, 0, True), (1, 2, 0, False), (7, 2, 6, False), (7, 0, 6, False), (8, 2, 6, False), (6, 2, 6, True), (None, 2, None, True), (9, 0, 9, True), (3, 1, 3, True), (3, 1, 3, True)]
    assert got == sorted(want, key=str)


def test_empty_tables_and_other_columns(spark):
    shape = "doc_id long, text string, node long, comp string, `key` int, sig string"
    assert near_dedup.near_components(spark.createDataFrame([], shape)).collect() == []
    (row,) = near_dedup.near_components(spark.createDataFrame([(4, A, 1, "x", 2, "y")], shape)).collect()
    assert (row.doc_id, row.component_id, row.kept) == (4, 4, True)
