"""Line-first quality rules, in built-in expressions only.

Each line is judged by punctuation, navigation, symbol, capital and boilerplate rules; failing lines go,
and a document that loses too much of its text, or fails the base rules, is rejected.

Defined cases: a null text has no words, no lines and is rejected; empty and white-space lines are
neither kept nor counted as lost; very long texts and lines are judged whole; equal lines are judged alike, each counted; a
document at a limit passes it; repeated rows are judged one by one; an empty table gives no rows; further columns pass
through `line_first_clean` untouched, whatever their names, but for one named as the result (`into`), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._names import fresh
from siftwell.llm._store import spread

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie (policy|settings)|privacy policy|terms of (use|service)|"
    r"click here|sign up|log ?in to|subscribe (now|to)|enable javascript|share (this|on)|read more)"
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")


def repeated_words(words: Column, n: Column, k: int = 5) -> Column:
    """Words in k-word windows that occur twice or more. Windows are hashed first; where hashes repeat,
    the windows themselves are sorted, so that only equal windows count."""
    starts = F.sequence(F.lit(0), n - k)
    keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, k)).alias("k"), i.alias("i"))))

    def covered(found: Column) -> Column:
        again = F.filter(
            found,
            lambda x, j: F.coalesce(F.get(found, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(found, j + 1)["k"] == x["k"], F.lit(False)),
        )
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        begin = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-k).alias("last"))
        step = lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(k), p - acc["last"])).alias("sum"), p.alias("last"))
        return F.aggregate(at, begin, step, lambda acc: acc["sum"])

    exact = let(windows, covered)
    distinct = let(keys, lambda x: F.size(F.array_distinct(x)) == F.size(x))
    return F.when(n < k, F.lit(0).cast("long")).when(distinct, F.lit(0).cast("long")).otherwise(exact)


def line_fails(line: Column) -> Column:
    """Whether a line with a word fails: navigation, symbols, capitals, boilerplate, or no punctuation."""

    def judged(n: Column) -> Column:
        letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
        capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
        navigation = line.rlike(r"[|»›·][^|»›·]*[|»›·][^|»›·]*[|»›·]")
        symbolic = line.rlike(r"[#*$%&|<>]") & (10 * symbols_in(line) > 3 * n)
        shouted = (n >= 4) & (10 * capitals > 7 * letters)
        boilerplate = (n <= 20) & line.rlike(BOILERPLATE)
        ended = line.rlike(r"[.!?:;…。！？\"'”’»)\]][\x20\x09-\x0D]*$")
        unpunctuated = ~ended & ((n < 4) | ~line.rlike(r"[.!?,;:]"))
        return navigation | symbolic | boilerplate | unpunctuated | shouted

    return let(F.size(words_of(line)), judged)


def line_first_clean(docs: DataFrame, text: str = "text", into: str = "quality", least_kept: float = 0.5, min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """docs with a struct column `into`: the counts, the cleaned text, the share kept and the verdict."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = fresh(docs, "words", "lines", "left", "repeat", "clean", "chars")
    w, lines, left, repeat, clean, n_chars = (F.col(x) for x in names)
    chars = lambda x: F.length(F.regexp_replace(x, SPACE, ""))
    staged = docs
    for name, value in zip(
        names,
        (
            words_of(body), F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.filter(lines, lambda x: ~line_fails(x)),
            repeated_words(w, F.size(w)), F.array_join(left, "\n"), chars(body).cast("long"),
        ),
        strict=True,
    ):
        staged = staged.withColumn(name, value)
    n = F.size(w).cast("long")
    failed = (n < min_words) | (100 * repeat > most_repeated * n)
    share = F.when(n_chars > 0, chars(clean) / n_chars).otherwise(F.lit(0.0))
    kept = ~failed & (share >= least_kept)
    out = F.struct(
        n.alias("n_words"),
        n_chars.alias("word_chars"),
        symbols_in(body).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        kept.alias("kept"),
        (F.size(lines) - F.size(left)).cast("long").alias("n_failed_lines"),
        F.round(share, 6).alias("kept_share"),
        clean.alias("clean_text"),
    )
    return staged.withColumn(into, out).drop(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    q = line_first_clean(docs).select("doc_id", "quality.*")
    return q.drop("clean_text")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id
), l AS (
  SELECT doc_id, lines, w, t, list_filter(lines, lambda x: NOT (
      length(regexp_replace(x, '[^|»›·]', '', 'g')) >= 3
      OR 10 * length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 3 * len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))
      OR (len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) >= 4
          AND 10 * length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) > 7 * length(regexp_replace(x, '[^\p{L}]', '', 'g')))
      OR (len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) <= 20 AND regexp_matches(x, '__BOILERPLATE__'))
      OR (NOT regexp_matches(x, '[.!?:;…。！？"''”’»)\]][\x20\x09-\x0D]*$')
          AND (len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) < 4 OR NOT regexp_matches(x, '[.!?,;:]')))
    )) AS kept_lines
  FROM s
), c AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (len(lines) - len(kept_lines))::BIGINT AS n_failed_lines,
    length(regexp_replace(array_to_string(kept_lines, chr(10)), '[\x20\x09-\x0D]+', '', 'g'))::DOUBLE AS left_chars
  FROM l LEFT JOIN rep ON rep.doc_id = l.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND left_chars >= 0.5 * word_chars AND word_chars > 0 AS kept,
  n_failed_lines,
  CASE WHEN word_chars > 0 THEN round(left_chars / word_chars, 6) ELSE 0.0 END AS kept_share
FROM c
""".replace("__BOILERPLATE__", BOILERPLATE)
