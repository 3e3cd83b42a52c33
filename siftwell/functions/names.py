"""File names: stems, extensions, normal forms and similarity scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """Lower-case extension; null without a dot after the first character, empty after a trailing dot."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)))


def normalized(value: Column) -> Column:
    """ASCII letters and digits in lower case, all else one space. Replaced before lower-casing: some
    non-ASCII letters have ASCII lower cases."""
    return F.trim(F.lower(F.regexp_replace(value, "[^A-Za-z0-9]+", " ")))


def tokens(norm: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(norm, " ")), "")


def jaccard_score(both: Column, left: Column, right: Column) -> Column:
    """0..100 from the sizes of the intersection and of the two sets; two empty sets score 100."""
    union = left + right - both
    return F.when(union == 0, F.lit(100)).otherwise(F.round(F.lit(100.0) * both / union)).cast("int")


def token_score(a: Column, b: Column) -> Column:
    return jaccard_score(F.size(F.array_intersect(tokens(a), tokens(b))), F.size(tokens(a)), F.size(tokens(b)))


def edit_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100)).otherwise(F.round(F.lit(100.0) * (longest - F.levenshtein(a, b)) / longest)).cast("int")


def name_score(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(100)).otherwise(F.greatest(token_score(a, b), edit_score(a, b)))


def name_reason(a: Column, b: Column, left: Column, right: Column) -> Column:
    """Why two stems match; the token score wins ties."""
    t, e = token_score(a, b), edit_score(a, b)
    return (
        F.when(a == b, F.lit("normalized filename match"))
        .when(t >= e, F.format_string("filename token similarity %d%%: %s / %s", t, left, right))
        .otherwise(F.format_string("filename edit similarity %d%%: %s / %s", e, left, right))
    )


def signature(relative: Column, size: Column) -> Column:
    return F.concat(normalized(relative), F.lit(":"), size.cast("string"))


def quarantine_name(path: Column) -> Column:
    return F.regexp_replace(path, r"[^A-Za-z0-9._-]", "_")
