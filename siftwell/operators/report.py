"""Reports: numbered groups, filters, previews, and nested, CSV, JSON and text forms."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns of a CSV report.
CSV_COLUMNS = ["mode", "group", "suggested_keep", "protected", "size", "algorithm", "hash", "reason", "path"]


def flatten_report(items: DataFrame, mode: str, keys: tuple[str, ...] = ("size", "hash")) -> DataFrame:
    """Item rows with the mode and the number of their group from 1: largest first, then by the first path.

    Groups are numbered by a range-partitioned sort of one row for each group.
    """
    from siftwell.operators.ranking import global_rank

    first = items.filter("rank = 1").select(*keys, F.split("path", "/").alias("__first"))
    numbers = global_rank(first, [F.col("size").desc(), F.col("__first")]).select(*keys, F.col("rank").cast("int").alias("group_number"))
    return items.join(numbers, list(keys)).withColumn("mode", F.lit(mode))


def prune(flat: DataFrame, gone: DataFrame) -> DataFrame:
    return flat.join(gone.select("group_number"), "group_number", "left_anti")


def text_filter(flat: DataFrame, needle: str) -> DataFrame:
    """All items of the groups of which the reason or a path contains the needle, case aside."""
    needle = needle.strip().lower()
    if not needle:
        return flat
    reason = F.lower("reason").contains(needle) if "reason" in flat.columns else F.lit(False)
    hit = flat.filter(reason | F.lower("path").contains(needle)).select("group_number").distinct()
    return flat.join(hit, "group_number", "left_semi")


def text_preview(text: Column, most: int = 1500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" [truncated]"))).otherwise(text)


def hex_preview(content: Column, most: int = 64) -> Column:
    return F.trim(F.regexp_replace(F.hex(F.substring(content, 1, most)), "(..)", "$1 "))


def nested(flat: DataFrame) -> DataFrame:
    """One row for each group, its items in an array in rank order."""
    item = F.struct("rank", "path", "size", "modified_unix", "is_protected", "suggested_keep")
    groups = flat.groupBy("group_number").agg(
        F.max("size").alias("size"), F.first("algorithm").alias("algorithm"), F.first("hash").alias("hash"), F.first("reason").alias("reason"), F.sort_array(F.collect_list(item)).alias("items")
    )
    drop_rank = lambda x: F.struct(*[x[c].alias(c) for c in ("path", "size", "modified_unix", "is_protected", "suggested_keep")])
    return groups.withColumn("items", F.transform("items", drop_rank)).orderBy("group_number")


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def as_csv(report: dict) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(CSV_COLUMNS)
    for n, g in enumerate(report["duplicate_groups"], 1):
        for i in g["items"]:
            w.writerow([report["mode"], n, str(i["suggested_keep"]).lower(), str(i["is_protected"]).lower(), i["size"], g["algorithm"], g["hash"], g["reason"], i["path"]])
    return out.getvalue()


def as_text(report: dict) -> str:
    """What a person reads: counts, errors, then each group with a marker for the copy to keep and for protected files."""
    counts = (
        ("Mode", report["mode"]), ("Match risk", report["risk"]), ("Scanned files", report["scanned_files"]), ("Candidate same-size groups", report["candidate_size_groups"]),
        ("Cache hits", report["cache_hits"]), ("Cache misses", report["cache_misses"]), ("Duplicate groups", len(report["duplicate_groups"])),
    )
    lines = [f"{name}: {value}" for name, value in counts]
    if report["errors"]:
        lines += ["", "Errors:", *[f"  - {e}" for e in report["errors"]]]
    for n, g in enumerate(report["duplicate_groups"], 1):
        lines += ["", f"Group {n} | size={g['size']} | {g['algorithm']} | {g['reason']}"]
        lines += [f"  [{'KEEP' if i['suggested_keep'] else 'DUP '}]{' protected' * i['is_protected']} {i['path']}" for i in g["items"]]
    return "\n".join(lines) + "\n"
