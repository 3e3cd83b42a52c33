"""URL filter: host rules first, then a learned tree of path templates for each host.

For each host, paths are cut into segments and variable segments (numbers, long hexadecimal strings, dates)
become wildcards; then, level by level from the leaves, sibling templates whose labelled block rates do not
differ significantly are merged under a wildcard, so that sparse branches share their evidence. A branch without any
labelled row has no evidence that it is like its labelled siblings: it stays a template of its own. A template is
rejected when its smoothed purity, (blocked + prior * strength) / (labelled + strength), reaches a threshold.

Labels are the verdicts of the rules, or those of a boolean column (true = block). All counts are plain sums by
(host, template): partial sums are made before each shuffle, so a host with a third of all rows costs no more
than its distinct templates. Only distinct templates take part in merging.

Defined cases: a null url, or one without `://`, has an empty host and path and the single template `/`;
rows with equal urls get equal verdicts; without any labelled row the prior alone decides, and it allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm._store import discard, written
from siftwell.llm.license_scan import LOWER, UPPER

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Segments that stand for a value: numbers (with an extension), dates, long hexadecimal strings.
VARIABLE = r"^([0-9]+(\.[A-Za-z0-9]{1,5})?|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|[0-9a-fA-F-]{12,})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda value: F.coalesce(*[F.when(fits(h, p), F.lit(value(v, h, p))) for v, h, p in ordered])
    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def leaf_template(path: Column, depth: int) -> Column:
    """The first `depth` segments with variables as `*`; what lies deeper is one `**`."""
    segments = F.array_remove(F.split(path, "/"), "")
    shown = F.transform(F.slice(segments, 1, depth), lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))
    return F.concat(shown, F.when(F.size(segments) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))


def merged_templates(counts: DataFrame, depth: int, z: float) -> DataFrame:
    """(host, leaf, template): where each leaf template ends after merging similar siblings, deepest level first.

    A branch differs from its siblings when |p - q| > z * sqrt(m * (1 - m) * (1/n + 1/k)), with p over n of its own
    labelled rows, q over k of the others', m of both, each count smoothed by one half. An unlabelled branch stays on its
    own where a sibling is labelled; where none is, all are merged. Beside a branch `*` that stays on its own, the
    merged siblings are `*?`, which no segment of a path can be.
    """
    tree = last = counts.withColumn("template", F.col("leaf"))
    for level in range(depth, 0, -1):
        deep = F.size("template") >= level
        parent = F.concat_ws("/", F.slice("template", 1, level - 1))
        below = F.concat_ws("/", F.slice("template", level + 1, depth + 1))
        keyed = tree.withColumn("parent", F.when(deep, parent)).withColumn("below", F.when(deep, below)).withColumn("seg", F.when(deep, F.get("template", F.lit(level - 1))))
        branch = keyed.filter(deep).groupBy("host", "parent", "below", "seg").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
        total = branch.groupBy("host", "parent", "below").agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
        n, k = F.col("n") + 1.0, F.col("all_n") - F.col("n") + 1.0
        p, q = (F.col("b") + 0.5) / n, (F.col("all_b") - F.col("b") + 0.5) / k
        m = (F.col("all_b") + 1.0) / (F.col("all_n") + 2.0)
        differs = (F.col("n") > 0) & (F.col("all_n") > F.col("n")) & (F.abs(p - q) > z * F.sqrt(m * (1 - m) * (1 / n + 1 / k)))
        unlabelled = (F.col("n") == 0) & (F.col("all_n") > 0)
        kept = branch.join(total, ["host", "parent", "below"]).filter(differs | unlabelled).select("host", "parent", "below", "seg", F.lit(True).alias("own"))
        taken = kept.filter("seg = '*'").select("host", "parent", "below", F.lit("*?").alias("wild"))
        merged = F.when(F.col("seg") == "**", F.lit("**")).otherwise(F.coalesce("wild", F.lit("*")))
        tree = written(
            keyed.join(kept, ["host", "parent", "below", "seg"], "left").join(taken, ["host", "parent", "below"], "left")
            .withColumn("template", F.when(~deep | F.coalesce("own", F.lit(False)), F.col("template")).otherwise(
                F.concat(F.slice("template", 1, level - 1), F.array(merged), F.slice("template", level + 1, depth + 1))))
            .select("host", "leaf", "blocked", "labelled", "template"),
            "url-tree",
        )
        discard(last)  # a table of the round before; the first is the caller's
        last = tree
    return tree


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, depth: int | None = None, z: float = 1.96, prior: float = 0.1, strength: float = 4.0, purity: float = 0.6, label: str | None = None) -> DataFrame:
    """One row per page: host, path, the rule that fits, the template, its smoothed purity and the verdict.

    Templates have as many segments as the longest path, one round of merging each, or `depth` of them if it is given.
    `label` names a boolean column (true = block, null = unlabelled) that the templates learn from in place of the
    rules' verdicts; a rule that fits still decides its rows.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    own = F.lit(None).cast("boolean") if label is None else F.col(f"`{label}`")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), own.alias("own"))
    if depth is None:
        depth = parts.agg(F.max(F.size(F.array_remove(F.split("path", "/"), "")))).first()[0] or 0
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    blocks = F.col("ruled") == "block" if label is None else F.col("own")
    judged = parts.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("leaf", leaf_template(F.col("path"), depth))
    counts = judged.groupBy("host", "leaf").agg(F.count_if(blocks).alias("blocked"), F.count(blocks).alias("labelled"))
    tree = merged_templates(written(counts, "url-counts"), depth, z)
    sums = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
    score = (F.col("b") + prior * strength) / (F.col("n") + strength)
    learned = tree.join(sums, ["host", "template"]).select("host", "leaf", F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), F.round(score, 6).alias("purity"))
    return judged.join(learned, ["host", "leaf"]).select(
        "page_id", "host", "path", "rule", "template", "purity",
        F.coalesce("ruled", F.when(F.col("purity") >= purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(depth: int = 6) -> str:
    """For paths of up to `depth` segments."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    levels, last = "", "t0"
    for number, level in enumerate(range(depth, 0, -1), 1):
        t = f"t{number}"
        levels += f"""
, k{number} AS (SELECT *, len(template) >= {level} AS deep, array_to_string(template[1:{level - 1}], '/') AS parent,
    array_to_string(template[{level + 1}:], '/') AS below, template[{level}] AS seg FROM {last})
, b{number} AS (SELECT host, parent, below, seg, sum(blocked) AS b, sum(labelled) AS n FROM k{number} WHERE deep GROUP BY ALL)
, s{number} AS (SELECT *, sum(b) OVER w AS ab, sum(n) OVER w AS an FROM b{number} WINDOW w AS (PARTITION BY host, parent, below))
, o{number} AS (SELECT host, parent, below, seg FROM s{number} WHERE an > 0 AND (n = 0 OR an > n
    AND abs((b + 0.5) / (n + 1.0::DOUBLE) - (ab - b + 0.5) / (an - n + 1.0::DOUBLE))
      > 1.96 * sqrt((ab + 1.0::DOUBLE) / (an + 2.0) * (1 - (ab + 1.0::DOUBLE) / (an + 2.0)) * (1 / (n + 1.0::DOUBLE) + 1 / (an - n + 1.0::DOUBLE)))))
, {t} AS (SELECT k.host, k.leaf, k.blocked, k.labelled, CASE WHEN NOT deep OR o.seg IS NOT NULL THEN template
    ELSE list_concat(template[1:{level - 1}], [CASE WHEN w.seg IS NULL THEN '*' ELSE '*?' END], template[{level + 1}:]) END AS template
  FROM k{number} k LEFT JOIN o{number} o ON k.deep AND k.host = o.host AND k.parent = o.parent AND k.below = o.below AND k.seg = o.seg
  LEFT JOIN o{number} w ON k.deep AND k.host = w.host AND k.parent = w.parent AND k.below = w.below AND w.seg = '*')"""
        last = t
    return rf"""
WITH r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages)
, p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r)
, j0 AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM p)
, j AS (SELECT *, list_transform(segs, lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '*' ELSE s END) AS leaf FROM j0)
, t0 AS (SELECT host, leaf, count(*) FILTER (ruled = 'block') AS blocked, count(ruled) AS labelled, leaf AS template FROM j GROUP BY host, leaf){levels}
, g AS (SELECT host, template, sum(blocked) AS b, sum(labelled) AS n FROM {last} GROUP BY ALL)
, l AS (SELECT x.host, x.leaf, '/' || array_to_string(x.template, '/') AS template, round((b + 0.4::DOUBLE) / (n + 4.0::DOUBLE), 6) AS purity
    FROM {last} x JOIN g ON x.host = g.host AND x.template = g.template)
SELECT page_id, j.host, path, rule, l.template, purity::DOUBLE AS purity,
  coalesce(ruled, CASE WHEN purity >= 0.6 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN l ON j.host = l.host AND j.leaf = l.leaf
"""


SQL = _sql()
