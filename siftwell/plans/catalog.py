"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import bits, hashing, magic, names, tags
from siftwell.operators import cache_join, ranking, refine, simjoin
from siftwell.operators.components import components
from siftwell.sources import tables
from siftwell.store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PREFIX = 256


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


DOCS = """docs AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size,
  doc_id AS modified_unix, source IN ('src0', 'src3') AS is_protected, text AS content FROM documents)"""
RANK = "row_number() OVER (PARTITION BY size, hash ORDER BY is_protected DESC, modified_unix NULLS FIRST, len(string_split(path, '/')), lower(path), path)"
EXACT = f"""{DOCS}, items AS (
  SELECT *, {RANK} AS rank FROM (SELECT *, sha256(content) AS hash, count(*) OVER (PARTITION BY size, sha256(content)) AS n FROM docs) WHERE n > 1)"""


def exact_items(spark, sf_dir, **options) -> DataFrame:
    groups = refine.exact_groups(tables.documents(spark, sf_dir), prefix_bytes=PREFIX, **options)
    return ranking.ranked(groups.drop("content"), ["size", "hash"])


@query(f"WITH {EXACT} SELECT path, size, hash, rank::INTEGER AS rank, rank = 1 AS suggested_keep FROM items")
def exact_groups(spark, sf_dir):
    return exact_items(spark, sf_dir).select("path", "size", "hash", "rank", "suggested_keep")


@query(f"WITH {EXACT} SELECT path, size, hash, 'same size + same full hash, byte-by-byte verified' AS reason FROM items")
def exact_byte_verified(spark, sf_dir):
    return exact_items(spark, sf_dir, byte_verify=True).select("path", "size", "hash", "reason")


@query(f"""WITH {DOCS}, s AS (SELECT *, count(*) OVER (PARTITION BY size) AS a FROM docs),
p AS (SELECT *, CASE WHEN size <= {PREFIX} THEN '' ELSE hex(encode(content)[1:{PREFIX}]) END AS pre FROM s WHERE a > 1)
SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size, pre) AS b FROM p) WHERE b > 1""")
def exact_prefix_candidates(spark, sf_dir):
    sized = refine.at_least_two(tables.documents(spark, sf_dir), ["size"])
    start = sized.withColumn("pre", F.when(F.col("size") <= PREFIX, F.lit("")).otherwise(F.hex(F.substring("content", 1, PREFIX))))
    return refine.at_least_two(start, ["size", "pre"]).select("path", "size")


@query(f"""WITH {EXACT} SELECT (SELECT count(*) FROM docs)::BIGINT AS scanned_files,
(SELECT count(*) FROM (SELECT size FROM docs GROUP BY size HAVING count(*) > 1))::BIGINT AS candidate_size_groups,
(SELECT count(DISTINCT (size, hash)) FROM items)::BIGINT AS duplicate_groups, (SELECT count(*) FROM items)::BIGINT AS duplicate_items""")
def exact_summary_counts(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    scanned = docs.agg(F.count(F.lit(1)).alias("scanned_files"))
    candidates = docs.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("candidate_size_groups"))
    groups = refine.exact_groups(docs, prefix_bytes=PREFIX).groupBy("size", "hash").agg(F.count(F.lit(1)).alias("n"))
    found = groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_items"))
    return scanned.crossJoin(candidates).crossJoin(found)  # three single rows


@query(f"WITH {DOCS} SELECT * EXCLUDE (n, content) FROM (SELECT path, size, content, count(*) OVER (PARTITION BY size, content) AS n FROM docs) WHERE n > 1")
def xxh3_groups(spark, sf_dir):
    return refine.exact_groups(tables.documents(spark, sf_dir), "xxh3_128", PREFIX).select("path", "size")


@query("SELECT * EXCLUDE (n) FROM (SELECT item_id, count(*) OVER (PARTITION BY text) AS n, count(*) OVER (PARTITION BY text) > 1 AS has_copy FROM benchmark)")
def blake3_groups(spark, sf_dir):
    items = tables.table(spark, sf_dir, "benchmark").withColumn("hash", hashing.content_hash(F.encode("text", "UTF-8"), "blake3"))
    n = items.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return items.join(n, "hash").select("item_id", (F.col("n") > 1).alias("has_copy"))


def _keep(rule: str, order: str):
    sql = f"WITH {EXACT} SELECT path, size, hash, row_number() OVER (PARTITION BY size, hash ORDER BY {order}) = 1 AS keep FROM items"

    def run(spark, sf_dir):
        return ranking.keep_rank(exact_items(spark, sf_dir), ["size", "hash"], rule).select("path", "size", "hash", "keep")

    run.__name__ = rule.replace("-", "_")
    query(sql)(run)


_keep("keep-newest", "coalesce(modified_unix, -9223372036854775808) DESC, rank DESC")
_keep("keep-oldest", "coalesce(modified_unix, 9223372036854775807), rank")
_keep("keep-suggested", "rank")


def plan_items(spark, sf_dir) -> DataFrame:
    kept = ranking.keep_rank(exact_items(spark, sf_dir), ["size", "hash"], "keep-newest")
    target = kept.filter("keep").select("size", "hash", F.col("path").alias("replacement_target"))
    return kept.join(target, ["size", "hash"])


PLAN = f"""{EXACT}, kept AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY coalesce(modified_unix, -9223372036854775808) DESC, rank DESC) = 1 AS keep FROM items)"""


@query(f"""WITH {PLAN} SELECT k.path, k.size, k.hash, t.path AS replacement_target FROM kept k JOIN kept t ON t.keep AND k.size = t.size AND k.hash = t.hash
WHERE NOT k.keep AND NOT k.is_protected""")
def action_plan_items(spark, sf_dir):
    return plan_items(spark, sf_dir).filter("NOT keep AND NOT is_protected").select("path", "size", "hash", "replacement_target")


@query(f"""WITH {PLAN} SELECT count(DISTINCT (size, hash))::BIGINT AS groups_considered, (count(*) FILTER (NOT keep AND NOT is_protected))::BIGINT AS items_selected,
(count(*) FILTER (NOT keep AND is_protected))::BIGINT AS protected_skipped FROM kept""")
def action_plan_summary(spark, sf_dir):
    flags = plan_items(spark, sf_dir)
    each = flags.groupBy("size", "hash").agg(F.count_if(F.expr("NOT keep AND NOT is_protected")).alias("s"), F.count_if(F.expr("NOT keep AND is_protected")).alias("p"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return each.agg(F.count(F.lit(1)).alias("groups_considered"), none("s").alias("items_selected"), none("p").alias("protected_skipped"))


@query(f"""WITH {PLAN}, now AS (SELECT path, CASE WHEN modified_unix % 7 = 0 THEN size + 1 ELSE size END AS size FROM docs WHERE modified_unix % 11 <> 0)
SELECT k.path, CASE WHEN n.path IS NULL THEN 'file is not available' WHEN n.size <> k.size THEN 'size changed' ELSE 'ok' END AS status
FROM kept k LEFT JOIN now n ON n.path = k.path WHERE NOT k.keep AND NOT k.is_protected""")
def plan_validation(spark, sf_dir):
    """Planned items against a later state of the files, in which some have changed and some are gone."""
    changed = F.when(F.col("modified_unix") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    now = tables.documents(spark, sf_dir).filter("modified_unix % 11 <> 0").select("path", changed.alias("now_size"))
    joined = plan_items(spark, sf_dir).filter("NOT keep AND NOT is_protected").join(now, "path", "left")
    status = F.when(F.col("now_size").isNull(), "file is not available").when(F.col("now_size") != F.col("size"), "size changed").otherwise("ok")
    return joined.select("path", status.alias("status"))


PAGE = "'/' || CASE page_id % 5 WHEN 0 THEN '.cache/' WHEN 1 THEN 'a/' ELSE 'src3x/' END || CASE WHEN page_id % 9 = 0 THEN 'Thumbs.db' ELSE page_id || '.html' END"


def page_paths(spark, sf_dir) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", F.expr(PAGE).alias("path"))


@query(f"SELECT page_id, p AS path FROM (SELECT page_id, {PAGE} AS p FROM pages) WHERE NOT starts_with(p, '/.') AND lower(p) NOT LIKE '%/thumbs.db'")
def hidden_filter(spark, sf_dir):
    return page_paths(spark, sf_dir).filter(~tables.hidden(F.col("path")))


@query(f"SELECT page_id, starts_with(p, '/a/') OR starts_with(p, '/src3/') AS is_protected FROM (SELECT page_id, {PAGE} AS p FROM pages)")
def protected_prefix(spark, sf_dir):
    return page_paths(spark, sf_dir).select("page_id", tables.under(F.col("path"), ("/a", "/src3")).alias("is_protected"))


NORM = "trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')))"


@query(f"SELECT page_id, {NORM.format('url')} AS norm FROM pages")
def name_normalized(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", names.normalized(F.col("url")).alias("norm"))


LAST = "string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1]"


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN regexp_extract(n, '(?s)^(.+)\.[^.]*$', 1) ELSE n END AS stem,
CASE WHEN regexp_matches(n, '^.+\.[^.]*$') THEN lower(regexp_extract(n, '^.+\.([^.]*)$', 1)) END AS ext FROM (SELECT page_id, {LAST} AS n FROM pages)""")
def name_stem_ext(spark, sf_dir):
    name = names.base_name(F.regexp_replace("url", "[?#].*$", ""))
    return tables.table(spark, sf_dir, "pages").select("page_id", name.alias("n")).select("page_id", names.stem(F.col("n")).alias("stem"), names.extension(F.col("n")).alias("ext"))


TOKENS = "list_filter(list_distinct(string_split({0}, ' ')), lambda x: x <> '')"
NAME_PAIRS = f"""n AS (SELECT DISTINCT {NORM.format('p_name')} AS norm FROM part),
sc AS (SELECT x.norm AS a, y.norm AS b,
  CASE WHEN len(list_distinct(list_concat({TOKENS.format('x.norm')}, {TOKENS.format('y.norm')}))) = 0 THEN 100
    ELSE round(100.0::DOUBLE * len(list_intersect({TOKENS.format('x.norm')}, {TOKENS.format('y.norm')})) / len(list_distinct(list_concat({TOKENS.format('x.norm')}, {TOKENS.format('y.norm')})))) END AS t,
  CASE WHEN greatest(length(x.norm), length(y.norm)) = 0 THEN 100
    ELSE round(100.0::DOUBLE * (greatest(length(x.norm), length(y.norm)) - levenshtein(x.norm, y.norm)) / greatest(length(x.norm), length(y.norm))) END AS e
  FROM n x JOIN n y ON x.norm < y.norm),
pairs AS (SELECT a, b, greatest(t, e)::INTEGER AS score FROM sc WHERE greatest(t, e) >= 70)"""


def part_names(spark, sf_dir) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select(names.normalized(F.col("p_name")).alias("norm")).distinct()


@query(f"WITH {NAME_PAIRS} SELECT a, b, score FROM pairs")
def name_pairs(spark, sf_dir):
    return simjoin.name_pairs(part_names(spark, sf_dir), 70)


def closure(pairs: str) -> str:
    """Components of `pairs` (a, b), for WITH RECURSIVE."""
    return f"""{pairs}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS r FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.r),
lab AS (SELECT node, min(r) AS comp FROM reach GROUP BY node)"""


@query(f"""WITH RECURSIVE {closure(NAME_PAIRS)}, best AS (
  SELECT comp, a, b, score, row_number() OVER (PARTITION BY comp ORDER BY score DESC, a, b) AS i FROM pairs JOIN lab ON lab.node = a)
SELECT lab.node AS norm, lab.comp AS group_key, best.score AS best_score, best.a AS best_a, best.b AS best_b FROM lab JOIN best ON best.comp = lab.comp AND i = 1""")
def name_groups(spark, sf_dir):
    pairs = written(name_pairs(spark, sf_dir), "name-pairs")
    labels = simjoin.grouped(pairs)
    order = F.struct((-F.col("score")).alias("s"), "a", "b")
    best = pairs.join(labels.withColumnRenamed("node", "a"), "a").groupBy("comp").agg(F.min(order).alias("m"))
    best = best.select("comp", (-F.col("m.s")).alias("best_score"), F.col("m.a").alias("best_a"), F.col("m.b").alias("best_b"))
    return labels.join(best, "comp").select(F.col("node").alias("norm"), F.col("comp").alias("group_key"), "best_score", "best_a", "best_b")


FOLDER = """ent AS (SELECT DISTINCT l_orderkey AS o, l_partkey || ':' || l_quantity::BIGINT AS e FROM lineitem), sz AS (SELECT o, count(*) AS n FROM ent GROUP BY o),
bo AS (SELECT x.o AS a, y.o AS b, count(*) AS i FROM ent x JOIN ent y ON x.e = y.e AND x.o < y.o GROUP BY ALL),
pairs AS (SELECT a, b, i AS n_both, round(100.0::DOUBLE * i / (p.n + q.n - i))::INTEGER AS score FROM bo JOIN sz p ON p.o = a JOIN sz q ON q.o = b
  WHERE round(100.0::DOUBLE * i / (p.n + q.n - i)) >= 50)"""


@query(f"WITH {FOLDER} SELECT a, b, n_both, score FROM pairs")
def folder_jaccard_pairs(spark, sf_dir):
    return simjoin.set_pairs(tables.order_lines(spark, sf_dir), "l_orderkey", "entry", 50).select("a", "b", F.col("both").alias("n_both"), "score")


@query(f"WITH RECURSIVE {closure(FOLDER)} SELECT node AS folder, comp AS group_key FROM lab")
def folder_groups(spark, sf_dir):
    return simjoin.grouped(folder_jaccard_pairs(spark, sf_dir)).select(F.col("node").alias("folder"), F.col("comp").alias("group_key"))


@query("SELECT l_orderkey AS folder, count(*)::BIGINT AS file_count, sum(l_quantity::BIGINT)::BIGINT AS total_size, count(DISTINCT l_partkey || ':' || l_quantity::BIGINT)::BIGINT AS n_entries FROM lineitem GROUP BY l_orderkey")
def folder_signatures(spark, sf_dir):
    e = tables.order_lines(spark, sf_dir)
    return e.groupBy(F.col("l_orderkey").alias("folder")).agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_size"), F.count_distinct("entry").alias("n_entries"))


HASHES = """px AS (SELECT vec_id, greatest(0, least(255, floor((unnest(embedding)::DOUBLE + 1) * 128)))::BIGINT AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
st AS (SELECT vec_id, sum(x)::BIGINT // 64 AS mean FROM px GROUP BY vec_id)"""
AHASH = """(sum(CASE WHEN x >= mean AND {0} > 0 THEN 1::HUGEINT << (63 - {0})::INTEGER ELSE 0 END) - (max(CASE WHEN x >= mean AND {0} = 0 THEN 1 ELSE 0 END)::HUGEINT * 9223372036854775808))::BIGINT"""
IMG = f"""{HASHES}, h AS (SELECT vec_id, {AHASH.format('i')} AS ahash FROM px JOIN st USING (vec_id) GROUP BY vec_id)"""


def image_hashes(spark, sf_dir) -> DataFrame:
    return tables.images(spark, sf_dir).select("vec_id", bits.average_hash(F.col("pixels")).alias("ahash"))


@query(f"WITH {IMG} SELECT vec_id, ahash FROM h")
def image_ahash(spark, sf_dir):
    return image_hashes(spark, sf_dir).select("vec_id", F.col("ahash")[0].alias("ahash"))


IMG_PAIRS = f"""{IMG}, pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.ahash, y.ahash))::INTEGER AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id
WHERE bit_count(xor(x.ahash, y.ahash)) <= 20)"""


@query(f"WITH {IMG_PAIRS} SELECT a, b, distance, round(100.0::DOUBLE * (64 - distance) / 64)::INTEGER AS score FROM pairs")
def image_hamming_pairs(spark, sf_dir):
    return simjoin.hamming_pairs(image_hashes(spark, sf_dir), "vec_id", "ahash", 20).withColumn("score", bits.image_score(F.col("distance")))


@query(f"WITH RECURSIVE {closure(IMG_PAIRS)} SELECT node AS vec_id, comp AS group_key FROM lab")
def image_groups(spark, sf_dir):
    return simjoin.grouped(image_hamming_pairs(spark, sf_dir)).select(F.col("node").alias("vec_id"), F.col("comp").alias("group_key"))


_R = {"base": "i", "rot90": "((i % 8) * 8 + 7 - i // 8)", "rot180": "(63 - i)", "rot270": "((7 - i % 8) * 8 + i // 8)", "flip": "(i // 8 * 8 + 7 - i % 8)"}


@query(f"""WITH {HASHES}, v AS (SELECT vec_id, [{', '.join(AHASH.format(x) for x in _R.values())}] AS hs FROM px JOIN st USING (vec_id) GROUP BY vec_id),
d AS (SELECT x.vec_id AS a, y.vec_id AS b, list_min(flatten(list_transform(x.hs, lambda p: list_transform(y.hs, lambda q: bit_count(xor(p, q))))))::INTEGER AS distance
FROM v x JOIN v y ON x.vec_id < y.vec_id) SELECT a, b, distance FROM d WHERE distance <= 20""")
def image_rotation_min(spark, sf_dir):
    """Pairs of images within 20 bits in some orientation, over the whole table."""
    v = tables.images(spark, sf_dir).select("vec_id", F.explode(bits.hash_variants(F.col("pixels"), rotations=True)).alias("h"))
    return simjoin.hamming_pairs(v, "vec_id", "h", 20)


RAWS = f"SELECT p_partkey AS id, {NORM.format('p_name')} AS norm, CASE WHEN p_partkey % 3 = 0 THEN 'cr2' WHEN p_partkey % 3 = 1 THEN 'jpg' ELSE 'png' END AS ext FROM part"


@query(f"WITH f AS ({RAWS}) SELECT r.id AS raw_id, j.id AS jpeg_id, r.norm FROM f r JOIN f j ON r.norm = j.norm WHERE r.ext = 'cr2' AND j.ext = 'jpg'")
def raw_jpeg_pairs(spark, sf_dir):
    ext = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'cr2' WHEN p_partkey % 3 = 1 THEN 'jpg' ELSE 'png' END")
    f = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.normalized(F.col("p_name")).alias("norm"), ext.alias("ext"))
    raw = f.filter(magic.of_kind(F.col("ext"), magic.RAW)).select(F.col("id").alias("raw_id"), "norm")
    jpeg = f.filter(magic.of_kind(F.col("ext"), magic.JPEG)).select(F.col("id").alias("jpeg_id"), "norm")
    return raw.join(jpeg, "norm").select("raw_id", "jpeg_id", "norm")


@query("""WITH m AS (SELECT event_id AS id, value AS d, sha256(event_type || '|' || props) AS f FROM events)
SELECT x.id AS a, y.id AS b, round(abs(x.d - y.d), 6) AS delta, 100 AS score FROM m x JOIN m y ON x.f = y.f AND x.id < y.id AND abs(x.d - y.d) <= 0.5""")
def media_band_join(spark, sf_dir):
    """Fingerprints are digests, so those within 32 bits are equal ones; the SQL says so, the join does not assume it."""
    pairs = simjoin.band_pairs(tables.media(spark, sf_dir), 0.5, 32)
    return pairs.select("a", "b", F.round("delta", 6).alias("delta"), bits.media_score(F.col("distance")).alias("score"))


@query("""WITH m AS (SELECT event_id AS id, value AS d, sha256(event_type || '|' || props) AS f, event_type AS title, user_id % 5 AS artist, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 2 END AS album FROM events)
SELECT x.id AS a, y.id AS b, nullif(concat_ws(', ', CASE WHEN x.title = y.title THEN 'title' END, CASE WHEN x.artist = y.artist THEN 'artist' END, CASE WHEN x.album = y.album THEN 'album' END), '') AS basis
FROM m x JOIN m y ON x.f = y.f AND x.id < y.id AND abs(x.d - y.d) <= 0.5""")
def audio_metadata_reason(spark, sf_dir):
    """Tags shared by all pairs of media_band_join."""
    m = tables.media(spark, sf_dir)
    known = m.selectExpr("id", "event_type AS title", "user_id % 5 AS artist", "CASE WHEN id % 3 = 0 THEN NULL ELSE user_id % 2 END AS album")
    x, y = (known.select(F.col("id").alias(side), *[F.col(t).alias(f"{side}_{t}") for t in tags.AUDIO_TAGS]) for side in "ab")
    joined = simjoin.band_pairs(m, 0.5, 32).select("a", "b").join(x, "a").join(y, "b")
    left, right = ({t: F.col(f"{side}_{t}") for t in tags.AUDIO_TAGS} for side in "ab")
    return joined.select("a", "b", tags.shared_tags(left, right).alias("basis"))


@query(f"""WITH {DOCS} SELECT path, size, row_number() OVER (ORDER BY is_protected DESC, size DESC, modified_unix NULLS FIRST, lower(path), path)::INTEGER AS rank FROM docs WHERE size >= 4096""")
def large_files(spark, sf_dir):
    """One review group. Ranks over all rows come from a range-partitioned sort and the sizes of its partitions, not from one task."""
    rows = tables.documents(spark, sf_dir).filter("size >= 4096").drop("content")
    return ranking.global_rank(rows, ranking.large_order()).select("path", "size", F.col("rank").cast("int").alias("rank"))


@query("""SELECT doc_id, '/' || source || '/' || doc_id || '.txt' AS path FROM documents WHERE octet_length(encode(CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END)) = 0""")
def empty_files(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("text")))
    return d.filter(F.octet_length("text") == 0).select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


@query("SELECT o_orderkey AS folder FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def empty_folders(spark, sf_dir):
    """Orders as folders, their lines as entries."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("folder"))
    return o.join(tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("folder")), "folder", "left_anti")


HEADS = [("FFD8FF00", "jpg"), ("89504E470D0A1A0A", "png"), ("474946383961", "gif"), ("524946460000000057454250", "webp"), ("524946460000000057415645", "wav"), ("504B0304", "docx"), ("4F676753", "opus"), ("", "txt")]


@query("WITH h AS (SELECT page_id, [" + ", ".join(f"'{a}'" for a, _ in HEADS) + "][page_id % 8 + 1] AS head, [" + ", ".join(f"'{b}'" for _, b in HEADS) + """][page_id // 8 % 8 + 1] AS ext FROM pages),
x AS (SELECT page_id, ext, CASE page_id % 8 WHEN 0 THEN ['jpg', 'jpeg'] WHEN 1 THEN ['png'] WHEN 2 THEN ['gif'] WHEN 3 THEN ['webp'] WHEN 4 THEN ['wav'] WHEN 5 THEN ['zip'] WHEN 6 THEN ['ogg', 'opus'] END AS expected FROM h)
SELECT page_id, ext FROM x WHERE expected IS NOT NULL AND NOT list_contains(expected, ext)""")
def bad_extensions(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    heads, exts = (F.array(*[F.lit(x[i]) for x in HEADS]) for i in (0, 1))
    content = F.concat(F.unhex(F.get(heads, (F.col("page_id") % 8).cast("int"))), F.encode(F.substring("html", 1, 8), "UTF-8"))
    rows = p.select("page_id", F.get(exts, F.floor(F.col("page_id") / 8).cast("int") % 8).alias("ext"), content.alias("content"))
    return rows.filter(magic.bad_extension(F.col("ext"), F.col("content"))).select("page_id", "ext")


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '(?is)^.*/en/[1-9].\.html$') OR regexp_matches(url, '(?is)^.*.PAGE=.*$')")
def ignore_patterns(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").filter(magic.ignored(F.col("url"), ["*/en/1?.html", "*/en/2?.html", "*/en/3?.html", "*/en/4?.html", "*/en/5?.html", "*/en/6?.html", "*/en/7?.html", "*/en/8?.html", "*/en/9?.html", "*?PAGE=*"])).select("page_id")


CACHE = """f AS (SELECT event_id AS id, '/m/' || event_id AS path, event_id % 50 AS inode, (value * 100)::BIGINT AS size, epoch(ts)::BIGINT AS mtime FROM events),
c AS (SELECT CASE WHEN id % 4 = 1 THEN '/old/' || id ELSE path END AS path, id AS cid, 'i' || id AS inode, size, mtime + id % 4 AS mtime, sha256('v' || id) AS hash FROM f WHERE id % 3 <> 0)"""


def cache_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("/m/"), F.col("event_id").cast("string")).alias("path"), F.lit("d").alias("device_id"), F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("inode"),
        F.round(F.col("value") * 100).cast("long").alias("size"), F.unix_timestamp("ts").alias("modified_unix"),
    )
    c = f.filter("id % 3 <> 0").select(
        F.when(F.col("id") % 4 == 1, F.concat(F.lit("/old/"), F.col("id").cast("string"))).otherwise(F.col("path")).alias("path"), "device_id", "inode", "size",
        (F.col("modified_unix") + F.col("id") % 4).alias("modified_unix"), F.lit("sha256").alias("algorithm"), F.lit("full").alias("scope"), F.lit(-1).cast("long").alias("bytes_hashed"),
        F.sha2(F.concat(F.lit("v"), F.col("id").cast("string")).cast("binary"), 256).alias("hash"), F.lit(0).cast("long").alias("created_unix"),
    )
    return f, c


@query("""WITH f AS (SELECT event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS mtime FROM events)
SELECT id, CASE WHEN id % 3 <> 0 AND id % 4 <= 2 THEN sha256('v' || id) END AS hash FROM f""")
def cache_hits_misses(spark, sf_dir):
    """Lookups by path or by identity, with times two seconds apart at most."""
    f, c = cache_tables(spark, sf_dir)
    return cache_join.lookup(f, c, "sha256", "full", -1, tolerance=2).select("id", "hash")


@query("""SELECT '/m/' || event_id AS path, sha256((CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'v' END) || event_id) AS hash FROM events WHERE event_id % 2 = 0 OR (event_id % 3 <> 0 AND event_id % 4 <> 1)
UNION ALL SELECT '/old/' || event_id, sha256('v' || event_id) FROM events WHERE event_id % 3 <> 0 AND event_id % 4 = 1""")
def cache_upsert(spark, sf_dir):
    f, c = cache_tables(spark, sf_dir)
    new = f.filter("id % 2 = 0").withColumn("hash", F.sha2(F.concat(F.lit("new"), F.col("id").cast("string")).cast("binary"), 256))
    new = new.select("path", "device_id", "inode", "size", "modified_unix", F.lit("sha256").alias("algorithm"), F.lit("full").alias("scope"), F.lit(-1).cast("long").alias("bytes_hashed"), "hash", F.lit(1).cast("long").alias("created_unix"))
    return cache_join.upsert(c, new).select("path", "hash")


CSV = f"""{EXACT}, g AS (SELECT size, hash, row_number() OVER (ORDER BY size DESC, string_split(max(path) FILTER (rank = 1), '/')) AS gn FROM items GROUP BY size, hash)"""


@query(f"WITH {CSV} SELECT 'exact' AS mode, gn::INTEGER AS group_number, size, path, rank = 1 AS suggested_keep FROM items JOIN g USING (size, hash)")
def report_csv_rows(spark, sf_dir):
    from siftwell.operators.report import flatten_report

    return flatten_report(exact_items(spark, sf_dir), "exact").select("mode", "group_number", "size", "path", "suggested_keep")


@query(f"WITH {CSV} SELECT gn::INTEGER AS group_number, count(*)::BIGINT AS n_items FROM items JOIN g USING (size, hash) WHERE gn % 3 <> 0 GROUP BY gn")
def report_prune(spark, sf_dir):
    from siftwell.operators.report import flatten_report, prune

    flat = flatten_report(exact_items(spark, sf_dir), "exact")
    gone = flat.select("group_number").distinct().filter("group_number % 3 = 0")
    return prune(flat, gone).groupBy("group_number").agg(F.count(F.lit(1)).alias("n_items"))


@query(f"WITH {CSV} SELECT gn::INTEGER AS group_number FROM items JOIN g USING (size, hash) GROUP BY gn HAVING bool_or(contains(lower(path), '/de/'))")
def report_text_filter(spark, sf_dir):
    from siftwell.operators.report import flatten_report, text_filter

    return text_filter(flatten_report(exact_items(spark, sf_dir), "exact"), " /DE/ ").select("group_number").distinct()


@query("""WITH m AS (SELECT source || '.zip!' || lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS hash FROM documents)
SELECT path, size, hash, row_number() OVER (PARTITION BY size, hash ORDER BY string_split(path, '/'), path) = 1 AS suggested_keep FROM (SELECT *, count(*) OVER (PARTITION BY size, hash) AS n FROM m) WHERE n > 1""")
def archive_member_groups(spark, sf_dir):
    """Sources as archives, their documents as members."""
    t = tables.table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit(".zip!"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    m = t.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))
    order = [F.split("path", "/"), F.col("path")]
    return ranking.ranked(refine.at_least_two(m, ["size", "hash"]), ["size", "hash"], order).select("path", "size", "hash", "suggested_keep")


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS quarantine_name FROM pages")
def quarantine_names(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", names.quarantine_name(F.col("url")).alias("quarantine_name"))


@query("SELECT doc_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || ' [truncated]' ELSE text END AS preview, trim(regexp_replace(hex(encode(text)[1:64]), '(..)', '\\1 ', 'g')) AS head FROM documents")
def previews(spark, sf_dir):
    from siftwell.operators.report import hex_preview, text_preview

    return tables.table(spark, sf_dir, "documents").select("doc_id", text_preview(F.col("text")).alias("preview"), hex_preview(F.encode("text", "UTF-8")).alias("head"))


@query("""WITH RECURSIVE pairs AS (SELECT DISTINCT o_custkey AS a, -(o_orderkey % 97) - 1 AS b FROM orders), e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS r FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.r) SELECT node, min(r) AS comp FROM reach GROUP BY node""")
def connected_components(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return components(o.select(F.col("o_custkey").alias("a"), (-(F.col("o_orderkey") % 97) - 1).alias("b")))
