"""The registered queries: each operator on the TPC-H-like tables, with the same result in DuckDB SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, naming, shapes, times
from .operators import accounting, changes, classes, dedupe, matching, placing, policies, timelines
from .plans.staging import staged
from .registry import QUERIES, SQL, query, table  # noqa: F401  the registry is read from here too

TODAY = datetime.date(2026, 10, 7)
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: ref, md5 of the text, source as the name."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.md5("text").alias("md5"), "source", "lang")


@query("""
SELECT decision, count(*) AS n FROM (
  SELECT CASE WHEN min(doc_id) OVER (PARTITION BY md5(text)) = doc_id THEN 'new' ELSE 'source_duplicate' END AS decision FROM documents
) GROUP BY decision
""")
def decision_counts(spark, sf_dir):
    known = dedupe.representatives(_files(spark, sf_dir))
    decision = F.when(F.col("ref") == F.col("representative"), "new").otherwise("source_duplicate")
    return accounting.histogram(known.select(decision.alias("decision")), "decision")


@query("SELECT doc_id AS ref, md5(text) AS md5, min(doc_id) OVER (PARTITION BY md5(text)) AS representative FROM documents")
def representatives(spark, sf_dir):
    return dedupe.representatives(_files(spark, sf_dir)).select("ref", "md5", "representative")


@query("""
WITH held AS (SELECT md5(d.text) AS md5, min(d.doc_id) AS dest FROM documents d JOIN labels l USING (doc_id) GROUP BY 1),
u AS (SELECT doc_id, md5(text) AS md5, min(doc_id) OVER (PARTITION BY md5(text)) AS rep FROM documents)
SELECT doc_id AS ref, CASE WHEN rep <> doc_id THEN 'source_duplicate' WHEN dest IS NOT NULL THEN 'exact' ELSE 'new' END AS decision,
  CASE WHEN rep = doc_id THEN CAST(dest AS VARCHAR) END AS dest_item_id
FROM u LEFT JOIN held USING (md5)
""")
def exact_match(spark, sf_dir):
    files = _files(spark, sf_dir)
    none = [F.lit(None).cast("double").alias(c) for c in ("duration_s", "width", "height")]
    sources = files.select("ref", F.col("source").alias("name"), F.lit("photo").alias("kind"), "md5", *none)
    held = files.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref")), "ref", "left_semi")
    dests = held.select(F.col("ref").alias("item_id"), F.lit("album").alias("album_id"), F.col("source").alias("name"), "md5", F.lit(False).alias("is_video"), *none)
    return dedupe.decide(sources, dests, mode="exact").select("ref", "decision", "dest_item_id")


_PAGE_NAME = "regexp_extract(url, '([^/]*)$', 1)"


@query(f"""
SELECT page_id, name, ext, substr(name, 1, length(name) - length(ext)) AS stem,
  regexp_replace(lower(substr(name, 1, length(name) - length(ext))), '\\s?\\(\\d+\\)$', '') AS match_key
FROM (SELECT page_id, name, regexp_extract(name, '(?s)^\\.*[^./].*(\\.[^./]*)$', 1) AS ext
  FROM (SELECT page_id, {_PAGE_NAME} || CASE page_id % 3 WHEN 0 THEN ' (' || page_id || ').JPG' WHEN 1 THEN '.tar.gz' ELSE '' END AS name FROM pages))
""")
def file_names(spark, sf_dir):
    tail = F.regexp_extract("url", "([^/]*)$", 1)
    suffix = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" ("), F.col("page_id").cast("string"), F.lit(").JPG"))).when(F.col("page_id") % 3 == 1, ".tar.gz").otherwise("")
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(tail, suffix).alias("name"))
    n = F.col("name")
    return named.select("page_id", "name", names.extension(n).alias("ext"), names.stem(n).alias("stem"), names.match_key(n).alias("match_key"))


@query("""
WITH p AS (SELECT a.vec_id, b.vec_id AS other, len(list_filter(list_zip(a.embedding, b.embedding), lambda x: (x[1] > 0) <> (x[2] > 0))) AS dist
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT vec_id, CAST(min(dist) AS INTEGER) AS dist, arg_min(other, dist * 10000000 + other) AS nearest, CAST(count(*) AS BIGINT) AS candidates FROM p GROUP BY vec_id
""")
def nearest_hash(spark, sf_dir):
    hashed = table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("id"), shapes.sign_bits(F.col("embedding")).alias("hash"))
    return classes.nearest_pictures(hashed).withColumnRenamed("id", "vec_id")


def _timeline(spark, sf_dir, kind, side):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("event_id").alias(f"{side}_id"), seconds.alias(f"{side}_ts"), F.lit(1.0).alias(f"{side}_ratio"), F.col("event_id").alias(f"{side}_order"), "user_id")


_MET = """
c AS (SELECT event_id AS clip_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'click'),
s AS (SELECT event_id AS still_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'view'),
met AS (SELECT clip_id, still_id, abs(c.t - s.t) AS gap FROM c JOIN s ON c.user_id = s.user_id AND abs(c.t - s.t) <= 3600)
"""


@query(f"WITH {_MET} SELECT clip_id, count(*) AS candidates, min(gap) AS nearest FROM met GROUP BY clip_id")
def range_join(spark, sf_dir):
    met = matching.within_window(_timeline(spark, sf_dir, "click", "clip"), _timeline(spark, sf_dir, "view", "still"), "clip_ts", "still_ts", 3600, ["user_id"])
    gap = F.abs(F.col("clip_ts") - F.col("still_ts"))
    return met.groupBy("clip_id").agg(F.count("*").alias("candidates"), F.min(gap).alias("nearest"))


@query(f"""
WITH RECURSIVE {_MET},
p AS (SELECT *, row_number() OVER (ORDER BY gap, clip_id, still_id) AS rn FROM met),
g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS uc, CAST([] AS BIGINT[]) AS us, false AS ok, CAST(0 AS BIGINT) AS clip_id, CAST(0 AS BIGINT) AS still_id, CAST(0 AS BIGINT) AS gap
  UNION ALL
  SELECT p.rn, CASE WHEN o THEN list_append(uc, p.clip_id) ELSE uc END, CASE WHEN o THEN list_append(us, p.still_id) ELSE us END, o, p.clip_id, p.still_id, p.gap
  FROM g JOIN (SELECT * FROM p) p ON p.rn = g.rn + 1, LATERAL (SELECT NOT list_contains(uc, p.clip_id) AND NOT list_contains(us, p.still_id) AS o))
SELECT g.clip_id, g.still_id, g.gap, m.n AS candidates FROM g JOIN (SELECT clip_id, count(*) AS n FROM met GROUP BY 1) m USING (clip_id) WHERE ok
""")
def clip_pairs(spark, sf_dir):
    return timelines.pair_clips(_timeline(spark, sf_dir, "click", "clip"), _timeline(spark, sf_dir, "view", "still"), 3600, keys=["user_id"])


@query("""
SELECT o_orderkey, base, CAST(1 + r // 50 AS INTEGER) AS part, CASE WHEN r < 50 THEN base ELSE base || ' - Part ' || CAST(1 + r // 50 AS BIGINT) END AS target
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS base, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)
""")
def album_parts(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("base"))
    return placing.parts(items, "base", [F.asc("o_orderdate"), F.asc("o_orderkey")], 50).select("o_orderkey", "base", "part", "target")


@query("""
WITH e AS (SELECT *, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS keeper FROM documents)
SELECT doc_id AS item_id, keeper AS keeper_item_id FROM e
""")
def duplicate_keepers(spark, sf_dir):
    files = _files(spark, sf_dir)
    items = files.select(F.col("ref").alias("item_id"), "md5", F.col("source").alias("uploaded"), F.lit(None).cast("string").alias("capture_local"), F.lit("none").alias("method"))
    return placing.keepers(items).select("item_id", "keeper_item_id")


@query("""
WITH i AS (SELECT o_orderkey, md5(CAST(o_custkey AS VARCHAR) || o_orderpriority) AS h, strftime(o_orderdate, '%Y-%m-%d') AS up, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS cap, o_orderpriority AS grp FROM orders),
k AS (SELECT *, first_value(o_orderkey) OVER (PARTITION BY h ORDER BY up, o_orderkey) AS keeper,
  first_value(cap) OVER (PARTITION BY h ORDER BY cap IS NULL, up, o_orderkey) AS lent FROM i),
w AS (SELECT *, CASE WHEN keeper <> o_orderkey THEN NULL ELSE coalesce(cap, lent) END AS dt FROM k),
b AS (SELECT *, CASE WHEN keeper <> o_orderkey THEN 'Duplicates' WHEN dt IS NULL THEN 'Undated' ELSE substr(dt, 1, 4) || '-' || substr(dt, 6, 2) || ' ' || grp END AS base,
  CASE WHEN keeper <> o_orderkey THEN h ELSE coalesce(dt, '') END AS srt FROM w),
r AS (SELECT *, (row_number() OVER (PARTITION BY base ORDER BY srt, o_orderkey) - 1) // 20 + 1 AS part FROM b)
SELECT o_orderkey AS item_id, CASE WHEN keeper <> o_orderkey THEN 'park_duplicate' ELSE 'move' END AS action,
  CASE WHEN part = 1 THEN base ELSE base || ' - Part ' || part END AS target_name,
  CASE WHEN keeper <> o_orderkey THEN 'duplicates' WHEN dt IS NULL THEN 'photo_undated' ELSE 'photo' END AS kind,
  CASE WHEN keeper <> o_orderkey THEN 'same file as ' || keeper ELSE 'date via ' || CASE WHEN cap IS NULL AND dt IS NOT NULL THEN 'camera (from an identical copy)' ELSE 'camera' END || ', group ' || grp END AS reason,
  CASE WHEN keeper <> o_orderkey THEN keeper END AS keeper_item_id FROM r
""")
def organize_plan(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.lit("x.jpg").alias("filename"), F.lit(False).alias("is_video"), F.md5(F.concat(F.col("o_custkey").cast("string"), "o_orderpriority")).alias("md5"),
        day.alias("uploaded"), F.when(F.col("o_orderstatus") != "F", day).alias("capture_local"), F.lit("camera").alias("method"), F.col("o_orderpriority").alias("group"),
    )
    settings = {"photo": "{yyyy}-{mm} {group}", "video": "{yyyy}", "undated_photo": "Undated", "undated_video": "Undated", "duplicates_album": "Duplicates", "duplicates": "park", "soft_cap": 20, "mode": "move"}
    return placing.plan_organize(items, settings)


def _log(spark, sf_dir):
    """Events as a change log: an event's value, cut to one figure, follows the one before it."""
    digit = F.floor(F.pmod(F.col("event_id"), F.lit(7)) / 3).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("album_id"), F.lit("setting").alias("kind"), F.col("event_type").alias("field"), F.col("event_id").alias("change_id"), digit.alias("old_value"), F.floor(F.pmod(F.col("event_id") * 3, F.lit(7)) / 3).cast("long").alias("new_value"))


_LOG = "SELECT user_id AS album_id, event_type AS field, event_id AS change_id, CAST((event_id % 7) // 3 AS BIGINT) AS old_value, CAST((event_id * 3 % 7) // 3 AS BIGINT) AS new_value FROM events"


@query(f"SELECT album_id, field, max(change_id) AS change_id FROM ({_LOG}) GROUP BY 1, 2")
def newest_changes(spark, sf_dir):
    return changes.newest(_log(spark, sf_dir)).select("album_id", "field", "change_id")


@query(f"""
WITH l AS (SELECT *, lag(old_value) OVER w AS later, row_number() OVER w AS rn FROM ({_LOG}) WINDOW w AS (PARTITION BY album_id, field ORDER BY change_id DESC)),
m AS (SELECT *, sum(CASE WHEN rn > 1 AND new_value IS DISTINCT FROM later THEN 1 ELSE 0 END) OVER (PARTITION BY album_id, field ORDER BY change_id DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM l)
SELECT album_id, field, count(*) AS links, min(change_id) AS oldest, arg_min(old_value, change_id) AS before FROM m WHERE breaks = 0 GROUP BY 1, 2
""")
def undo_runs(spark, sf_dir):
    runs = changes.linked_runs(_log(spark, sf_dir), ["album_id", "field"]).where("linked")
    return runs.groupBy("album_id", "field").agg(F.count("*").alias("links"), F.min("change_id").alias("oldest"), F.first("before").alias("before"))


@query("""
WITH f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w THEN 1 ELSE 0 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT l_orderkey, l_linenumber, l_returnflag, CAST(island AS BIGINT) AS island, CAST((row_number() OVER (PARTITION BY l_orderkey, island ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1) // 2 AS BIGINT) AS batch FROM i
""")
def move_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    return changes.batches(rows, ["l_orderkey"], [F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")], ["l_returnflag"], 2).select("l_orderkey", "l_linenumber", "l_returnflag", "island", "batch")


POLICIES = [
    {"scope": ["*"], "downloads": True, "privacy": "public"},
    {"scope": ["BUILDING/*"], "privacy": "unlisted", "download_size": "5k"},
    {"scope": ["*1", "machinery/*"], "exclude": ["*11"], "downloads": False},
]
_ALBUMS = "SELECT c_custkey AS album_id, c_mktsegment AS folder, c_name AS name, c_acctbal FROM customer"
_WANT = f"""
a AS ({_ALBUMS}),
m AS (SELECT *, lower(folder || '/' || name) AS p, lower(name) AS q FROM a),
want AS (
  SELECT album_id, 'downloads' AS setting, CASE WHEN (suffix(p, '1') OR prefix(p, 'machinery/')) AND NOT suffix(p, '11') THEN 'false' ELSE 'true' END AS desired, CASE WHEN (suffix(p, '1') OR prefix(p, 'machinery/')) AND NOT suffix(p, '11') THEN 3 ELSE 1 END AS policy FROM m
  UNION ALL SELECT album_id, 'privacy', CASE WHEN prefix(p, 'building/') THEN '"unlisted"' ELSE '"public"' END, CASE WHEN prefix(p, 'building/') THEN 2 ELSE 1 END FROM m
  UNION ALL SELECT album_id, 'download_size', '"5k"', 2 FROM m WHERE prefix(p, 'building/'))
"""


def _albums(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_mktsegment").alias("folder"), F.col("c_name").alias("name"), "c_acctbal")


@query(f"WITH {_WANT} SELECT album_id, setting, desired, CAST(policy AS INTEGER) AS policy FROM want")
def wanted_settings(spark, sf_dir):
    return policies.desired(_albums(spark, sf_dir), POLICIES)


@query(f"""
WITH {_WANT},
act AS (SELECT album_id, 'downloads' AS setting, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS actual FROM a UNION ALL SELECT album_id, 'privacy', CASE WHEN c_acctbal > 5000 THEN '"private"' ELSE '"public"' END FROM a),
dl AS (SELECT album_id, desired = 'true' AS on_ FROM want WHERE setting = 'downloads')
SELECT w.album_id, w.setting, act.actual, w.desired, CAST(w.policy AS INTEGER) AS policy FROM want w LEFT JOIN act USING (album_id, setting) JOIN dl USING (album_id)
WHERE NOT (w.setting = 'download_size' AND NOT on_) AND w.desired IS DISTINCT FROM act.actual
""")
def settings_drift(spark, sf_dir):
    albums = _albums(spark, sf_dir)
    have = F.array(F.struct(F.lit("downloads").alias("setting"), F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("value")), F.struct(F.lit("privacy").alias("setting"), F.when(F.col("c_acctbal") > 5000, '"private"').otherwise('"public"').alias("value")))
    actual = albums.select("album_id", F.inline(have))
    return policies.drift(actual, policies.desired(albums, POLICIES)).where("warning is null").select("album_id", "setting", "actual", "desired", "policy")


@query("""
SELECT c_custkey AS album_id, CASE WHEN n = 0 THEN 'empty' WHEN n > 20 THEN 'over the item cap (' || n || ' > 20)' WHEN n >= 12 THEN 'near the item cap (' || n || ' of 20)' END AS finding
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
""")
def album_findings(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    known = table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return known.select(F.col("c_custkey").alias("album_id"), policies.finding(F.col("n"), 12, 20).alias("finding"))


@query("""
SELECT coalesce(o_orderpriority, 'all files') AS type, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY ROLLUP (o_orderpriority)
""")
def accounting_table(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("outcome"))
    return accounting.accounting(rows, outcomes=["F", "O", "P"])


def _sources(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "photo").when(F.col("lang") == "de", "video").otherwise("clip")
    ref = lambda c: F.concat(F.lit("a.zip::x/"), c.cast("string"), F.lit(".JPG"))
    docs = table(spark, sf_dir, "documents")
    sources = docs.select(ref(F.col("doc_id")).alias("ref"), kind.alias("kind"), F.when(kind == "clip", ref(F.col("doc_id") - 1)).alias("still_ref"), F.when(F.col("source") == "src3", "live_clips").when(F.col("source") == "src4", "rejected_types").alias("policy_skip"))
    labels = table(spark, sf_dir, "labels")
    uploads = labels.where("quality = 1").select(ref(F.col("doc_id")).alias("source_ref"), F.lit("still").alias("role"), F.when(F.col("toxic") == 1, "failed").when(F.col("doc_id") % 5 == 0, "planned").otherwise("done").alias("status"), F.when(F.col("doc_id") % 2 == 0, "Undated").otherwise("2024-01").alias("target_name"))
    known = dedupe.representatives(docs.select(F.col("doc_id").alias("ref"), F.md5("text").alias("md5")))
    matches = known.select(ref(F.col("ref")).alias("ref"), F.when(F.col("ref") != F.col("representative"), "source_duplicate").when(F.col("ref") % 3 == 0, "exact").when(F.col("ref") % 7 == 0, "review").otherwise("new").alias("decision"))
    return sources, uploads, matches


@query("""
WITH d AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'photo' WHEN 'de' THEN 'video' ELSE 'clip' END AS kind, CASE WHEN min(doc_id) OVER (PARTITION BY md5(text)) <> doc_id THEN 'source_duplicate' WHEN doc_id % 3 = 0 THEN 'exact' WHEN doc_id % 7 = 0 THEN 'review' ELSE 'new' END AS decision FROM documents),
j AS (SELECT d.doc_id, d.kind, d.source, CASE WHEN d.kind = 'clip' THEN s.decision ELSE d.decision END AS decision, l.quality = 1 AS up, l.toxic FROM d LEFT JOIN d s ON s.doc_id = d.doc_id - 1 LEFT JOIN labels l ON l.doc_id = d.doc_id),
o AS (SELECT '.jpg' || CASE kind WHEN 'clip' THEN ' Live Photo clip' WHEN 'video' THEN ' video' ELSE '' END AS type, CASE
  WHEN up THEN CASE WHEN toxic = 1 THEN 'upload failed' WHEN doc_id % 5 = 0 THEN 'not uploaded yet' WHEN doc_id % 2 = 0 THEN 'uploaded into an undated album' ELSE 'uploaded into a dated album' END
  WHEN kind = 'clip' THEN CASE WHEN source = 'src3' THEN 'skipped by a policy' WHEN decision = 'exact' THEN 'clip already beside its still' WHEN decision = 'review' THEN 'held for review' WHEN source = 'src4' THEN 'skipped by a policy' ELSE 'not planned' END
  WHEN decision = 'exact' THEN 'already there (same file)' WHEN decision = 'source_duplicate' THEN 'duplicate within the source' WHEN decision = 'review' THEN 'held for review' WHEN source IN ('src3', 'src4') THEN 'skipped by a policy' ELSE 'not planned' END AS outcome FROM j)
SELECT type, outcome, count(*) AS n FROM o GROUP BY 1, 2
""")
def file_outcomes(spark, sf_dir):
    return accounting.histogram(accounting.classify(*_sources(spark, sf_dir), ["Undated"]), "type", "outcome")


@query("""
WITH d AS (SELECT o_custkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders),
g AS (SELECT o_custkey, count(*) AS n, min(d) AS lo, max(d) AS hi, median(d) AS mid FROM d GROUP BY 1)
SELECT o_custkey, n, CAST(hi - lo AS INTEGER) AS spread, strftime(CASE WHEN n >= 3 AND hi - lo <= 1500 THEN DATE '1970-01-01' + CAST(lo + round_even(mid - lo, 0) AS INTEGER) END, '%Y-%m-%d') AS median_date FROM g
""")
def median_dates(spark, sf_dir):
    found = accounting.median_date(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate").cast("date"), 3, 1500)
    return found.select("o_custkey", "n", F.col("spread").cast("int").alias("spread"), F.col("median_date").cast("string").alias("median_date"))


@query("""
SELECT c_custkey AS name, c_mktsegment AS kind, count(o_orderkey) AS n, CAST(sum(CASE WHEN o_orderkey IS NOT NULL THEN CAST(o_orderstatus = 'F' AS INTEGER) END) AS BIGINT) AS done, CAST(sum(CASE WHEN o_orderkey IS NOT NULL THEN CAST(o_orderpriority = '1-URGENT' AS INTEGER) END) AS BIGINT) AS collected
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2
""")
def target_progress(spark, sf_dir):
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("kind"))
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target_name"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "collect").otherwise("move").alias("action"))
    return accounting.target_progress(targets, plan)


@query("""
SELECT n_name AS target, doc AS item_id, problem FROM (
  SELECT n.n_name, s.s_suppkey AS doc, 'missing' AS problem FROM supplier s JOIN nation n ON s_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey)
  UNION ALL
  SELECT n.n_name, c.c_custkey, 'extra' FROM customer c JOIN nation n ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM supplier s WHERE c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey))
""")
def membership_check(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    at = lambda name, key, item: table(spark, sf_dir, name).join(F.broadcast(nation), F.col(key) == F.col("n_nationkey")).withColumn("target", F.col("n_name")).withColumn("item_id", F.col(item))
    seen = at("customer", "c_nationkey", "c_custkey")
    return changes.verify_membership(at("supplier", "s_nationkey", "s_suppkey"), seen, seen.where("c_acctbal <= 0")).select("target", "item_id", "problem")


@query("""
SELECT o_orderkey AS item_id, CASE WHEN st IN ('done', 'unknown') OR fresh IS NULL THEN old ELSE fresh END AS target_name, CASE WHEN st IN ('done', 'unknown') OR fresh IS NULL OR (old = fresh AND st = 'pending') THEN st ELSE 'pending' END AS status,
  NOT (st IN ('done', 'unknown') OR fresh IS NULL) AND NOT (old = fresh AND st = 'pending') AS changed
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'unknown' END AS st, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE 'old' END AS old, CASE WHEN o_totalprice > 20000 THEN strftime(o_orderdate, '%Y-%m') END AS fresh FROM orders)
""")
def plan_merge(spark, sf_dir):
    month = F.date_format("o_orderdate", "yyyy-MM")
    orders = table(spark, sf_dir, "orders")
    blank = [F.lit("move").alias("action"), F.lit("r").alias("reason"), F.lit(None).cast("string").alias("keeper_item_id")]
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("unknown")
    stored = orders.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 2 == 0, month).otherwise("old").alias("target_name"), state.alias("status"), *blank)
    fresh = orders.where("o_totalprice > 20000").select(F.col("o_orderkey").alias("item_id"), month.alias("target_name"), *blank)
    return changes.merge_plan(stored, fresh).select("item_id", "target_name", "status", "changed")


@query("""
WITH seen AS (SELECT l_orderkey, l_returnflag FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS item_id, CASE WHEN EXISTS (SELECT 1 FROM seen WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') THEN 'done' WHEN EXISTS (SELECT 1 FROM seen WHERE l_orderkey = o_orderkey) THEN 'pending' ELSE 'failed' END AS status
FROM orders WHERE o_orderstatus = 'P'
""")
def reconciled(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit("N").alias("target_name"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("done").alias("status"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("album"))
    return changes.reconcile(plan, seen).select("item_id", "status")


@query("""
SELECT CASE WHEN gap = 0 THEN '0 s' WHEN gap = 1 THEN '1 s' WHEN gap <= 5 THEN '2-5 s' WHEN gap <= 30 THEN '6-30 s' ELSE '31-60 s' END AS bucket, count(*) AS n FROM (SELECT event_id % 61 AS gap FROM events WHERE event_type <> 'error') GROUP BY 1
""")
def clip_gap_histogram(spark, sf_dir):
    gap = F.concat(F.lit("Live Photo clip, "), (F.col("event_id") % 61).cast("string"), F.lit("s from its still"))
    return accounting.clip_gaps(table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", gap).otherwise("new photo").alias("reason")))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'")
def recent_items(spark, sf_dir):
    uploaded = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    now = datetime.datetime(2024, 1, 30, 12, tzinfo=datetime.timezone.utc)
    return table(spark, sf_dir, "events").where(times.recent(uploaded, 10, now)).select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) GLOB 'h?t *' OR lower(p_name) GLOB '*[rb]in[!a-f]'")
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(names.glob_any([F.col("p_name")], ["H?t *", "*[rb]in[!a-f]"])).select("p_partkey", "p_name")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(d, '%Y-%m-%d') || 'T12:34:56' WHEN 1 THEN strftime(d, '%Y-%m-%d') || 'T15:05:09' ELSE strftime(d, '%Y-%m-%d') END AS value,
  CASE o_orderkey % 4 WHEN 0 THEN 'camera_datetime' WHEN 1 THEN 'screenshot' WHEN 2 THEN 'whatsapp' ELSE 'iso_date' END AS pattern
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)
""")
def dates_in_file_names(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    d = lambda form: F.date_format("o_orderdate", form)
    name = (
        F.when(k == 0, F.concat(F.lit("IMG_"), d("yyyyMMdd"), F.lit("_123456.jpg")))
        .when(k == 1, F.concat(F.lit("Screen Shot "), d("yyyy-MM-dd"), F.lit(" at 3.05.09 PM.png")))
        .when(k == 2, F.concat(F.lit("IMG-"), d("yyyyMMdd"), F.lit("-WA0007.jpg")))
        .otherwise(F.concat(F.lit("scan "), d("yyyy-MM-dd"), F.lit(".pdf")))
    )
    named = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    return named.select("o_orderkey", times.from_filename(F.col("name"), TODAY).alias("f")).select("o_orderkey", "f.value", "f.pattern")


@query("""
WITH f AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 11 AS k FROM orders),
n AS (SELECT *, CASE k WHEN 2 THEN 'Snow' WHEN 9 THEN '1992-1995 album' WHEN 10 THEN 'Stay 13/45' ELSE 'Trip' END AS subject FROM f)
SELECT o_orderkey, CASE WHEN k <> 8 THEN CASE k WHEN 9 THEN 1992 WHEN 10 THEN 2001 ELSE CAST(year(d) AS INTEGER) END END AS year,
  CASE WHEN k IN (0, 1, 2, 3, 6, 7) THEN CAST(month(d) AS INTEGER) END AS month, CASE WHEN k IN (0, 2, 3, 7) THEN CAST(day(d) AS INTEGER) END AS day,
  CASE WHEN k IN (0, 2, 3, 7) THEN 'day' WHEN k IN (1, 6) THEN 'month' WHEN k IN (4, 5, 10) THEN 'year' WHEN k = 9 THEN 'range' ELSE 'none' END AS precision, CASE k WHEN 8 THEN 'Trip without a date' ELSE subject END AS subject,
  CASE WHEN k IN (8, 9) THEN 'none' WHEN k IN (4, 5, 10) OR (k = 7 AND day(d) <= 12 AND day(d) <> month(d)) THEN 'medium' ELSE 'high' END AS confidence FROM n
""")
def dates_in_album_names(spark, sf_dir):
    """Eleven shapes of names: days, months, years of four and two figures, open ones, a range, no date, and one that can't be."""
    k, d = F.col("o_orderkey") % 11, lambda form: F.date_format("o_orderdate", form)
    shapes_ = [
        F.concat(d("yyyy-MM-dd"), F.lit(" - Trip")),
        F.concat(F.lit("Trip "), d("MMMM, yyyy")),
        F.concat(F.lit("Snow taken on "), d("d MMM yyyy")),
        F.concat(d("yyyyMMdd"), F.lit(" Trip")),
        F.concat(F.lit("Trip ("), d("yyyy"), F.lit(")")),
        F.concat(F.lit("Trip '"), d("yy")),
        F.concat(d("yyyy/MM"), F.lit(": Trip")),
        F.concat(d("MM-dd-yyyy"), F.lit(" Trip in")),
        F.lit("Trip without a date"),
        F.lit("1992-1995 album"),
        F.lit("Stay 13/45/2001"),
    ]
    name = F.lit(None).cast("string")
    for i, made in enumerate(shapes_):
        name = F.when(k == i, made).otherwise(name)
    named = staged(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")))  # else the optimizer puts these branches into every use of the name
    parsed = named.select("o_orderkey", naming.parse(F.col("name"), TODAY).alias("p"))
    return parsed.select("o_orderkey", "p.year", "p.month", "p.day", "p.precision", "p.subject", "p.confidence")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def largest_first(spark, sf_dir):
    return changes.limited(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query("SELECT c_custkey AS album_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unused_targets(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("target_name"))
    return changes.unused_targets(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_custkey").alias("album_id")), plan).select("album_id")


@query("""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding[1:64], lambda x: x > 0) AS b FROM embeddings),
l AS (SELECT *, min(vec_id) OVER (PARTITION BY b) AS rep FROM v WHERE vec_id % 2 = 0),
r AS (SELECT * FROM v WHERE vec_id % 2 = 1),
x AS (SELECT b, min(vec_id) AS item FROM r GROUP BY b),
rest AS (SELECT l.* FROM l WHERE rep = vec_id AND NOT EXISTS (SELECT 1 FROM x WHERE x.b = l.b)),
p AS (SELECT rest.vec_id AS ref, r.vec_id AS item, len(list_filter(list_zip(rest.b, r.b), lambda z: z[1] <> z[2])) AS dist FROM rest JOIN r USING (label)),
c AS (SELECT *, row_number() OVER (ORDER BY dist, ref, item) AS rn FROM p WHERE dist <= 24),
g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS ud, false AS ok, CAST(0 AS BIGINT) AS ref, CAST(0 AS BIGINT) AS item, CAST(0 AS BIGINT) AS dist
  UNION ALL
  SELECT c.rn, CASE WHEN o THEN list_append(us, c.ref) ELSE us END, CASE WHEN o THEN list_append(ud, c.item) ELSE ud END, o, c.ref, c.item, c.dist
  FROM g JOIN c ON c.rn = g.rn + 1, LATERAL (SELECT NOT list_contains(us, c.ref) AND NOT list_contains(ud, c.item) AS o)),
t AS (SELECT ref, item, dist FROM g WHERE ok),
f AS (SELECT ref, min(dist * 1000000 + item) AS near FROM p WHERE item NOT IN (SELECT item FROM t) GROUP BY 1),
o AS (SELECT rest.vec_id AS ref, f.near // 1000000 AS dist, f.near % 1000000 AS item, coalesce(n, 0) AS n FROM rest LEFT JOIN f ON f.ref = rest.vec_id LEFT JOIN (SELECT ref, count(*) AS n FROM p GROUP BY 1) s ON s.ref = rest.vec_id WHERE rest.vec_id NOT IN (SELECT ref FROM t))
SELECT CAST(ref AS VARCHAR) AS ref, decision, method, CAST(item AS VARCHAR) AS dest_item_id, CASE WHEN item IS NOT NULL THEN 'a' END AS dest_album_id, CAST(dist AS INTEGER) AS dist FROM (
  SELECT vec_id AS ref, 'source_duplicate' AS decision, 'md5' AS method, NULL AS item, NULL AS dist FROM l WHERE rep <> vec_id
  UNION ALL SELECT l.vec_id, 'exact', 'md5', x.item, 0 FROM l JOIN x USING (b) WHERE rep = vec_id
  UNION ALL SELECT ref, 'same', 'content', item, dist FROM t
  UNION ALL SELECT ref, CASE WHEN dist IS NULL OR dist >= 30 THEN 'new' ELSE 'review' END, CASE WHEN n = 0 THEN 'none' ELSE 'content' END, CASE WHEN dist < 30 THEN item END, dist FROM o)
""")
def content_decisions(spark, sf_dir):
    """Vectors as photos: the sign bits are the hash, the label the name; labels of odd vectors are the destination's."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", shapes.sign_bits(F.col("embedding")).alias("hash"))
    none = [F.lit(None).cast("double").alias(c) for c in ("duration_s", "width", "height")]
    name = F.concat(F.lit("IMG_"), F.col("label").cast("string"), F.lit(".jpg"))
    md5 = F.md5(F.col("hash").cast("string"))
    left, right = vectors.where("vec_id % 2 = 0"), vectors.where("vec_id % 2 = 1")
    sources = left.select(F.col("vec_id").alias("ref"), name.alias("name"), F.lit("photo").alias("kind"), md5.alias("md5"), *none)
    dests = right.select(F.col("vec_id").alias("item_id"), F.lit("a").alias("album_id"), name.alias("name"), md5.alias("md5"), F.lit(False).alias("is_video"), *none)
    found = dedupe.decide(sources, dests, left.select(F.col("vec_id").alias("ref"), F.array("hash").alias("hashes")), right.select(F.col("vec_id").alias("item_id"), "hash"), same_max=24, different_min=30)
    return found.select(F.col("ref").cast("string").alias("ref"), "decision", "method", "dest_item_id", "dest_album_id", "dist")


@query("SELECT c_custkey AS album_id FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 50")
def seeded_album_sample(spark, sf_dir):
    """An exact number of albums for a seed: a sampling operator, so its limit is its purpose."""
    return accounting.seeded_sample(_albums(spark, sf_dir), "album_id", 50, seed=7).select("album_id")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 2 AS page FROM orders),
s AS (SELECT o_custkey, page, ntile(3) OVER (PARTITION BY o_custkey ORDER BY page) AS slice FROM (SELECT DISTINCT o_custkey, page FROM p)),
c AS (SELECT o_custkey, page FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey, slice ORDER BY md5('7:' || o_custkey || ':' || page), page) = 1)
SELECT o_custkey, o_orderkey FROM p JOIN c USING (o_custkey, page)
""")
def stratified_pages(spark, sf_dir):
    """Pages of a customer's orders, one from each of three slices."""
    return accounting.page_sample(table(spark, sf_dir, "orders"), "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 3, size=2, seed=7).select("o_custkey", "o_orderkey")


from . import item_queries  # noqa: E402, F401  registers the rest
