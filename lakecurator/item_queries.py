"""More registered queries: decisions, names and dates, albums and targets, plans and reports, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from .functions import names, naming, plugins, shapes, times
from .operators import accounting, changes, dedupe, inventory, placing, policies, sidecars, steps, workflows
from .plans import runs
from .plans.importing import ImportSettings, plan_import
from .registry import query, table

TODAY = datetime.date(2026, 10, 7)


def _text(value):
    return F.lit(value).cast("string")


def _no(*columns, kind="string"):
    return [F.lit(None).cast(kind).alias(c) for c in columns]


# Decisions about source files


@query("""
SELECT doc_id AS ref, CASE WHEN rep <> doc_id THEN 'source_duplicate' ELSE 'new' END AS decision, CASE WHEN rep <> doc_id THEN 'md5' ELSE 'off' END AS method
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS rep FROM documents)
""")
def decisions_without_comparing(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.lit("photo").alias("kind"), F.md5("text").alias("md5"))
    return dedupe.decide(sources, sources.limit(0), mode="off").select("ref", "decision", "method")


@query("SELECT doc_id AS ref, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'same' ELSE 'new' END ELSE 'review' END AS decision FROM labels")
def decisions_after_answers(spark, sf_dir):
    reviewed = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, "same").otherwise("different"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"), dedupe.effective_decision(F.lit("review"), reviewed).alias("decision"))


@query("""
SELECT d.doc_id AS ref, CASE WHEN l.doc_id IS NULL THEN 'review' WHEN quality = 1 THEN 'same' ELSE 'new' END AS decision, CASE WHEN n_chars > 1000 THEN 'same' END AS reviewed
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def merged_decisions(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.lit("review").alias("decision"), F.when(F.col("n_chars") > 1000, "same").alias("reviewed"))
    fresh = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"), F.when(F.col("quality") == 1, "same").otherwise("new").alias("decision"))
    return dedupe.merge_decisions(stored, fresh).select("ref", "decision", "reviewed")


@query("""
WITH s AS (SELECT page_id, md5(html) AS h, min(page_id) OVER (PARTITION BY md5(html)) AS rep FROM pages)
SELECT page_id AS ref, item_id FROM s JOIN benchmark b ON page_id % 30 = item_id % 30 WHERE rep = page_id AND NOT EXISTS (SELECT 1 FROM benchmark x WHERE md5(x.text) = h)
""")
def pictures_to_compare(spark, sf_dir):
    called = lambda c, form: F.format_string(form, F.col(c) % 30)
    sources = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ref"), called("page_id", "IMG_%d.jpg").alias("name"), F.lit("photo").alias("kind"), F.md5("html").alias("md5"))
    dests = table(spark, sf_dir, "benchmark").select("item_id", called("item_id", "img_%d (1).PNG").alias("name"), F.md5("text").alias("md5"), F.lit(False).alias("is_video"))
    return dedupe.content_candidates(sources, dests)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def hashes_to_make(spark, sf_dir):
    return dedupe.missing_hashes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id AS ref FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sources_without_decision(spark, sf_dir):
    return inventory.undecided(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref")))


def _bits(places) -> str:
    """SQL for the bits of a hash, of 72 gray values whose place in w (8 rows of 9) or t (9 rows of 8) is given for row and column."""
    value = lambda r, c: "{}[{}]".format(*places(r, c))
    return " || ".join(f"CASE WHEN {value(r, c)} > {value(r, c + 1)} THEN '1' ELSE '0' END" for r in range(8) for c in range(8))


_TURNS = {
    "h0": _bits(lambda r, c: ("w", 9 * r + c + 1)),
    "h1": _bits(lambda r, c: ("t", 8 * c + 7 - r + 1)),
    "h2": _bits(lambda r, c: ("w", 9 * (7 - r) + 8 - c + 1)),
    "h3": _bits(lambda r, c: ("t", 8 * (8 - c) + r + 1)),
}
_GRAY = """g AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
p AS (SELECT vec_id, label, e || e[1:8] AS w, e[33:64] || e[1:40] AS t FROM g)"""


def _pictures(spark, sf_dir):
    """Embeddings as gray values of pictures, with the hashes of four rotations."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int"))
    gray = table(spark, sf_dir, "embeddings").select("vec_id", "label", whole.alias("e"))
    gray = gray.select("vec_id", "label", F.concat("e", F.slice("e", 1, 8)).alias("w"), F.concat(F.slice("e", 33, 32), F.slice("e", 1, 40)).alias("t"))
    return gray.select("vec_id", "label", shapes.rotation_hashes(F.col("w"), F.col("t")).alias("hashes"))


@query(f"WITH {_GRAY} SELECT vec_id, {', '.join(f'{bits} AS {name}' for name, bits in _TURNS.items())} FROM p")
def hashes_of_rotations(spark, sf_dir):
    """The bits of the hashes of four rotations."""
    return _pictures(spark, sf_dir).select("vec_id", *[F.lpad(F.bin(F.get("hashes", F.lit(i))), 64, "0").alias(f"h{i}") for i in range(4)])


@query(f"""
WITH {_GRAY}, h AS (SELECT vec_id, label, {', '.join(f'{bits} AS {name}' for name, bits in _TURNS.items())} FROM p),
f AS (SELECT label, arg_min(h0, vec_id) AS o FROM h GROUP BY 1)
SELECT vec_id, CAST(least({', '.join(f'hamming(h{i}, o)' for i in range(4))}) AS INTEGER) AS dist FROM h JOIN f USING (label)
""")
def distances_over_rotations(spark, sf_dir):
    hashed = _pictures(spark, sf_dir)
    first = hashed.groupBy("label").agg(F.min_by(F.get("hashes", F.lit(0)), "vec_id").alias("other"))
    return hashed.join(first, "label").select("vec_id", shapes.rotation_distance(F.col("hashes"), F.col("other")).cast("int").alias("dist"))


@query("""
WITH v AS (SELECT o_orderkey, o_totalprice / 1000 AS sd, 1920.0 AS sw, CASE WHEN o_orderpriority <> '1-URGENT' THEN 1080.0 END AS sh, abs(c_acctbal) / 100 AS dd, CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'MACHINERY' THEN 720.0 ELSE 1280.0 END AS dw, CASE c_mktsegment WHEN 'MACHINERY' THEN 1280.0 WHEN 'FURNITURE' THEN 1024.0 ELSE 720.0 END AS dh FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT *, sd > 0 AND dd > 0 AS known, abs(sd - dd) AS gap, coalesce(sh, 0) > 0 AND dw > 0 AS sized, greatest(sw, sh) / least(sw, sh) AS a, greatest(dw, dh) / nullif(least(dw, dh), 0) AS b FROM v)
SELECT o_orderkey, known, CASE WHEN known AND gap <= greatest(0.5, 0.07 * sd) AND (NOT sized OR (abs(a - b) / a <= 0.02 AND dw * dh <= sw * sh * 1.01)) THEN gap END AS gap FROM k
""")
def video_shapes(spark, sf_dir):
    segment = F.col("c_mktsegment")
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    source = {"duration": F.col("o_totalprice") / 1000, "width": F.lit(1920.0), "height": F.when(F.col("o_orderpriority") != "1-URGENT", 1080.0)}
    dest = {"duration": F.abs("c_acctbal") / 100, "width": F.when(segment == "BUILDING", 0.0).when(segment == "MACHINERY", 720.0).otherwise(1280.0), "height": F.when(segment == "MACHINERY", 1280.0).when(segment == "FURNITURE", 1024.0).otherwise(720.0)}
    met = met.withColumn("dw", dest["width"]).withColumn("dh", dest["height"])
    return met.select("o_orderkey", shapes.video_gap(source, dest | {"width": F.nullif("dw", F.lit(0.0)), "height": F.col("dh")}).alias("v")).select("o_orderkey", "v.known", "v.gap")


@query("SELECT doc_id, substr(md5(text), 1, 16) AS hex FROM documents")
def hashes_as_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", shapes.hash_to_hex(shapes.hash_from_hex(F.substring(F.md5("text"), 1, 16))).alias("hex"))


# Reviews and looked-up facts


@query("""
WITH n AS (SELECT doc_id AS number, doc_id AS ref FROM labels), t AS (SELECT doc_id AS ref FROM documents WHERE n_chars > 500 AND doc_id NOT IN (SELECT ref FROM n))
SELECT number, ref FROM n UNION ALL SELECT (SELECT max(number) FROM n) + row_number() OVER (ORDER BY ref), ref FROM t
""")
def review_numbers(spark, sf_dir):
    matches = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.lit("review").alias("decision"), F.when(F.col("n_chars") <= 500, "same").alias("reviewed"))
    return inventory.review_pairs(matches, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), F.col("doc_id").alias("ref")))


_ANSWERS = "SELECT o_custkey AS number, count(DISTINCT o_orderstatus) AS n, min(CASE o_orderstatus WHEN 'F' THEN 'same' ELSE 'different' END) AS answer FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1"


def _answers(spark, sf_dir):
    folder = F.when(F.col("o_orderstatus") == "F", "same").when(F.col("o_orderstatus") == "O", "different").otherwise("later")
    files = table(spark, sf_dir, "orders").select(folder.alias("folder"), F.format_string("%06d destination x.jpg", "o_custkey").alias("name"))
    return inventory.read_answers(files, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), F.col("c_name").alias("ref")))


@query(f"SELECT c_name AS ref, answer FROM ({_ANSWERS}) JOIN customer ON c_custkey = number WHERE n = 1")
def review_answers(spark, sf_dir):
    return _answers(spark, sf_dir)[0]


@query(f"SELECT number FROM ({_ANSWERS}) WHERE n = 2")
def conflicting_answers(spark, sf_dir):
    return _answers(spark, sf_dir)[1]


@query("""
SELECT item_id FROM benchmark b WHERE length(text) > 100 AND EXISTS (SELECT 1 FROM pages WHERE page_id % 20 = item_id % 20 AND md5(html) NOT IN (SELECT md5(text) FROM benchmark))
""")
def videos_to_look_up(spark, sf_dir):
    sources = table(spark, sf_dir, "pages").select(F.format_string("MVI_%d.mov", F.col("page_id") % 20).alias("name"), F.lit("video").alias("kind"), F.md5("html").alias("md5"))
    dests = table(spark, sf_dir, "benchmark").select("item_id", F.format_string("mvi_%d(2).MP4", F.col("item_id") % 20).alias("name"), F.md5("text").alias("md5"), F.lit(True).alias("is_video"), F.when(F.length("text") <= 100, 1.0).alias("duration_s"))
    return inventory.videos_to_look_up(sources, dests).select("item_id")


@query("SELECT c_custkey AS item_id, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE s_acctbal END AS duration_s, coalesce(CASE WHEN c_nationkey > 5 THEN c_nationkey END, s_nationkey) AS width, s_nationkey AS height FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def looked_up_facts(spark, sf_dir):
    dests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("duration_s"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("width"), F.lit(None).cast("int").alias("height"))
    facts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_acctbal").alias("duration_s"), F.col("s_nationkey").alias("width"), F.col("s_nationkey").alias("height"))
    return inventory.with_video_facts(dests, facts)


# Names, dates and media


@query("SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m') AS month FROM events")
def local_months(spark, sf_dir):
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", times.local_month(seconds, "+05:00").alias("month"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate, '%m') || ' ' || o_orderpriority || '/' || strftime(o_orderdate, '%d') END AS path FROM orders
""")
def album_paths(spark, sf_dir):
    when = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.album_path("{yyyy} / {mm}  {group}/{dd}", when, F.col("o_orderpriority")).alias("path"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d || 'T08:09:10' WHEN 1 THEN d || 'T01:02:03' WHEN 2 THEN d || 'T10:30:00' END AS value, CASE o_orderkey % 4 WHEN 0 THEN 'filename:camera_datetime' WHEN 1 THEN 'camera' WHEN 2 THEN 'upload' ELSE 'none' END AS method
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
""")
def dates_by_chain(spark, sf_dir):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.concat(F.lit("PXL_"), F.replace(day, F.lit("-")), F.lit("_080910.jpg"))).otherwise("x.jpg").alias("filename"), F.when(k == 1, F.concat(day, F.lit(" 01:02:03"))).alias("capture_time"), F.when(k == 2, F.concat(day, F.lit("T10:30:00"))).alias("uploaded"), _text(None).alias("album_name"))
    found = rows.select("o_orderkey", naming.date_for(["filename", "camera", "album", "upload"], {c: F.col(c) for c in rows.columns}, "UTC", TODAY).alias("d"))
    return found.select("o_orderkey", "d.value", "d.method")


@query("""
SELECT album_id, CASE k WHEN 0 THEN d || ' Walk' WHEN 1 THEN substr(d, 1, 7) || ' Walk' WHEN 3 THEN d || ' Picnic' END AS new, CASE k WHEN 0 THEN d WHEN 1 THEN substr(d, 1, 7) WHEN 3 THEN d END AS date,
  CASE k WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 3 THEN 'photos' ELSE 'none' END AS source, CASE k WHEN 3 THEN 'medium' WHEN 2 THEN 'none' ELSE 'high' END AS confidence, k < 2 AS auto
FROM (SELECT o_orderkey AS album_id, o_orderkey % 4 AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
""")
def album_proposals(spark, sf_dir):
    k, day = F.col("o_orderkey") % 4, lambda form: F.date_format("o_orderdate", form)
    name = F.when(k == 0, F.concat(F.lit("Walk, "), day("d MMM yyyy"))).when(k == 1, F.concat(F.lit("Walk - "), day("MMMM yyyy"))).when(k == 2, "Picnic").otherwise("Picnic")
    photos = F.when(k == 3, F.array_repeat(day("yyyy-MM-dd'T'10:00:00"), 6))
    albums = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("album_id"), name.alias("name"), photos.alias("photo_dates"), F.lit(None).cast("array<string>").alias("upload_dates"))
    templates = {"day": "{yyyy}-{mm}-{dd} {subject}", "month": "{yyyy}-{mm} {subject}", "year": "{yyyy} {subject}"}
    return naming.propose(albums, templates, TODAY).select("album_id", "new", "date", "source", "confidence", "auto")


@query(r"""
WITH p AS (SELECT page_id, substr(md5(html), 1, 5) || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.tar.heic' WHEN 2 THEN '' ELSE '.png' END AS name, page_id % 9 AS k, page_id % 5 AS t FROM pages),
q AS (SELECT *, CASE k WHEN 1 THEN '(2)' WHEN 3 THEN '(11)' END AS counter, CASE t WHEN 0 THEN name WHEN 1 THEN 'Other Name.jpeg' WHEN 2 THEN name ELSE name END AS title FROM p)
SELECT page_id, CASE WHEN k >= 5 THEN NULL WHEN counter IS NULL THEN name ELSE regexp_replace(title, '(\.[^.]*)?$', '') || counter || regexp_extract(title, '(\.[^.]*)?$') END AS expected, CASE WHEN k < 5 THEN name END AS prefix FROM q
""")
def media_of_sidecars(spark, sf_dir):
    """Names with and without counters, cut suffixes, names that are no sidecar's, titles that differ, are null or empty."""
    k = F.col("page_id")
    pick = lambda by, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % by).cast("int"))
    name = F.concat(F.substring(F.md5("html"), 1, 5), pick(4, ".JPG", ".tar.heic", "", ".png"))
    suffix = pick(9, ".supplemental-metadata.json", ".supplemental-metadata(2).json", ".suppl.JSON", ".s(11).json", ".supplemental-met.json", ".json", ".other.json", ".supplemental-metadata-edited.json", ".supplemental-metadata.jsonx")
    title = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "Other Name.jpeg").when(k % 5 == 2, "").otherwise(name)
    found = table(spark, sf_dir, "pages").select("page_id", sidecars.media_name(F.concat(name, suffix), title).alias("m"))
    return found.select("page_id", "m.expected", "m.prefix")


@query("""
SELECT 'f' || page_id % 7 || '/p' || page_id || '.JPG' AS path, CASE WHEN page_id % 5 <> 0 THEN 1600000000 + page_id END AS taken_ts, CASE WHEN page_id % 5 <> 0 THEN 'p' || page_id || '.JPG' END AS title, page_id % 5 = 0 AS orphan, CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 0 THEN 'f' || page_id % 7 || '/p' || page_id || '.MP4' END AS motion FROM pages
UNION ALL SELECT 'f' || page_id % 7 || '/p' || page_id || '.MP4', NULL, NULL, true, NULL FROM pages WHERE page_id % 5 = 0 AND page_id % 3 = 0
""")
def media_with_sidecars(spark, sf_dir):
    n, k = F.col("page_id").cast("string"), F.col("page_id")
    member = lambda name, ext, json=_text(None): F.struct(name.alias("basename"), F.lit(ext).alias("ext"), json.alias("json"))
    still = F.concat(F.lit("p"), n, F.lit(".JPG"))
    side = F.to_json(F.struct(still.alias("title"), F.struct((F.lit(1600000000) + k).cast("string").alias("timestamp")).alias("photoTakenTime")))
    made = F.array(member(still, ".jpg"), F.when(k % 5 != 0, member(F.concat(still, F.lit(".supplemental-metadata.json")), ".json", side)), F.when(k % 3 == 0, member(F.concat(F.lit("p"), n, F.lit(".MP4")), ".mp4")))
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("f"), (k % 7).cast("string")).alias("folder"), F.explode(F.filter(made, lambda m: m.isNotNull())).alias("m"))
    members = rows.select(F.lit("a.zip").alias("archive"), F.concat_ws("/", "folder", "m.basename").alias("path"), "folder", "m.basename", "m.ext", "m.json", _text("").alias("md5"), F.lit(1).cast("long").alias("size"))
    return sidecars.items(members).select("path", "taken_ts", "title", "orphan", F.col("motion.path").alias("motion"))


@query("""
WITH RECURSIVE b AS (SELECT page_id, 'f' || page_id % 9 AS folder, 'img_' || substr(md5(html), 1, 2) || '_' || page_id || '.jpg' AS name FROM pages),
a AS (SELECT folder, list(name) AS names FROM b GROUP BY 1),
s AS (SELECT page_id, folder, CASE page_id % 4 WHEN 0 THEN name WHEN 1 THEN name[:6] WHEN 2 THEN name[:5] ELSE split_part(name, '.', 1) END AS p, row_number() OVER (PARTITION BY folder ORDER BY page_id * 37 % 1009, page_id) AS rk FROM b),
r AS (SELECT folder, CAST(0 AS BIGINT) AS rk, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS got, CAST(NULL AS BIGINT) AS page_id FROM a
  UNION ALL
  SELECT s.folder, s.rk, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END, g, s.page_id
  FROM r JOIN s ON s.folder = r.folder AND s.rk = r.rk + 1 JOIN a ON a.folder = r.folder,
  LATERAL (SELECT list_filter(names, lambda x: starts_with(x, p) AND NOT list_contains(used, x)) AS c),
  LATERAL (SELECT CASE WHEN list_contains(names, p) THEN CASE WHEN NOT list_contains(used, p) THEN p END WHEN len(c) = 1 THEN c[1] END AS g))
SELECT b.folder || '/' || name AS path, 1600000000 + r.page_id AS taken_ts, r.page_id IS NULL AS orphan FROM b LEFT JOIN r ON r.folder = b.folder AND r.got = b.name
""")
def truncated_sidecars(spark, sf_dir):
    """Sidecars whose names were cut short: what they mean hangs on the ones before."""
    k = F.col("page_id")
    base = table(spark, sf_dir, "pages").select(k, F.concat(F.lit("f"), (k % 9).cast("string")).alias("folder"), F.concat(F.lit("img_"), F.substring(F.md5("html"), 1, 2), F.lit("_"), k.cast("string"), F.lit(".jpg")).alias("name"))
    name = F.col("name")
    short = F.when(k % 4 == 0, name).when(k % 4 == 1, F.substring(name, 1, 6)).when(k % 4 == 2, F.substring(name, 1, 5)).otherwise(names.stem(name))
    side = F.to_json(F.struct(name.alias("title"), F.struct((F.lit(1600000000) + k).cast("string").alias("timestamp")).alias("photoTakenTime")))
    member = lambda archive, name, ext, json: F.struct(archive.alias("archive"), name.alias("basename"), F.lit(ext).alias("ext"), json.alias("json"))
    order = F.format_string("%04d-%09d", k * 37 % 1009, k)
    rows = base.select("folder", F.inline(F.array(member(F.lit("a"), name, ".jpg", _text(None)), member(order, F.concat(short, F.lit(".supplemental-metadata.json")), ".json", side))))
    members = rows.select("archive", F.concat_ws("/", "folder", "basename").alias("path"), "folder", "basename", "ext", "json", _text("").alias("md5"), F.lit(1).cast("long").alias("size"))
    return sidecars.items(members).select("path", "taken_ts", "orphan")


@query("""
WITH p AS (SELECT page_id, page_id % 8 AS k, substr(md5(html), 1, 6) AS base FROM pages)
SELECT page_id, base || CASE k WHEN 0 THEN '.JPG' WHEN 1 THEN '.x.JPG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.WebP' WHEN 4 THEN '.PNG' WHEN 5 THEN '' WHEN 6 THEN '.tar.webp' ELSE '.JPG' END AS name, k IN (0, 1, 7) AS convert, CASE WHEN k IN (3, 6) THEN '.webp' END AS skipped FROM p
""")
def still_outputs(spark, sf_dir):
    """Stills that are converted, refused or sent as they are, in either case, with several dots or no extension."""
    ends = F.array(*[F.lit(x) for x in (".HEIC", ".x.heif", ".jpg", ".WebP", ".PNG", "", ".tar.webp", ".HIF")])
    name = F.concat(F.substring(F.md5("html"), 1, 6), F.get(ends, (F.col("page_id") % 8).cast("int")))
    out = table(spark, sf_dir, "pages").select("page_id", names.still_output(name, "convert", "skip", [".webp"]).alias("o"))
    return out.select("page_id", "o.name", "o.convert", F.regexp_extract("o.skip", r"^(\.\w+)", 1).alias("skipped"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS seconds FROM orders")
def durations_in_texts(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("about "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" s"))).otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.duration_seconds(text).alias("seconds"))


@query("SELECT p_partkey FROM part WHERE p_name GLOB 'h?t *' OR p_brand GLOB 'Brand#[!2-5]*'")
def glob_with_case(spark, sf_dir):
    return table(spark, sf_dir, "part").where(names.glob(F.col("p_name"), "h?t *", False) | names.glob(F.col("p_brand"), "Brand#[!2-5]*", False)).select("p_partkey")


# Albums, targets and where things go


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("folder"), F.col("c_name").alias("name"))


@query("SELECT c_custkey AS album_id FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND c_nationkey = 3) OR (c_mktsegment = 'FURNITURE' AND c_nationkey = 7 AND c_name = 'none')")
def albums_below_paths(spark, sf_dir):
    return inventory.albums_in_scope(_customers(spark, sf_dir), ["BUILDING", "/MACHINERY/3", "FURNITURE/7/none"]).select("album_id")


@query("SELECT c_custkey AS album_id, count(o_orderkey) AS item_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def snapshot_albums(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("album_id"), F.col("o_orderpriority").alias("name"))
    return inventory.refresh(_customers(spark, sf_dir), items, _customers(spark, sf_dir))[0].select("album_id", "item_count")


@query("SELECT p_partkey AS album_id FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def albums_that_are_gone(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("album_id"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("album_id"), F.col("o_orderpriority").alias("name"))
    return inventory.refresh(_customers(spark, sf_dir), items, known)[2]


@query("SELECT 'orders' AS name, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lines', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def states_of_tables(spark, sf_dir):
    return inventory.status_counts({"orders": table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "lines": table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "status")})


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'B%' AND c_nationkey >= 10 THEN 'far' WHEN upper(c_name) LIKE '%1' THEN 'ones' ELSE 'rest' END AS grp FROM customer
""")
def groups_by_rules(spark, sf_dir):
    rules = [{"name": "far", "segment": "b*", "nation": "[1-9][0-9]"}, {"name": "ones", "customer": "*1"}]
    columns = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string"), "customer": F.col("c_name")}
    return table(spark, sf_dir, "customer").select("c_custkey", placing.group_of(rules, "rest", columns).alias("grp"))


@query("""
SELECT o_orderkey, CASE WHEN r < 5 THEN 1 WHEN r < 55 THEN 2 WHEN r < 95 THEN 3 ELSE 4 + (r - 95) // 50 END AS part
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)
""")
def continued_parts(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("base"))
    months = items.select("base").distinct()
    held = months.select(F.col("base").alias("target"), F.lit(45).alias("n")).unionByName(months.select(F.concat("base", F.lit(" - Part 3")).alias("target"), F.lit(10).alias("n")))
    return placing.parts(items, "base", [F.asc("o_orderdate"), F.asc("o_orderkey")], 50, held).select("o_orderkey", "part")


@query("""
SELECT o_orderkey, CASE WHEN k = 0 THEN o_orderpriority || '.JPG' ELSE o_orderpriority || ' (' || k || ').JPG' END AS final
FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_orderpriority ORDER BY o_orderkey) - 1 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS k FROM orders)
""")
def claimed_names(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("target"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("place"), F.concat("o_orderpriority", F.lit(".JPG")).alias("name"))
    taken = items.select("target").distinct().withColumn("name", F.lit("1-urgent.jpg"))
    return placing.claim_names(items, taken).select("o_orderkey", "final")


@query("""
WITH i AS (SELECT o_orderkey, o_orderstatus = 'O' AS video, CASE o_orderpriority WHEN '1-URGENT' THEN 'exact' WHEN '2-HIGH' THEN 'review' WHEN '3-MEDIUM' THEN 'source_duplicate' ELSE 'new' END AS decision, CASE WHEN o_orderstatus <> 'P' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS t, o_orderdate AS d FROM orders),
a AS (SELECT *, CASE WHEN t IS NULL THEN 'Undated' ELSE strftime(d, '%Y-%m') || CASE WHEN video THEN ' video' ELSE '' END END AS base, CASE WHEN video THEN 'v' || o_orderkey || '.mov' ELSE 'i' || o_orderkey || '.HEIC' END AS name FROM i WHERE decision NOT IN ('exact', 'source_duplicate')),
r AS (SELECT *, (row_number() OVER (PARTITION BY base ORDER BY coalesce(t, 0), name, CAST(o_orderkey AS VARCHAR)) - 1) // 40 + 1 AS part FROM a)
SELECT CAST(o_orderkey AS VARCHAR) AS source_ref, CASE WHEN video THEN 'video' ELSE 'still' END AS role, base || CASE WHEN part > 1 THEN ' - Part ' || part ELSE '' END AS target_name, CASE WHEN video THEN name ELSE replace(name, '.HEIC', '.JPG') END AS upload_name, NOT video AS convert,
  CASE WHEN video THEN 'video/quicktime' ELSE 'image/jpeg' END AS content_type, t AS taken_ts, CASE WHEN decision = 'review' THEN 'needs_review' ELSE 'planned' END AS status FROM r
""")
def import_plan(spark, sf_dir):
    video, p = F.col("o_orderstatus") == "O", F.col("o_orderpriority")
    ref = F.col("o_orderkey").cast("string")
    seconds = F.when(F.col("o_orderstatus") != "P", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate")))
    orders = table(spark, sf_dir, "orders")
    motion = F.lit(None).cast("struct<ref:string,name:string,own_time:string,width:int,height:int,duration_s:double>")
    items = orders.select(ref.alias("ref"), F.when(video, F.concat(F.lit("v"), ref, F.lit(".mov"))).otherwise(F.concat(F.lit("i"), ref, F.lit(".HEIC"))).alias("name"), F.when(video, "video").otherwise("photo").alias("kind"), seconds.alias("taken_ts"), _text(None).alias("own_time"), *_no("width", "height", kind="int"), F.lit(60.0).alias("duration_s"), F.lit(False).alias("orphan"), motion.alias("motion"))
    decision = F.when(p == "1-URGENT", "exact").when(p == "2-HIGH", "review").when(p == "3-MEDIUM", "source_duplicate").otherwise("new")
    decisions = orders.select(ref.alias("ref"), decision.alias("decision"), _text(None).alias("dest_item_id"))
    destination = spark.createDataFrame([], "item_id string, album string, album_id string, name string")
    previous = spark.createDataFrame([], "source_ref string, role string, target_name string, upload_name string")
    albums = {"photo": "{yyyy}-{mm}", "video": "{yyyy}-{mm} video", "undated_photo": "Undated", "undated_video": "Undated"}
    rows, _ = plan_import(items, decisions, destination, previous, ImportSettings(albums, soft_cap=40))
    return rows.select("source_ref", "role", "target_name", "upload_name", "convert", "content_type", "taken_ts", "status")


def _targets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("target_name"), F.when(F.col("o_orderstatus") == "O", "video").otherwise("still").alias("role"), F.when(F.col("o_orderstatus") == "P", "other").alias("album_id"), F.lit("new").alias("reason"), F.lit("planned").alias("status"))
    targets = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "1-URGENT").otherwise(F.col("r_name")).alias("name"), F.when(F.col("r_regionkey") == 0, "known").alias("album_id"))
    albums = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("album_id"), F.when(F.col("n_nationkey") < 5, "here").otherwise("there").alias("folder"), F.when(F.col("n_nationkey") % 2 == 0, "2-HIGH").otherwise(F.col("n_name")).alias("name"))
    return inventory.with_target_albums(rows, targets, albums, "here")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'held' ELSE 'planned' END AS status FROM orders")
def rows_of_targets(spark, sf_dir):
    return _targets(spark, sf_dir)[0].select("o_orderkey", "status")


@query("""
SELECT name, kind, coalesce(a, CASE WHEN name = '2-HIGH' THEN 'n4' END) AS album_id, CAST(0 AS BIGINT) AS planned FROM (
  SELECT o_orderpriority AS name, min(CASE WHEN o_orderstatus = 'O' THEN 'video' ELSE 'photo' END) AS kind, max(CASE WHEN o_orderstatus = 'P' THEN 'other' END) AS a FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
""")
def targets_to_add(spark, sf_dir):
    return _targets(spark, sf_dir)[1]


@query("""
WITH s AS (SELECT c_name AS name, c_mktsegment AS kind, CASE WHEN c_acctbal > 0 THEN c_custkey END AS album_id, 3 AS planned, c_custkey FROM customer), n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT name, CASE WHEN n IS NOT NULL THEN 'photo' ELSE kind END AS kind, album_id, coalesce(n, planned) AS planned FROM s LEFT JOIN n ON o_custkey = c_custkey WHERE n IS NOT NULL OR album_id IS NOT NULL
""")
def merged_targets(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    stored = customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("album_id"), F.lit(3).alias("planned"))
    plan = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("target_name"), F.lit("photo").alias("kind"))
    return changes.merge_targets(stored, plan, plan)


@query("""
SELECT coalesce(c_custkey, s_suppkey) AS item_id, coalesce(s_name, c_name) AS name, CASE WHEN c_custkey IS NOT NULL THEN c_nationkey ELSE s_nationkey END AS first_seen FROM customer FULL JOIN supplier ON s_suppkey = c_custkey
""")
def merged_items(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("first_seen"))
    seen = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("first_seen"))
    return changes.merge_items(stored, seen, ["first_seen"])


@query("SELECT 'kind ' || c_mktsegment AS kind, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS planned, min(c_nationkey) AS least, max(c_nationkey) AS most FROM customer GROUP BY 1")
def kinds_of_targets(spark, sf_dir):
    return accounting.kinds_of_targets(table(spark, sf_dir, "customer").select(F.concat(F.lit("kind "), "c_mktsegment").alias("kind"), F.col("c_nationkey").alias("planned")))


# Settings and findings


@query("""
WITH a AS (SELECT c_custkey AS album_id, CASE WHEN c_nationkey % 3 = 0 THEN 'private' WHEN c_nationkey % 3 = 1 THEN 'public' END AS folder, CASE WHEN c_acctbal > 0 THEN 'private' ELSE 'public' END AS effective, 'public' AS own FROM customer)
SELECT album_id, CAST(1 AS INTEGER) AS policy, 'privacy' AS about FROM a WHERE CASE WHEN folder IS NOT NULL THEN folder = 'private' ELSE effective = 'private' END
UNION ALL SELECT album_id, CAST(2 AS INTEGER), 'download_size' FROM a
""")
def settings_warnings(spark, sf_dir):
    albums = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_mktsegment").alias("folder"), F.col("c_name").alias("name"), "c_nationkey", "c_acctbal")
    k = F.col("c_nationkey") % 3
    have = {"folder_privacy": F.when(k == 0, '"private"').when(k == 1, '"public"').otherwise("null"), "effective_privacy": F.when(F.col("c_acctbal") > 0, '"private"').otherwise('"public"'), "privacy": F.lit('"public"'), "downloads": F.lit("false")}
    actual = albums.select("album_id", F.inline(F.array(*[F.struct(F.lit(s).alias("setting"), v.alias("value")) for s, v in have.items()])))
    found = policies.drift(actual, policies.desired(albums, [{"scope": ["*"], "privacy": "public"}, {"scope": ["*"], "download_size": "4k"}])).where("warning is not null")
    return found.select("album_id", "policy", F.when(F.col("warning").contains("download_size"), "download_size").otherwise("privacy").alias("about"))


@query("SELECT c_custkey AS album_id, CASE WHEN c_acctbal > 0 THEN 'planned' ELSE 'review' END AS status FROM customer")
def audit_states(spark, sf_dir):
    value = F.when(F.col("c_acctbal") > 0, '"public"').otherwise('"odd"')
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), policies.audit_status(value, F.array(F.lit('"public"'), F.lit('"private"'))).alias("status"))


@query("""
WITH p AS (SELECT c_custkey AS album_id, c_mktsegment AS folder, c_name AS name, 'Nation ' || c_nationkey AS new, c_acctbal > 0 AS auto FROM customer)
SELECT album_id, CASE WHEN row_number() OVER (PARTITION BY folder, new ORDER BY name, album_id) > 1 THEN 'review' WHEN auto THEN 'planned' ELSE 'review' END AS status FROM p
""")
def rename_states(spark, sf_dir):
    albums = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_mktsegment").alias("folder"), F.col("c_name").alias("name"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("new"), (F.col("c_acctbal") > 0).alias("auto"))
    return policies.rename_collisions(albums, albums).select("album_id", "status")


# Plans, checks and reports


_PLAN = "SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey * 10 + 1 AS keeper, l_suppkey AS target, l_returnflag AS flag, l_linestatus AS st, l_linenumber AS n FROM lineitem"


def _lines(spark, sf_dir):
    line = lambda n: F.col("l_orderkey") * 10 + n
    action = F.when(F.col("l_returnflag") == "R", "park_duplicate").when(F.col("l_returnflag") == "A", "collect").otherwise("move")
    return table(spark, sf_dir, "lineitem").select(line(F.col("l_linenumber")).alias("item_id"), line(F.lit(1)).alias("keeper_item_id"), F.col("l_suppkey").alias("target_name"), action.alias("action"), F.when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("status"))


@query(f"""
WITH p AS (SELECT DISTINCT * FROM ({_PLAN})), safe AS (SELECT p.item_id FROM p JOIN supplier ON s_suppkey = target WHERE st = 'F' AND s_acctbal > 0)
SELECT item_id, keeper AS keeper_item_id FROM ({_PLAN}) WHERE flag = 'R' AND st = 'F' AND keeper NOT IN (SELECT item_id FROM safe)
""")
def deletions_to_refuse(spark, sf_dir):
    plan = _lines(spark, sf_dir)
    targets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("album_id"))
    return changes.unsafe_deletions(plan, targets, plan.select("item_id", F.col("target_name").alias("album_id"))).select("item_id", "keeper_item_id")


@query(f"SELECT target AS target_name, item_id FROM ({_PLAN}) WHERE flag = 'A' AND st = 'F' AND item_id NOT IN (SELECT o_orderkey * 10 + 1 FROM orders)")
def collected_to_undo(spark, sf_dir):
    plan = _lines(spark, sf_dir)
    first = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).alias("item_id")).join(plan.select("item_id", "target_name"), "item_id")
    return changes.undo_collected(plan, first)


@query("SELECT d.doc_id AS upload_id, CASE WHEN quality = 1 THEN 'same' ELSE 'new' END AS decision FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars > 200 AND toxic = 0")
def holds_to_release(spark, sf_dir):
    uploads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("upload_id"), F.col("doc_id").alias("source_ref"), F.when(F.col("lang") == "en", F.col("doc_id")).alias("pair_ref"), F.when(F.col("n_chars") > 200, "needs_review").otherwise("planned").alias("status"))
    decisions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"), F.when(F.col("toxic") == 1, "review").when(F.col("quality") == 1, "same").otherwise("new").alias("decision"))
    return changes.release_answered_holds(uploads, decisions)


@query("""
SELECT CASE WHEN o_orderstatus = 'P' THEN 'other' WHEN o_orderstatus = 'F' THEN 'camera' ELSE 'filename' END AS method, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1
""")
def methods_of_dates(spark, sf_dir):
    reason = F.when(F.col("o_orderstatus") == "F", "date via camera, group a").when(F.col("o_orderstatus") == "O", "date via filename:iso_date")
    return accounting.dated_by(table(spark, sf_dir, "orders").select(reason.alias("reason"), F.when(F.col("o_orderpriority") == "1-URGENT", "park_duplicate").when(F.col("o_orderpriority") == "2-HIGH", "collect").otherwise("move").alias("action")))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') + (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') + (SELECT count(*) FROM labels WHERE toxic = 1) AS pending")
def work_to_do(spark, sf_dir):
    uploads = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "uploading").otherwise("planned").alias("status"))
    plan = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "O", "pending").otherwise("done").alias("status"))
    return accounting.pending_work(uploads, plan, table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "planned").otherwise("done").alias("status")))


@query("""
SELECT o_orderkey AS ref, 'photo' AS kind, NULL AS still_ref, CASE WHEN o_orderstatus = 'P' THEN 'rejected_types' END AS policy_skip FROM orders
UNION ALL SELECT -o_orderkey, 'clip', o_orderkey, 'unpaired_clips' FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def files_of_report(spark, sf_dir):
    ref = F.col("o_orderkey").cast("string")
    items = table(spark, sf_dir, "orders").select(ref.alias("ref"), F.when(F.col("o_orderstatus") == "P", "a.WEBP").otherwise("a.jpg").alias("name"), F.lit("photo").alias("kind"), F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("-"), ref)).alias("motion_ref"))
    found = inventory.report_sources(items, [".webp"], unpaired_clips="skip")
    return found.select(F.col("ref").cast("long").alias("ref"), "kind", F.col("still_ref").cast("long").alias("still_ref"), "policy_skip")


# Whole steps


@query("""
SELECT item_id, CASE WHEN st = 'F' THEN d || 'T01:02:03' WHEN st = 'O' THEN d END AS capture_local, CASE st WHEN 'F' THEN 'camera' WHEN 'O' THEN 'filename:iso_date' ELSE 'none' END AS method, CASE WHEN seg = 'BUILDING' THEN 'house' ELSE 'rest' END AS grp
FROM (SELECT o_orderkey AS item_id, o_orderstatus AS st, strftime(o_orderdate, '%Y-%m-%d') AS d, c_mktsegment AS seg FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
""")
def items_to_organize(spark, sf_dir):
    st, day = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("album_id"), F.when(st == "O", F.concat(F.lit("scan "), day, F.lit(".jpg"))).otherwise("x.jpg").alias("filename"), F.lit(False).alias("is_video"), _text("").alias("md5"), *_no("uploaded"), F.when(st == "F", F.concat(day, F.lit(" 01:02:03"))).alias("capture_time"), *_no("make", "model"))
    albums = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_mktsegment").alias("name"))
    found = workflows.organize_items(items, albums, ["camera", "filename"], [{"name": "house", "album": "b*g"}], "rest", "UTC", TODAY)
    return found.select("item_id", "capture_local", "method", F.col("group").alias("grp"))


@query("""
WITH s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS rep, md5(text) AS h FROM documents), x AS (SELECT DISTINCT md5(text) AS h FROM documents JOIN labels USING (doc_id))
SELECT s.doc_id AS ref, CASE WHEN rep <> s.doc_id THEN 'source_duplicate' WHEN x.h IS NOT NULL THEN 'exact' ELSE 'new' END AS decision, CASE WHEN quality = 1 THEN 'same' END AS reviewed FROM s LEFT JOIN x ON x.h = s.h LEFT JOIN labels l ON l.doc_id = s.doc_id
""")
def decisions_of_a_run(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sources = docs.select(F.col("doc_id").alias("ref"), F.col("source").alias("name"), F.lit("photo").alias("kind"), F.md5("text").alias("md5"), *_no("duration_s", "width", "height", kind="double"))
    dests = docs.join(labels, "doc_id").select(F.col("doc_id").alias("item_id"), F.lit("a").alias("album_id"), F.col("source").alias("name"), F.md5("text").alias("md5"), F.lit(False).alias("is_video"), *_no("duration_s", "width", "height", kind="double"))
    gone = spark.range(1).select((F.col("id") - 5).alias("ref"), F.lit("review").alias("decision"), F.lit("same").alias("reviewed"))
    stored = labels.select(F.col("doc_id").alias("ref"), F.lit("review").alias("decision"), F.when(F.col("quality") == 1, "same").alias("reviewed")).unionByName(gone)
    return workflows.dedupe_run(sources, dests, stored, None, None, mode="exact").select("ref", "decision", "reviewed")


@query("SELECT c_mktsegment AS album, list_sort(list(DISTINCT lower(o_orderpriority))) [1] AS first, len(list(DISTINCT lower(o_orderpriority))) AS distinct_names, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def names_in_albums(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("album_id"), F.col("o_orderpriority").alias("name"))
    albums = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.col("c_mktsegment").alias("name"))
    found = workflows.names_by_album(workflows.destination_snapshot(items, albums))
    return found.select("album", F.col("names")[0].alias("first"), F.size("names").cast("long").alias("distinct_names"), "n")


@query("SELECT l_orderkey AS item_id, l_suppkey AS target_name, o_custkey AS src_album_id, CASE WHEN s_acctbal > 0 THEN s_suppkey END AS dst_album_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def rows_to_work_on(spark, sf_dir):
    plan = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("target_name"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("album_id"), F.lit("x").alias("filename"))
    targets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("album_id"))
    return workflows.work_rows(plan, items, targets).select("item_id", "target_name", "src_album_id", "dst_album_id")


@query("SELECT c_custkey AS name, count(o_orderkey) FILTER (o_orderstatus = 'F') AS done, count(o_orderkey) FILTER (o_orderstatus <> 'F') AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counts_of_targets(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target_name"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"))
    return workflows.target_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")), plan)


@query("SELECT c_custkey AS album_id FROM customer WHERE c_nationkey <> 0 OR c_acctbal < 0")
def albums_to_list(spark, sf_dir):
    albums = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("album_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("item_count"))
    return workflows.albums_to_list(albums).select("album_id")


@query("""
WITH c AS (SELECT o_custkey AS t, count(*) AS coming FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT t AS target_name, coalesce(c_nationkey, 0) AS n, coming FROM c LEFT JOIN customer ON c_custkey = t WHERE coalesce(c_nationkey, 0) + coming > 18
""")
def targets_over_cap(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target_name"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"))
    counts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_name"), F.col("c_nationkey").cast("long").alias("n"))
    return workflows.over_cap(plan, counts, 18)


@query("""
WITH s AS (SELECT user_id, row_number() OVER w AS step, event_type IN ('error', 'click') AS failed, count(*) FILTER (event_type NOT IN ('error', 'click')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(step) AS first, count(*) AS n FROM s WHERE failed GROUP BY user_id, run HAVING count(*) >= 3
""")
def failures_in_a_row(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").isin("error", "click").alias("failed"))
    return workflows.failure_runs(log, [F.asc("ts"), F.asc("event_id")], ["user_id"], 3).select("user_id", F.col("first").cast("long").alias("first"), "n")


@query("SELECT p_partkey AS album_id FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def empty_sources(spark, sf_dir):
    targets = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).alias("album_id"))
    return workflows.empty_sources(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("album_id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("album_id")), targets)


def _uploads(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 5).alias("album_id"), F.col("o_orderpriority").alias("md5"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("unknown").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "2024").alias("verified_at"), F.concat(F.lit("a"), F.col("o_custkey").cast("string"), F.lit(".HEIC")).alias("upload_name"))


@query("""
SELECT o_orderkey AS upload_id, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_nationkey % 5 <> o_orderkey % 5 THEN 'elsewhere' WHEN s_acctbal > 0 AND o_orderpriority <> '2-HIGH' THEN 'changed' END AS problem
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'
""")
def verified_uploads(spark, sf_dir):
    listed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), (F.col("s_nationkey") % 5).cast("long").alias("album_id"), F.when(F.col("s_acctbal") > 0, "2-HIGH").alias("md5"))
    return workflows.verify_uploads(workflows.uploads_to_verify(_uploads(spark, sf_dir)), listed)


@query("""
SELECT o_orderkey AS upload_id, CASE WHEN s_suppkey IS NULL THEN 'planned' ELSE 'done' END AS status, s_suppkey AS item_id
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey AND s_nationkey % 5 = o_orderkey % 5 WHERE o_orderstatus <> 'F'
""")
def reconciled_uploads(spark, sf_dir):
    listed = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("album_id"), F.col("s_suppkey").alias("item_id"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string"), F.lit(".jpg")).alias("name"))
    return workflows.reconcile_uploads(_uploads(spark, sf_dir), listed, {".heic": ".jpg"})


@query("""
WITH p AS (SELECT o_orderkey AS album_id, o_orderpriority AS folder, 'Walk ' || strftime(o_orderdate, '%Y.%m.%d') AS name, strftime(o_orderdate, '%Y-%m-%d') || ' Walk' AS new FROM orders WHERE o_orderstatus <> 'F')
SELECT album_id, new, CASE WHEN row_number() OVER (PARTITION BY folder, new ORDER BY name, album_id) > 1 THEN 'review' ELSE 'planned' END AS status FROM p
""")
def renames_to_plan(spark, sf_dir):
    day = lambda form: F.date_format("o_orderdate", form)
    none = F.lit(None).cast("array<string>")
    orders = table(spark, sf_dir, "orders")
    albums = orders.select(F.col("o_orderkey").alias("album_id"), F.col("o_orderpriority").alias("folder"), F.concat(F.lit("Walk "), day("yyyy.MM.dd")).alias("name"), none.alias("photo_dates"), none.alias("upload_dates"))
    renamed = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("album_id"), F.concat(day("yyyy-MM-dd"), F.lit(" Walk")).alias("new"))
    templates = {"day": "{yyyy}-{mm}-{dd} {subject}", "month": "{yyyy}-{mm} {subject}", "year": "{yyyy} {subject}"}
    return workflows.plan_renames(albums, templates, TODAY, renamed).select("album_id", "new", "status")


@query("SELECT o_orderkey AS change_id, CASE WHEN c_custkey IS NULL THEN 'gone' WHEN c_mktsegment = 'BUILDING' THEN 'verified' ELSE 'changed' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE o_orderstatus = 'F'")
def verified_changes(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("album_id"), F.lit("name").alias("field"), F.lit("BUILDING").alias("new_value"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("planned").alias("status"))
    seen = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("album_id"), F.lit("name").alias("field"), F.col("c_mktsegment").alias("value"))
    return workflows.verify_renames(log, seen)


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'filename' WHEN 'O' THEN 'camera' ELSE 'none' END AS method, count(*) AS n FROM orders GROUP BY 1")
def kinds_of_dates(spark, sf_dir):
    method = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("filename:"), "o_orderpriority")).when(F.col("o_orderstatus") == "O", "camera")
    return workflows.methods(table(spark, sf_dir, "orders").select(method.alias("method")))


@query("SELECT substr(text, 1, 12) AS error, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1")
def errors_by_beginning(spark, sf_dir):
    return workflows.errors(table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", F.col("text")).alias("last_error")), 12)


@query("""
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'o_orderstatus' WHEN grouping(o_orderstatus) = 1 THEN 'o_orderpriority' ELSE 'o_orderstatus, o_orderpriority' END AS of, o_orderstatus, o_orderpriority, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))
""")
def histograms_in_one_scan(spark, sf_dir):
    sets = [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]]
    return accounting.histograms(table(spark, sf_dir, "orders"), sets)


@query("""
SELECT event_id AS run_id, event_type AS command, CASE WHEN value < 20 THEN 'failed' WHEN user_id % 7 = 0 THEN 'stopped' ELSE 'ok' END AS status, CAST(row_number() OVER (PARTITION BY event_type, CASE WHEN value < 20 THEN 'failed' WHEN user_id % 7 = 0 THEN 'stopped' ELSE 'ok' END ORDER BY event_id DESC) AS INTEGER) AS place
FROM events QUALIFY place <= 5
""")
def last_five_runs(spark, sf_dir):
    status = F.when(F.col("value") < 20, "failed").when(F.col("user_id") % 7 == 0, "stopped").otherwise("ok")
    done = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("command"), status.alias("status"))
    return runs.last_runs(done)


@query("""
WITH f AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN 'scan ' || strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_120000.jpg' ELSE 'x.jpg' END AS name FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS by_sql, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value, CASE o_orderkey % 3 WHEN 0 THEN 'scanner' WHEN 1 THEN 'filename' ELSE 'none' END AS source FROM f
""")
def dates_by_plugin(spark, sf_dir):
    """A date source in SQL, called by name and in a chain before the built-in one."""
    added = plugins.DatePlugins(spark)
    added.register("scanner", r"try_to_date(nullif(regexp_extract(filename, '^scan (\\d\\d[.]\\d\\d[.]\\d{4})', 1), ''), 'dd.MM.yyyy')")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.when(k % 3 == 0, F.concat(F.lit("scan "), F.date_format(day, "dd.MM.yyyy"))).when(k % 3 == 1, F.concat(F.lit("IMG_"), F.date_format(day, "yyyyMMdd"), F.lit("_120000.jpg"))).otherwise("x.jpg")
    files = table(spark, sf_dir, "orders").select(k, name.alias("name"))
    found = naming.date_for(["scanner", "filename"], {"filename": F.col("name")}, "UTC", TODAY, added.sources())
    out = files.select("o_orderkey", F.expr("scanner(name, null, null, null)").alias("by_sql"), found.alias("d"))
    return out.select("o_orderkey", "by_sql", F.substring("d.value", 1, 10).alias("value"), F.regexp_extract("d.method", "^([a-z]+)", 1).alias("source"))


@query("""
WITH a AS (SELECT p_partkey, p_brand, p_name, lower(p_brand || '/' || p_name) AS path FROM part),
g AS (SELECT size AS n, lower('Brand#' || size % 60 || '/*' || chr(CAST(97 + size % 26 AS INTEGER)) || '*') AS taken, lower('*' || chr(CAST(97 + size % 7 AS INTEGER)) || chr(CAST(97 + size % 11 AS INTEGER))) AS left_out FROM (SELECT unnest(range(1, 401)) AS size)),
m AS (SELECT p_partkey, n FROM a JOIN g ON (path GLOB taken) WHERE NOT ((path GLOB left_out) OR (lower(p_name) GLOB left_out))),
s AS (SELECT p_partkey, n, CASE n % 3 WHEN 0 THEN 'privacy' WHEN 1 THEN 'downloads' ELSE 'size' END AS setting FROM m)
SELECT p_partkey AS album_id, setting, CAST(max(n) * 10 AS VARCHAR) AS desired, CAST(max(n) AS INTEGER) AS policy FROM s GROUP BY 1, 2
""")
def settings_of_many_policies(spark, sf_dir):
    """Four hundred policies, by the index of their globs."""
    wanted = [{"scope": [f"Brand#{n % 60}/*{chr(97 + n % 26)}*"], "exclude": [f"*{chr(97 + n % 7)}{chr(97 + n % 11)}"], ("privacy", "downloads", "size")[n % 3]: n * 10} for n in range(1, 401)]
    albums = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("album_id"), F.col("p_brand").alias("folder"), F.col("p_name").alias("name"))
    return policies.desired(albums, wanted)


@query("""
WITH a AS (SELECT p_partkey AS id, p_brand || '/' || p_name AS path, p_name, p_size, p_retailprice FROM part WHERE lower(p_brand) IN ('brand#11', 'brand#22', 'brand#33') OR p_size = 7),
w AS (SELECT id, p_size, p_retailprice, 1 AS policy, 'downloads' AS setting, 'true' AS desired FROM a WHERE lower(path) GLOB 'brand#[123][123]/*'
  UNION ALL SELECT id, p_size, p_retailprice, 2, 'privacy', '"unlisted"' FROM a WHERE lower(path) GLOB '*/*a' OR lower(p_name) GLOB '*a'),
n AS (SELECT *, CASE setting WHEN 'downloads' THEN CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' ELSE 'null' END ELSE CASE WHEN p_retailprice < 1200 THEN '"public"' ELSE '"friends"' END END AS old FROM w)
SELECT id AS album_id, 'setting' AS kind, setting AS field, old AS old_value, desired AS new_value, 'policy ' || policy AS source, CASE WHEN old IN ('null', '"friends"') THEN 'couldn''t be put back to ' || old END AS note, CASE WHEN old IN ('null', '"friends"') THEN 'review' ELSE 'planned' END AS status FROM n WHERE old <> desired
UNION ALL SELECT id, 'finding', NULL, NULL, NULL, NULL, CASE WHEN p_size > 45 THEN 'over the item cap (' || p_size || ' > 45)' ELSE 'near the item cap (' || p_size || ' of 45)' END, 'info' FROM a WHERE p_size >= 40 AND id IN (SELECT id FROM w)
""")
def audited_albums(spark, sf_dir):
    """The audit as one step: albums in scope, settings to change, and findings."""
    rows = table(spark, sf_dir, "part").where("lower(p_brand) in ('brand#11', 'brand#22', 'brand#33') or p_size = 7")
    albums = rows.select(F.col("p_partkey").alias("album_id"), F.col("p_brand").alias("folder"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("item_count"), "p_size", "p_retailprice")
    downloads = F.when(F.col("p_size") % 3 == 0, "true").when(F.col("p_size") % 3 == 1, "false")
    privacy = F.when(F.col("p_retailprice") < 1200, '"public"').otherwise('"friends"')
    actual = albums.select("album_id", F.inline(F.array(*[F.struct(F.lit(k).alias("setting"), v.alias("value")) for k, v in (("downloads", downloads), ("privacy", privacy))])))
    wanted = [{"scope": ["Brand#[123][123]/*"], "downloads": True}, {"scope": ["*a"], "privacy": "unlisted"}]
    return steps.albums_audit(albums, actual, wanted, {"downloads": [True, False], "privacy": ["public", "unlisted", "private"]}, 40, 45)["changes"]
