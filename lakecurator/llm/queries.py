"""The registered queries of the corpus operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, codes, rules, secrets
from .common import table
from .decontaminate import decontaminate
from .hard_negatives import hard_negatives
from .near_duplicates import near_duplicates
from .packing import pack
from .repeats import remove_repeats
from .shards import shard_rows
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from .warc import read_archives, write_archives


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: in the folder that TOKENIZERS_DIR names, or where its package has it."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_longest_match_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), whole=True)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classifier.classify(docs.select("doc_id", "text"), classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~rules.learnable("doc_id")).alias("held_out"), "score", "predicted")


def op5_hyperminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, part=80, whole=100)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as source:
        folder = write_token_files(table(spark, sf_dir, "documents"), source.read(), end_id=2)
    found = read_token_files(spark, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_optimal_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), whole=True))


def op8_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), window=35, as_text=False)
    return found.withColumnRenamed("kept", "kept_sha256")


def op10_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=16)


def op11_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


def op12_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.STRONG))
    counts = [of(kind).alias(f"n_{kind}") for kind in secrets.STRONG]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op13_annulus_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v))),
m AS (SELECT DISTINCT doc_id, i, n, item_id FROM o JOIN v USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_LOWER} AS text FROM documents)),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1 + least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id, min(c) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1)),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM x ANTI JOIN h USING (doc_id, p) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Vectors of 64 components, as whole numbers.
_WHOLE = """SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _op11_sql() -> str:
    far = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))
    mean = ", ".join(f"CAST(floor(CAST(sum(x[{i}]) AS DOUBLE) / count(*)) AS BIGINT)" for i in range(1, 5))
    steps = []
    for r in range(3):
        steps.append(f"a{r} AS (SELECT vec_id, label, part, any_value(x) AS x, min(({far}) * 64 + entry) AS best FROM p JOIN b{r} USING (part) GROUP BY vec_id, label, part)")
        if r < 2:
            steps.append(f"b{r + 1} AS (SELECT part, entry, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT part, best % 64 AS entry, [{mean}] AS c FROM a{r} GROUP BY 1, 2) m USING (part, entry))")
    return f"""
WITH k AS ({_WHOLE}),
p AS (SELECT vec_id, label, part, v[4 * part + 1 : 4 * part + 4] AS x FROM (SELECT *, unnest(range(16)) AS part FROM k)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64),
b0 AS (SELECT part, entry, x AS c FROM p JOIN s USING (vec_id)),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b2),
o AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY 1, 2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o, h
"""

def _op12_sql() -> str:
    """Only for tables with one row for each doc_id."""
    patterns = dict(zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.IDENTIFIER, secrets.SECRET, secrets.ENDPOINT)))
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    each = "\nUNION ALL ".join(f"SELECT doc_id, {i} AS kind, regexp_extract_all(t, {quoted(p)}) AS m, regexp_split_to_array(t, {quoted(p)}) AS g FROM d" for i, p in enumerate(patterns.values()))
    good = f"CASE kind WHEN 0 THEN length(regexp_extract(m, {quoted(secrets.ASSIGN)}, 1)) >= 6 WHEN 4 THEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE true END"
    near = lambda kinds: f"EXISTS (FROM k WHERE k.doc_id = c.doc_id AND k.kind IN ({kinds}) AND abs(k.start - c.start) <= 400)"
    name = f"CASE kind {' '.join(f'WHEN {i} THEN {quoted(k)}' for i, k in enumerate(secrets.KINDS))} END || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS ({each}),
u AS (SELECT doc_id, kind, unnest(m) AS m, unnest(g[: len(m)]) AS g, unnest(range(len(m))) AS no FROM e WHERE len(m) > 0),
p AS (SELECT doc_id, kind, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY no) AS stop FROM u),
s AS (SELECT doc_id, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE {good}),
k AS (SELECT * FROM s c WHERE kind < 3 OR NOT EXISTS (FROM s b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.start < c.stop AND c.start < b.stop)),
a AS (SELECT * FROM k c WHERE kind < 3 OR (kind = 3 AND {near("0, 2, 4")}) OR (kind = 4 AND {near("1, 3")}) OR (kind = 5 AND {near("0, 2, 4")} AND {near("1, 3")})),
r AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({name}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({name}, ',' ORDER BY start, kind) AS spans FROM a GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)
"""

OP13_SQL = f"""
WITH w AS ({_WHOLE}),
k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v FROM w WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; the others are tested against brute force, round trips and held-out rows."""
    return {"op2_warc_round_trip": OP2_SQL, "op3_winnowing_decontamination": OP3_SQL, "op5_hyperminhash_near_duplicates": OP5_SQL, "op9_suffix_tree_repeats": OP9_SQL, "op11_segment_mean_codes": _op11_sql(), "op12_linked_credentials": _op12_sql(), "op13_annulus_hard_negatives": OP13_SQL}
