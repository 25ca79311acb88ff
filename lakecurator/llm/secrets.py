"""Secrets in texts: what is one by itself, and parts of credentials that vouch for each other.

Three kinds of span are reported wherever they stand: assignments of a value to
a name like password, access keys, and long hexadecimal runs. Three more are
candidates: names of users, runs that look random, and addresses. By itself a
candidate says little, so it is reported only where the parts that make it a
credential stand nearby: an identifier with a secret, a secret with an
identifier, an address with both.

Only DataFrame functions are used. Spans are found once, in the scan: a match's
place is the sum of the gaps and matches before it. Linking is an interval join
without pairs. Places are cut into cells as wide as the reach, of each cell and
role only the first and last place are kept, and a candidate looks into three
cells; so a text with a million parts costs a million rows, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: What the kinds that stand by themselves look like. Letters of the names in either case, ASCII alone.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so asking for the length here finds the same as dropping short matches after.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Characters that the value of an assignment has at least.
VALUE = 6
#: Candidates: a name given for a user or key, a run of base64 that is long enough for a key, an address with its scheme.
IDENTIFIER = r"""(?i:access_?key_?id|access_?key|client_?id|account|login|user_?name|user_?id|user)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
SECRET = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x00-\x20"'<>]+"""
#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = KINDS[:3]
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
#: What must stand within reach of a candidate.
NEEDS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}


def _matches(text: Column, kind: str, pattern: str, gate: Column, fine=None) -> Column:
    """Of each match of a pattern its kind, number, the characters since the last one, its own, and whether it counts: in one array."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap"))

    def described(pair: Column, at: Column) -> Column:
        good = F.lit(True) if fine is None else fine(pair["match"])
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), at.alias("at"), F.length(pair["gap"]).alias("gap"), F.length(pair["match"]).alias("size"), good.alias("good"))

    found = F.filter(F.transform(pairs, described), lambda x: x["size"].isNotNull())  # there is a gap more than matches
    return F.when(gate, found).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,good:boolean>>"))


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, key and hits of each row: one pass over the texts, which go no further.

    key is a digest of texts with a hit, else null. Candidates are looked for
    only where they could be linked: an identifier and a secret of some kind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    gated = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        text.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""").alias("assigns"),
        text.contains("AKIA").alias("accesses"),
        text.rlike("[0-9a-f]{24}").alias("hexes"),
        text.rlike(r"""(?i:key|id|account|login|username|user)["']?\x20*[:=]""").alias("names"),
        text.rlike("[A-Za-z0-9+/]{32}").alias("runs"),
    )
    names, others = F.col("accesses") | F.col("names"), F.col("assigns") | F.col("hexes") | F.col("runs")
    linked = names & others
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    hits = F.concat(
        _matches(F.col("text"), "assign", ASSIGN, F.col("assigns"), lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= VALUE),
        _matches(F.col("text"), "access", ACCESS, F.col("accesses")),
        _matches(F.col("text"), "hex", HEX, F.col("hexes")),
        _matches(F.col("text"), "identifier", IDENTIFIER, linked & F.col("names")),
        _matches(F.col("text"), "secret", SECRET, linked & F.col("runs"), mixed),
        _matches(F.col("text"), "endpoint", ENDPOINT, linked & F.col("text").contains("://")),
    )
    some = F.col("assigns") | F.col("accesses") | F.col("hexes") | linked
    return cut(gated.select("doc_id", F.when(some, F.md5(F.col("text"))).alias("key"), F.when(some, hits).alias("hits")))


def _placed(scanned: DataFrame) -> DataFrame:
    """doc_id, key, kind, start, stop: spans that count, of distinct rows; candidates that lie in a strong span are left out."""
    each = scanned.where("key is not null").select("doc_id", "key", F.inline_outer("hits")).where("kind is not null").distinct()
    along = Window.partitionBy("doc_id", "key", "kind").orderBy("at")
    before = F.coalesce(F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before
    spans = each.withColumn("start", start).where("good").select("doc_id", "key", "kind", "start", (F.col("start") + F.col("size")).alias("stop"))
    text = Window.partitionBy("doc_id", "key").orderBy("start")
    strong = F.col("kind") < len(STRONG)
    ends = F.max(F.when(strong, F.col("stop"))).over(text.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(strong, F.col("start"))).over(text.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    apart = F.coalesce(ends <= F.col("start"), F.lit(True)) & F.coalesce(begins >= F.col("stop"), F.lit(True))
    return spans.withColumn("_apart", apart).where(strong | F.col("_apart")).drop("_apart")


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """The candidates of spans whose complements all begin within `reach` characters of them."""
    roles = F.create_map(*[F.lit(x) for i, kind in enumerate(KINDS) for x in (i, ROLES[kind])])
    cells = spans.withColumn("role", roles[F.col("kind")]).groupBy("doc_id", "key", "role", F.floor(F.col("start") / reach).alias("cell")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.create_map(*[x for kind, roles_ in NEEDS.items() for x in (F.lit(KINDS.index(kind)), F.array(*map(F.lit, roles_)))])
    asked = spans.where(F.col("kind") >= len(STRONG)).withColumn("needs", needs[F.col("kind")])
    asked = asked.select("*", F.explode_outer("needs").alias("role")).select("*", F.explode(F.array(*[F.floor(F.col("start") / reach) + i for i in (-1, 0, 1)])).alias("cell"))
    a, c = asked.alias("a"), cells.alias("c")
    same = F.col("a.doc_id").eqNullSafe(F.col("c.doc_id"))
    for column in ("key", "role", "cell"):
        same = same & (F.col(f"a.{column}") == F.col(f"c.{column}"))
    met = a.join(c, same & (F.col("c.first") <= F.col("a.start") + reach) & (F.col("c.last") >= F.col("a.start") - reach))
    found = met.groupBy(*[F.col(f"a.{x}").alias(x) for x in ("doc_id", "key", "kind", "start", "stop")]).agg(F.count_distinct("a.role").alias("met"), F.max(F.size("a.needs")).alias("asked"))
    return found.where("met = asked").drop("met", "asked")


def secret_spans(docs: DataFrame, reach: int = 400) -> DataFrame:
    """(doc_id, spans) for each row of docs: an array of (kind, start, stop, linked), by start and then kind in the order of KINDS.

    Places are in code points, stop exclusive. linked marks candidates, which
    are reported only with their complements within `reach` characters and
    outside the spans that stand by themselves. Spans of one kind don't
    overlap; those of two kinds may. Null texts are empty and have no span.
    Rows with null or repeated doc_ids are judged by their own text, and rows
    that repeat wholly get equal results. Very long texts are read whole; one
    word of any length takes time in proportion. Candidates of one start and
    kind can't tie. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    scanned = _scan(docs)
    spans = cut(_placed(scanned))
    all_ = spans.where(F.col("kind") < len(STRONG)).withColumn("linked", F.lit(False)).unionByName(_linked(spans, reach).withColumn("linked", F.lit(True)))
    names = F.array(*map(F.lit, KINDS))
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "linked")))
    by_text = all_.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(listed.alias("spans"))
    named = F.transform("spans", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["linked"].alias("linked")))
    by_text = by_text.select("_id", "_key", named.alias("spans"))
    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,linked:boolean>>")
    without = scanned.where("key is null").select("doc_id", none.alias("spans"))
    with_ = scanned.where("key is not null").select("doc_id", "key").join(by_text, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return without.unionByName(with_.select("doc_id", F.coalesce("spans", none).alias("spans")))


def listed(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
