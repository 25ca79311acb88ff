"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of the k-word grams of a text, winnowing keeps each that is the least of some
window of consecutive grams. A span of k + width - 1 words that a document
shares with a benchmark item holds the same least gram on both sides, so
joining kept grams finds every shared span of that length. Documents with a
joined gram are read again; there each gram that an item kept is extended word
by word to both sides, comparing words and not hashes. Items shorter than a
window are found by their first one to three words, in the same pass.

Arrays are exploded with the outer forms: for the others the optimizer adds a
filter on the array's size and repeats the whole expression below it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: Words of a gram; a window of w words takes w - GRAM + 1 grams to choose from.
GRAM = 8
#: Benchmark grams, at under 1 kB each with their words, or document keys that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, after lower-casing: all ASCII but digits and a-z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Kind:
    """One way to find items: grams of k words, the least of `width` in a row; with width 1 the item's first k words. items: which."""

    k: int
    width: int
    items: Column


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATOR), "")


def _grams(hashes: Column, k: int) -> Column:
    """The hash of the k words from each position on."""
    each = F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(k))))
    return F.when(F.size(hashes) >= k, each).otherwise(F.array().cast("array<bigint>"))


def _with_least(df: DataFrame, grams: str, width: int) -> DataFrame:
    """Add least: the least of the `width` grams from each position on."""
    df, span = df.withColumn("least", F.col(grams)), 1
    while span < width:
        step = min(span, width - span)
        later = F.slice("least", step + 1, F.greatest(F.lit(0), F.size("least") - step))
        df, span = df.withColumn("least", F.zip_with("least", later, lambda a, b: F.least(a, b))), span + step
    return df.withColumn("least", F.slice("least", 1, F.greatest(F.lit(0), F.size("least") - (width - 1))))


def _hashed(df: DataFrame, kinds: list[Kind]) -> DataFrame:
    """df with words, and for each kind its grams."""
    out = df.withColumn("words", words_of(F.col("text"))).drop("text").withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    for n, kind in enumerate(kinds):
        out = out.withColumn(f"grams{n}", _grams(F.col("hashes"), kind.k))
    return out.drop("hashes")


def _around(p: Column, window: int, reach: int) -> list[Column]:
    """The words before a position, up to reach, and the window from it on."""
    words = F.col("words")
    left = F.when(p > 0, F.slice(words, F.greatest(F.lit(1), p + 1 - reach), F.least(p, F.lit(reach)))).otherwise(F.array().cast("array<string>"))
    return [left, F.slice(words, p + 1, F.lit(window))]


def _run(tests: list[Column]) -> Column:
    """How many of the tests hold before the first that doesn't."""
    out = F.lit(len(tests))
    for j in reversed(range(len(tests))):
        out = F.when(~F.coalesce(tests[j], F.lit(False)), F.lit(j)).otherwise(out)
    return out


def _if_small(df: DataFrame) -> DataFrame:
    """df for the small side of a join: broadcast behind a check of its rows, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _marks(items: DataFrame, kinds: list[Kind], window: int) -> DataFrame:
    """kind, gram, class, size, ileft, iright: the grams that items are found by, with the words around them.

    Grams with the same words around are the same mark, so an item that
    repeats a phrase has few of them, however long it is.
    """
    found = None
    for n, kind in enumerate(kinds):
        marked = _with_least(_hashed(items.where(kind.items), kinds[n : n + 1]), "grams0", kind.width)
        if kind.width > 1:
            chosen = lambda g, p: F.array_contains(F.slice(F.col("least"), F.greatest(F.lit(1), p + 2 - kind.width), F.least(p, F.lit(kind.width - 1)) + 1), g)
        else:
            chosen = lambda g, p: p == 0
        each = F.transform("grams0", lambda g, p: F.when(chosen(g, p), F.struct(g.alias("gram"), *[c.alias(x) for c, x in zip(_around(p, window, window - kind.k), ("ileft", "iright"))])))
        part = marked.select("class", F.size("words").alias("size"), F.explode_outer(each).alias("m")).where("m is not null").select(F.lit(n).alias("kind"), "class", "size", "m.*").distinct()
        found = part if found is None else found.unionByName(part)
    return cut(found)


def _spans(source: DataFrame, items: DataFrame, kinds: list[Kind], window: int) -> DataFrame:
    """doc, class, low, high: words [low, high) of a document that an item's windows match.

    One pass over all documents finds those that share a gram with an item, for
    all kinds at once. Of these alone, once for each different text, every
    place of a gram is looked up, and only places that hit are given the words
    around them and compared.
    """
    marks = _marks(items, kinds, window)
    keys = _if_small(marks.select("kind", "gram").distinct())
    hashed = _hashed(source.select("doc", "text"), kinds)
    prints = []
    for n, kind in enumerate(kinds):
        column = F.col(f"grams{n}")
        if kind.width > 1:
            hashed = _with_least(hashed, f"grams{n}", kind.width).withColumnRenamed("least", f"least{n}")
            column = F.col(f"least{n}")
        prints.append(F.transform(F.array_distinct(column), lambda g: F.struct(F.lit(n).alias("kind"), g.alias("gram"))))
    touched = cut(hashed.select("doc", F.inline_outer(F.concat(*prints))).join(keys, ["kind", "gram"], "left_semi").select("doc").distinct())

    again = cut(source.select("doc", "text").join(_if_small(touched), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text")))
    each = F.concat(*[F.transform(f"grams{n}", lambda g, p: F.struct(F.lit(n).alias("kind"), p.alias("p"), g.alias("gram"))) for n in range(len(kinds))])
    places = _hashed(again, kinds).select("doc", F.inline_outer(each)).join(keys, ["kind", "gram"], "left_semi")
    listed = places.groupBy("doc").agg(F.collect_list(F.struct("kind", "p", "gram")).alias("places"))  # a document's own places
    reach = max(window - kind.k for kind in kinds)
    worded = again.select("doc", words_of(F.col("text")).alias("words")).join(listed, "doc")
    around = F.transform("places", lambda x: F.struct(x["kind"].alias("kind"), x["p"].alias("p"), x["gram"].alias("gram"), *[c.alias(name) for c, name in zip(_around(x["p"], window, reach), ("left", "right"))]))
    found = worded.select("doc", F.inline_outer(around)).join(_if_small(marks), ["kind", "gram"])

    p, out = F.col("p"), []
    for n, kind in enumerate(kinds):
        rows = found.where(F.col("kind") == n)
        if kind.width == 1:
            length = F.col("size")
            rows = rows.where(F.slice("right", F.lit(1), length) == F.slice("iright", F.lit(1), length))
            out.append(rows.select("doc", "class", p.alias("low"), (p + length).alias("high")))
            continue
        before = _run([F.get("left", F.size("left") - j) == F.get("ileft", F.size("ileft") - j) for j in range(1, window - kind.k + 1)])
        after = _run([F.get("right", F.lit(kind.k - 1 + j)) == F.get("iright", F.lit(kind.k - 1 + j)) for j in range(1, window - kind.k + 1)])
        rows = rows.where(F.slice("right", 1, kind.k) == F.slice("iright", 1, kind.k))
        out.append(rows.select("doc", "class", (p - before).alias("low"), (p + kind.k + after).alias("high")).where(F.col("high") - F.col("low") >= window))
    spans = out[0]
    for part in out[1:]:
        spans = spans.union(part)
    return spans.groupBy("doc", "class", "low").agg(F.max("high").alias("high"))


def row_key() -> Column:
    """What tells rows of documents apart, whatever their doc_id: 128 bits of both; never null. Null texts are as empty ones."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit("")))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, key: str | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted array of strings) and contaminated for each row of docs.

    Words are maximal runs of digits, lower-cased letters and non-ASCII
    characters. A window is `window` consecutive words of an item, or the whole
    of a shorter item; items without words match nothing. A document word
    inside any occurrence of a window is hit; contaminated means n_hit > 0 and
    20 * n_hit >= n_words. Null texts have no words. Rows are told apart by
    128 bits of doc_id and text, so repeated rows get equal results and doc_id
    may be null; `key` names a column that returns it: see row_key(). Items of equal words are looked up once, and each is reported.
    Items with a null item_id hit words like others; they count as one item and
    have no name among items. Very long texts are read whole, other columns are
    ignored, and an empty table gives an empty result. `window` is at least 2.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", row_key())
    listed = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    listed = listed.withColumn("class", F.sha2(F.concat_ws(" ", "words"), 256))
    listed = cut(listed)
    items = cut(listed.groupBy("class").agg(F.first("words").alias("words")).withColumn("text", F.concat_ws(" ", "words")))

    lengths = {r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()}  # `window` values at most
    k = min(GRAM, (window + 1) // 2)
    kinds = [Kind(k, window - k + 1, F.size("words") >= window)] if window in lengths else []
    for lead in sorted({min(3, n) for n in lengths if n < window}):  # short items are compared whole
        kinds.append(Kind(lead, 1, (F.size("words") < window) & (F.least(F.size("words"), F.lit(3)) == lead)))
    counts = source.select("doc_id", "doc", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    if not kinds:
        summary = counts.select("doc", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(0).alias("unnamed")).limit(0)
    else:
        hits = cut(_spans(source, items, kinds, window))
        spans = hits.select("doc", "low", "high").distinct()
        before = Window.partitionBy("doc").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
        new = F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce(F.max("high").over(before), F.lit(0))))
        covered = spans.withColumn("new", new).groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))
        named = hits.select("doc", "class").distinct().join(listed.select("class", "item_id"), "class").groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
        summary = covered.join(named, "doc")
    out = counts.join(summary, "doc", "left")
    out = out.select("doc_id", *([F.col("doc").alias(key)] if key else []), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
