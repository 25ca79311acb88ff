"""Removal of long passages that repeat, by prefix-partitioned suffix trees.

A passage repeats if some window of consecutive words starts at two places of
the corpus. Not every suffix needs a tree: every window selects its least
k-word gram, so the suffixes that begin at selected grams, the anchors, meet
every window, and equal windows meet theirs at the same offset.

1. Suffixes are grouped by their prefix, at first the anchor. Prefixes that
   occur once are dropped. Equal suffixes become one leaf, counted by Spark's
   aggregation: several occurrences repeat all their windows, and one stands
   for them in the tree. A prefix with more leaves than a task should hold is
   lengthened: the offsets at which windows meet the anchor are split, and the
   words that all windows of a part share, before the anchor and after it, are
   the longer prefix. It grows in steps up to the whole window, where a leaf is
   a window and the count decides.
2. A task sorts the suffixes of its prefixes word by word. Neighbours' common
   lengths give the internal nodes of the subtree: suffixes between two shorter
   common lengths share a node of that depth. The words before the anchors,
   read backwards, give a second tree in the same way.
3. A window that meets its anchor at offset d is a path of d words in the second
   tree and of window - d words in the first. Two leaves that share both nodes
   are two occurrences, which is a maximal repeat at least as deep as the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, cut, prepare, unpacked, with_arrow
from .storage import new_folder
from .wordhash import ngram_hashes, run_hashes, span_hashes, text_slices, word_bounds

ANCHOR_WORDS = 10
#: Leaves of one prefix that a task may hold together; the prefix is lengthened beyond it.
GROUP_LIMIT = 4096
#: Halvings of the offsets at each lengthening of a prefix.
_STEP = 2


def _windows(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window that lies within one text, the position of its anchor, and all anchor hashes."""
    k = min(ANCHOR_WORDS, window)
    grams = ngram_hashes(words, k)
    count = len(words) - window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, grams
    starts = np.flatnonzero(doc[:count] == doc[window - 1 :])
    view = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    anchors = np.empty(len(starts), np.int64)
    for low in range(0, len(starts), 1 << 15):  # bounds the copy that argmin makes
        part = starts[low : low + (1 << 15)]
        anchors[low : low + (1 << 15)] = part + view[part].argmin(1)
    return starts, anchors, grams


def _anchored(data: np.ndarray, offsets: np.ndarray, window: int):
    """Words' bounds, texts and hashes; anchors with the least and largest offset of the windows that chose them; gram hashes."""
    starts, ends, doc = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    begins, chosen, grams = _windows(words, doc, window)
    head = np.flatnonzero(np.diff(chosen, prepend=-1))
    tail = np.append(head, len(chosen))[1:] - 1
    at = chosen[head]
    return starts, ends, doc, words, at, at - begins[tail], at - begins[head], grams


def _anchors(window: int):
    """Suffixes without their words: the anchor, the least and largest offset of windows that chose it, and the hash of all their words, the path."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rids, own = batch["_rid"].to_numpy(), batch["_own"].to_numpy()
        for first, _, data, offsets in text_slices(batch["text"]):
            _, _, doc, words, at, lo, hi, grams = _anchored(data, offsets, window)
            row = first + doc[at]
            path = run_hashes(words, at - hi, at - lo + window)
            yield {"key": grams[at].view(np.int64), "_rid": rids[row], "_own": own[row], "pos": (at - np.searchsorted(doc, doc[at])).astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "path": path.view(np.int64)}

    return run


_LEAF = "key long, _rid long, _own long, pos int, lo int, hi int, path long"
_SUFFIX = f"{_LEAF}, words binary"


def _between(raw: bytes, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    return [raw[i:j] for i, j in zip(low.tolist(), high.tolist())]


def _suffixes(window: int):
    """Leaves of the subtrees: an anchor with the words of all windows that chose it, from the first one's start to the last one's end, and their hash, the path."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        batch = batch.filter(batch["_places"].is_valid())
        rids, own = batch["_rid"].to_numpy(), batch["_own"].to_numpy()
        for first, end, data, offsets in text_slices(unpacked(batch["_z"])):
            starts, ends, doc, words, at, lo, hi, grams = _anchored(data, offsets, window)
            places = batch["_places"].slice(first, end - first)
            listed = (np.repeat(np.arange(end - first), places.value_lengths().to_numpy()) << 32) | places.flatten().to_numpy()
            pos = at - np.searchsorted(doc, doc[at])
            use = np.isin((doc[at] << 32) | pos, listed)
            at, lo, hi, pos = at[use], lo[use], hi[use], pos[use]
            row = first + doc[at]
            yield {"key": grams[at].view(np.int64), "_rid": rids[row], "_own": own[row], "pos": pos.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "path": run_hashes(words, at - hi, at - lo + window).view(np.int64), "words": _between(data.tobytes(), starts[at - hi], ends[at - lo + window - 1])}

    return run


def _leaves(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """(first row, end row, bytes, words' starts, ends and rows, hashes) of suffixes' words."""
    for first, end, data, offsets in text_slices(batch["words"]):
        starts, ends, row = word_bounds(data, offsets)
        yield first, end, data, starts, ends, row, span_hashes(data, starts, ends)


def _offsets(window: int) -> int:
    return window - min(ANCHOR_WORDS, window) + 1


def _longer(window: int, level: int):
    """Suffixes by longer prefixes: offsets are cut into 2**level parts, and a suffix goes to each part that it has windows in."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        n = _offsets(window)
        for first, end, data, starts, ends, row, words in _leaves(batch):
            part = batch.slice(first, end - first)
            lo, hi = (part[c].to_numpy() for c in ("lo", "hi"))
            at = np.searchsorted(row, np.arange(end - first)) + hi
            raw, hashed = data.tobytes(), {}
            for b in range(1 << level):
                low, high = -(-b * n >> level), -(-(b + 1) * n >> level) - 1
                use = np.flatnonzero((lo <= high) & (hi >= low)) if high >= low else np.zeros(0, np.int64)
                if not len(use):
                    continue
                size = window - (high - low)
                if size not in hashed:
                    hashed[size] = ngram_hashes(words, size, 3)
                least, most = np.maximum(lo[use], low), np.minimum(hi[use], high)
                took = part.take(pa.array(use))
                yield {c: took[c] for c in ("_rid", "_own", "pos")} | {"key": hashed[size][at[use] - low].view(np.int64), "lo": least, "hi": most, "path": run_hashes(words, at[use] - most, at[use] - least + window).view(np.int64), "words": _between(raw, starts[at[use] - most], ends[at[use] - least + window - 1])}

    return run


def _sorted(paths: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of paths word by word, and how many words each shares with the one before it."""
    bits = max(1, values.bit_length())
    step = 63 // bits
    keys = []
    for i in range(0, paths.shape[1], step):
        key = np.zeros(len(paths), np.int64)
        for j in range(i, min(i + step, paths.shape[1])):
            key = (key << bits) | paths[:, j]
        keys.append(key)
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(paths))
    same = np.ones((max(0, len(paths) - 1), paths.shape[1] + 1), bool)
    same[:, :-1] = paths[order[1:]] == paths[order[:-1]]
    same[:, -1] = False
    return order, np.concatenate([[0], same.argmin(1)])


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each leaf the number of its node at a depth: neighbours share it if they have that many words in common."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def deep_repeats(words: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, offset) of windows that two leaves share.

    words are numbered, row is each word's leaf; a leaf's words go from hi
    words before its anchor to the end of the window at offset lo.
    """
    n, base, values = len(lo), np.searchsorted(row, np.arange(len(lo))), int(words.max(initial=0)) + 1
    at = base + hi
    own = values + np.arange(n)  # a word that no other leaf has, where a path is over
    ahead, back = np.arange(window)[None, :], np.arange(_offsets(window) - 1)[None, :]
    forward = np.where(ahead < (window - lo)[:, None], words[np.minimum(at[:, None] + ahead, len(words) - 1)], own[:, None])
    backward = np.where(back < hi[:, None], words[np.maximum(at[:, None] - 1 - back, 0)], own[:, None])
    trees = _sorted(forward, values + n), _sorted(backward, values + n)
    found = []
    for d in range(_offsets(window)):
        use = np.flatnonzero((lo <= d) & (d <= hi))
        if len(use) < 2:
            continue
        pair = _nodes(*trees[0], window - d)[use] * (n + 1) + _nodes(*trees[1], d)[use]
        _, same, count = np.unique(pair, return_inverse=True, return_counts=True)
        use = use[count[same] > 1]
        found.append((use, np.full(len(use), d)))
    return tuple(np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _subtrees(window: int):
    """Suffixes, which arrive with their prefixes whole and in order: the windows at shared nodes."""

    def found(table: pa.Table) -> pa.RecordBatch:
        words, rows = [], []
        for first, _, _, _, _, row, hashes in _leaves(table):
            words.append(hashes)
            rows.append(row + first)
        lo, hi = (table[c].to_numpy() for c in ("lo", "hi"))
        leaf, offset = deep_repeats(pd.factorize(np.concatenate(words))[0], np.concatenate(rows), lo, hi, window)
        return _runs(table["_rid"].to_numpy()[leaf], table["_own"].to_numpy()[leaf], table["pos"].to_numpy()[leaf] - offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 14:
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last prefix may go on
                if cut:
                    yield found(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows -= cut
        if held:
            yield found(pa.Table.from_batches(held))

    return run


_RUN = "_rid long, _own long, start int, count int"


def _runs(rid: np.ndarray, own: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Window starts as (text, start, count) runs."""
    order = np.lexsort((start, own, rid))
    rid, own, start = rid[order], own[order], start[order]
    head = np.ones(len(rid), bool)
    head[1:] = (rid[1:] != rid[:-1]) | (own[1:] != own[:-1]) | (start[1:] > start[:-1] + 1)
    cut = np.flatnonzero(head)
    last = start[np.append(cut, len(rid))[1:] - 1]
    return pa.RecordBatch.from_arrays([pa.array(rid[cut], pa.int64()), pa.array(own[cut], pa.int64()), pa.array(start[cut], pa.int32()), pa.array(last - start[cut] + 1, pa.int32())], ["_rid", "_own", "start", "count"])


def _rest(window: int, as_text: bool, original: bool, extra: list[str]):
    """What is left of each text, from the runs of repeated windows."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        squeeze = zstandard.ZstdDecompressor().decompress
        n_words, n_removed, kept = [], [], []
        for i in range(batch.num_rows):
            if batch["_done"][i].is_valid:
                n_words.append(batch["_n"][i].as_py())
                n_removed.append(0)
                kept.append(batch["_done"][i].as_py())
                continue
            raw = squeeze(batch["_z"][i].as_py())
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
            cover = np.zeros(len(starts) + window + 1, np.int64)
            for r in batch["_runs"][i].as_py() or []:
                cover[r["start"]] += 1
                cover[r["start"] + r["count"] - 1 + window] -= 1
            gone = np.cumsum(cover)[: len(starts)] > 0
            n_words.append(len(starts))
            n_removed.append(int(gone.sum()))
            left = raw if original and not gone.any() else b" ".join(_between(raw, starts[~gone], ends[~gone]))
            kept.append(left.decode() if as_text else hashlib.sha256(left).hexdigest())
        yield {c: batch[c] for c in ["doc_id", *extra]} | {"n_words": n_words, "n_removed": n_removed, "kept": kept}

    return run


def _pack(as_text: bool, original: bool, extra: list[str]):
    """Texts without a repeated anchor lose nothing: their result is made here, the others' texts go on."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        z, done, count = [], [], []
        for i, text in enumerate(batch["_z"].to_pylist()):
            if batch["_any"][i].is_valid:
                z.append(text)
                done.append(None)
                count.append(None)
                continue
            raw = zstandard.ZstdDecompressor().decompress(text)
            words = raw.split()  # bytes split at ASCII white space
            left = raw if original else b" ".join(words)
            z.append(None)
            done.append(left.decode() if as_text else hashlib.sha256(left).hexdigest())
            count.append(len(words))
        yield {c: batch[c] for c in ["doc_id", *extra, "_rid", "_own", "_any", "_places"]} | {"_z": z, "_done": done, "_n": count}

    return run


def _squeeze(extra: list[str]):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        yield {c: batch[c] for c in ["doc_id", *extra, "_rid", "_own"]} | {"_z": [squeeze((x or "").encode()) for x in batch["text"].to_pylist()]}

    return run


def remove_repeats(docs: DataFrame, window: int = 35, as_text: bool = True, original: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns named in keep, n_words, n_removed and kept, for each row of docs.

    Words are split at ASCII white space and compared unchanged. Every word is
    removed that lies in a window of `window` words whose word sequence also
    starts anywhere else, in the same text or another; windows are judged on
    the input. kept is the rest joined by single spaces, or its SHA-256 in
    lower-case hex if as_text is false; with original, a text that loses
    nothing is kept as it was, white space and all. Null and empty texts have
    no words and keep nothing; very long texts are read whole; an empty table
    gives an empty result. Repeated rows are repeats of each other. Rows are
    told apart by doc_id and a 64-bit hash of doc_id and text, so doc_id may be
    null or repeated. A column in keep that is named like a result's comes back
    as <name>_in.
    """
    spark = docs.sparkSession
    prepare(spark)
    carried = Carried(docs, keep or [], ["doc_id", "n_words", "n_removed", "kept"])
    extra, ddl = carried.names, ", ".join(["doc_id long", *carried.ddl])
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried.columns).withColumn("_rid", F.xxhash64("doc_id", "text")).withColumn("_own", F.coalesce("doc_id", F.lit(0).cast("long")))
    key = ["_rid", "_own"]

    same, place = ["key", "path", "lo", "hi"], ["_rid", "_own", "pos", "lo"]

    def grouped(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Different leaves: how many are equal, and one of them; and every leaf with that number, as `n`, and that one."""
        groups = cut(leaves.groupBy(*same).agg(F.min(F.struct(*place)).alias("one"), F.count("*").alias("n")))
        return groups, cut(leaves.join(groups, same))

    def repeated(known: DataFrame) -> DataFrame:
        """The windows of leaves that have equals, as runs."""
        return known.where("n > 1").select(*key, (F.col("pos") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + 1).alias("count"))

    def single(known: DataFrame) -> DataFrame:
        """One of each set of equal leaves."""
        return known.where(F.struct(*place) == F.col("one")).drop("one", "n").dropDuplicates(place)

    def sized(groups: DataFrame) -> DataFrame:
        """Prefixes with several leaves, and whether those are too many."""
        return cut(groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > GROUP_LIMIT).alias("heavy")))

    suffixes = cut(with_arrow(source.select("text", *key), _anchors(window), _LEAF))
    twice = cut(suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    leaves = cut(suffixes.join(twice, "key"))
    groups, known = grouped(leaves)
    runs, sizes = repeated(known), sized(groups)
    chosen = single(known).join(sizes, "key")
    places = chosen.groupBy(*key).agg(F.collect_set(F.col("pos") * 2 + F.col("heavy").cast("int")).alias("_places"))
    places = leaves.select(*key).distinct().withColumn("_any", F.lit(True)).join(places, key, "left")
    squeezed = with_arrow(source, _squeeze(extra), f"{ddl}, _rid long, _own long, _z binary")
    joined = squeezed.join(places, key, "left").select("doc_id", *extra, *key, "_z", "_any", "_places")
    folder = new_folder(spark, "repeats")
    with_arrow(joined, _pack(as_text, original, extra), f"{ddl}, _rid long, _own long, _any boolean, _places array<int>, _z binary, _done string, _n long").write.option("compression", "zstd").parquet(folder)
    texts = spark.read.parquet(folder)

    def with_words(heavy: int) -> DataFrame:
        listed = F.transform(F.filter("_places", lambda p: p.bitwiseAND(F.lit(1)) == heavy), lambda p: F.shiftright(p, 1))
        some = texts.where(F.exists("_places", lambda p: p.bitwiseAND(F.lit(1)) == heavy)).dropDuplicates(key)
        return with_arrow(some.select(*key, "_z", listed.alias("_places")), _suffixes(window), _SUFFIX)

    trees, level, last = with_words(0), 0, (_offsets(window) - 1).bit_length()
    deep = None if sizes.where("heavy").isEmpty() else with_words(1)
    while deep is not None:
        level = min(level + _STEP, last)
        longer = cut(with_arrow(deep, _longer(window, level), _SUFFIX))
        (groups, known), deep = grouped(longer), None
        runs = runs.union(repeated(known))
        if level < last:
            sizes = sized(groups)
            trees = trees.union(single(known).join(sizes.where("not heavy"), "key", "left_semi").select(*trees.columns))
            if not sizes.where("heavy").isEmpty():
                deep = single(known).join(sizes.where("heavy"), "key", "left_semi").select(*trees.columns)
    trees = trees.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_subtrees(window), _RUN)
    runs = runs.union(trees)
    found = runs.groupBy(*key).agg(F.collect_set(F.struct("start", "count")).alias("_runs"))
    left = texts.drop("_places", "_any").join(found, key, "left")
    return carried.restored(with_arrow(left, _rest(window, as_text, original, extra), f"{ddl}, n_words long, n_removed long, kept string"))
