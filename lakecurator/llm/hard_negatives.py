"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A vector x becomes (x, sqrt(M - |x|^2)), with M the largest squared norm of the
table, and an anchor q becomes (q, 0). Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so
the nearest rows are those with the highest scores, and a window of scores is a
ring around the anchor: an annulus of distances.

The upper levels of the tree are fitted on a bounded sample and hold all rows:
every row goes down by its distance to the vantage points, and for each leaf the
least and greatest distance of its rows to every vantage point above it are
kept. A leaf is dealt into pieces of bounded size by hash, so a vector that
fills a third of the table makes many pieces; each piece has a tree of its own
down to buckets. Anchors meet pieces in blocks, nearest leaves first, in waves
that double in width. What a wave found tells how near a further row must be,
and by the triangle inequality whole leaves and buckets are passed over that lie
outside the annulus or too far away. Distances only decide what is passed over,
with room for their error; scores are whole numbers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare
from .vectors import whole_vectors

#: Rows with the least hashes, on which the upper tree is fitted: its vantage points and radii. All rows are in the tree.
SAMPLE = 8192
#: Rows of a piece, about; rows of a bucket; anchors of a block, about.
PIECE, BUCKET, BLOCK = 1024, 128, 512
#: Levels of the upper tree at most; pieces of a block in the first wave.
LEVELS, WAVE = 9, 8
#: Pieces up to which a list of their numbers, 16 bytes each, is broadcast.
BROADCAST_PIECES = 1 << 18
#: Bytes of an Arrow batch.
BATCH_BYTES = 64 << 20
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NO_LOW, _NO_HIGH = -(2**62), 2**62
_ROW = "vec_id long, label long, v array<int>"


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as found:
        return {k: found[k] for k in found.files}


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of `width` numbers, short ones ending in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b: in doubles where these hold them exactly, else in 64-bit integers."""
    peak = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if peak < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Space:
    """Distances between augmented vectors; most is the largest squared norm."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        self.room = 1e-6 * (1 + most**0.5)  # more than the error of a distance

    def rest(self, x: np.ndarray) -> np.ndarray:
        """The component that is added to each row."""
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))

    def rows(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """From each row to each point, which is a row too."""
        dots = x.astype(np.float64) @ points.astype(np.float64).T + np.outer(self.rest(x), self.rest(points))
        return np.sqrt(np.maximum(0, 2 * (self.most - dots)))

    def anchors(self, q: np.ndarray, points: np.ndarray) -> np.ndarray:
        """From each anchor to each row."""
        return self.of_scores(q, products(q, points))

    def ring(self, q: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """How near and how far a row must be to qualify for each query, as far as is known."""
        own = q["v"][q["anchor"]]
        return self.of_scores(own, q["high"]), self.of_scores(own, np.maximum(q["low"], q["kth"]))

    def of_scores(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distances that scores of the anchors q stand for."""
        norms = (q.astype(np.float64) ** 2).sum(axis=1)
        norms = norms[:, None] if scores.ndim == 2 else norms
        return np.sqrt(np.maximum(0, norms + self.most - 2.0 * scores))


class UpperTree:
    """Vantage points and radii in heap order, fitted on a sample: a row goes left within the radius, else right."""

    def __init__(self, space: Space, sample: np.ndarray, levels: int):
        self.space, self.levels, nodes = space, levels, (1 << levels) - 1
        self.points, self.radii = np.zeros((nodes, space.width), np.int64), np.zeros(nodes)
        below = {0: sample}
        for node in range(nodes):
            rows = below.pop(node)
            inner = np.zeros(len(rows), bool)
            if len(rows):
                self.points[node] = rows[0]
                far = space.rows(rows, rows[:1])[:, 0]
                self.radii[node] = np.median(far)
                inner = far <= self.radii[node]
            below[2 * node + 1], below[2 * node + 2] = rows[inner], rows[~inner]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distances to the vantage points above that, from the root on."""
        node, path, rest = np.zeros(len(x), np.int64), np.zeros((len(x), self.levels)), self.space.rest(x)
        point_rest, x = self.space.rest(self.points), x.astype(np.float64)
        for level in range(self.levels):
            dots = np.einsum("ij,ij->i", x, self.points[node].astype(np.float64)) + rest * point_rest[node]
            path[:, level] = np.sqrt(np.maximum(0, 2 * (self.space.most - dots)))
            node = 2 * node + 1 + (path[:, level] > self.radii[node])
        return node - ((1 << self.levels) - 1), path

    def above(self, leaf: int) -> list[int]:
        """The nodes from the root to a leaf."""
        node, out = leaf + (1 << self.levels) - 1, []
        while node:
            node = (node - 1) // 2
            out.append(node)
        return out[::-1]


def _between(far: np.ndarray, paths: list[list[int]], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How near and how far the rows of each part can be from each anchor.

    far: anchors by vantage points; paths: the points above each part; low and
    high: the distances of its rows to these, parts by levels.
    """
    near, most = np.zeros((len(far), len(paths))), np.full((len(far), len(paths)), np.inf)
    for i, path in enumerate(paths):
        if path:
            d = far[:, path]
            near[:, i] = np.maximum(0, np.maximum(d - high[i], low[i] - d)).max(axis=1)
            most[:, i] = (d + high[i]).min(axis=1)
    return near, most


def _piece(space: Space, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> bytes:
    """Rows of a piece in the order of a tree down to buckets of equal depth, with the bounds of each bucket."""
    levels = max(0, int(np.ceil(np.log2(max(1, len(ids)) / BUCKET))))
    parts, points, paths, low, high = [np.lexsort((ids,))], [], [[]], [[]], [[]]
    for _ in range(levels):
        halves = []
        for part, path, lo, hi in zip(parts, paths, low, high):
            far = space.rows(v[part], v[part[:1]])[:, 0]
            order = np.argsort(far, kind="stable")
            points.append(part[0] if len(part) else 0)
            for half in np.array_split(order, 2):
                ends = (far[half].min(), far[half].max()) if len(half) else (0.0, 0.0)
                halves.append((part[half], [*path, len(points) - 1], [*lo, ends[0]], [*hi, ends[1]]))
        parts, paths, low, high = map(list, zip(*halves))
        # the bounds of the levels above hold for both halves
    order = np.concatenate(parts)
    return _saved(ids=ids[order], labels=labels[order], v=_small(v[order]), ends=np.cumsum([len(p) for p in parts]), points=_small(v[np.array(points, int)]), paths=np.array(paths, np.int32).reshape(len(parts), levels), low=np.array(low).reshape(len(parts), levels), high=np.array(high).reshape(len(parts), levels))


class Index:
    """All rows in pieces: a table (leaf, piece, rows) in the shared folder, and for each leaf its pieces and bounds."""

    def __init__(self, rows: DataFrame, piece: int = PIECE, sample: int = SAMPLE):
        norm = F.aggregate("v", F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long") * x)
        width, most, n = rows.agg(F.max(F.size("v")), F.max(norm), F.count("*")).first()
        space = self.space = Space(max(1, width or 0), most or 0)
        mark = F.xxhash64("vec_id", "v")
        share = (2 * sample + 64) / max(1, n)  # of the hashes; else each task would send the driver a sample of its own
        drawn = (rows if share >= 1 else rows.where(mark < int(2**64 * share) - 2**63)).orderBy(mark, "vec_id", "v").limit(sample).select("v").collect()
        levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n / (2 * piece)))))))
        tree = self.tree = UpperTree(space, np.array([r.v + [0] * (space.width - len(r.v)) for r in drawn], np.int64).reshape(len(drawn), space.width), levels)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf, path = tree.leaves(matrix(batch["v"], space.width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(list(path), pa.list_(pa.float64()))], [*batch.schema.names, "leaf", "path"])

        self.rows = cut(rows.mapInArrow(route, f"{_ROW}, leaf int, path array<double>"))
        ends = [f(F.get("path", F.lit(i))) for i in range(levels) for f in (F.min, F.max)]
        bounds = {r[0]: r[1:] for r in self.rows.groupBy("leaf").agg(F.count("*"), *ends).collect()}  # 2^LEVELS rows at most
        self.leaves = sorted(bounds)
        self.pieces = {leaf: -(-bounds[leaf][0] // piece) for leaf in self.leaves}
        self.low = np.array([bounds[leaf][1::2] for leaf in self.leaves]).reshape(len(self.leaves), levels)
        self.high = np.array([bounds[leaf][2::2] for leaf in self.leaves]).reshape(len(self.leaves), levels)
        spark = rows.sparkSession
        counts = F.broadcast(spark.createDataFrame([*self.pieces.items()], "leaf int, pieces int"))

        def pack(key: tuple, found: pa.Table) -> pa.Table:
            blob = _piece(space, found["vec_id"].to_numpy(), found["label"].to_numpy(), matrix(found["v"], space.width))
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()), "rows": pa.array([blob], pa.binary())})

        dealt = self.rows.join(counts, "leaf").withColumn("piece", F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces").cast("long")).cast("int"))
        self.table = cut(dealt.select("leaf", "piece", "vec_id", "label", "v").groupBy("leaf", "piece").applyInArrow(pack, "leaf int, piece int, rows binary"))

    def waves(self) -> list[tuple[int, int]]:
        """Which places of a block's list of pieces each wave takes: each as many as all before it, and WAVE at first."""
        total, out, at = sum(self.pieces.values()), [], 0
        while at < total:
            out.append((at, at + max(WAVE, at)))
            at = out[-1][1]
        return out


def _targets(index: Index, wave: tuple[int, int], queries: bool = True):
    """A mapInArrow function: the pieces of a wave that a block must look into, with the block's queries unless those are left out.

    The list of a block goes by how near a leaf can be to one of its queries.
    Leaves outside all annuli aren't in it; leaves that what was found so far
    rules out are passed over.
    """
    space, tree, leaves, pieces, low, high = index.space, index.tree, index.leaves, index.pieces, index.low, index.high
    paths = [tree.above(leaf) for leaf in leaves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob, kth in zip(batch["block"].to_pylist(), batch["queries"].to_pylist(), batch["kth"].to_pylist()):
                q = _loaded(blob)
                for r in kth or []:
                    q["kth"][r["q"]] = r["score"]
                near, most = (x[q["anchor"]] for x in _between(space.anchors(q["v"], tree.points), paths, low, high))
                inner, outer = space.ring(q)
                met = (most >= inner[:, None] - space.room) & (near <= space.of_scores(q["v"][q["anchor"]], q["low"])[:, None] + space.room)
                still = met & (near <= outer[:, None] + space.room)
                first = np.where(met, near, np.inf).min(axis=0)
                listed = [(leaf, i, p) for _, leaf, i in sorted((first[i], leaf, i) for i, leaf in enumerate(leaves) if met[:, i].any()) for p in range(pieces[leaf])][wave[0] : wave[1]]
                sent = [(leaf, p) for leaf, i, p in listed if still[:, i].any()]
                if sent and not queries:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in sent], pa.int32()) for i in (0, 1)], ["leaf", "piece"])
                elif sent:
                    ready = _saved(**q)
                    for leaf, p in sent:
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([leaf], pa.int32()), pa.array([p], pa.int32()), pa.array([ready], pa.binary())], ["block", "leaf", "piece", "queries"])

    return run


def nearest_first(space: Space, q: dict[str, np.ndarray], p: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a piece the k first of each query: query, vec_id and score.

    Buckets go nearest first, and each is looked into by the queries that it
    can still give something: it meets their annulus, and isn't farther than
    the k-th row that they have.
    """
    anchor, own = q["anchor"], q["v"].astype(np.int64)
    near, most = _between(space.anchors(own, p["points"]), [list(x) for x in p["paths"]], p["low"], p["high"])
    near, most = near[anchor], most[anchor]
    floor = np.maximum(q["low"], q["kth"])
    inner, _ = space.ring(q)
    of, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    starts = np.concatenate([[0], p["ends"][:-1]])
    for bucket in np.argsort(near.min(axis=0), kind="stable"):
        a, b = starts[bucket], p["ends"][bucket]
        outer = space.of_scores(own[anchor], floor)
        asks = np.nonzero((near[:, bucket] <= outer + space.room) & (most[:, bucket] >= inner - space.room))[0]
        if not len(asks) or a == b:
            continue
        anchors, at = np.unique(anchor[asks], return_inverse=True)
        found = products(own[anchors], p["v"][a:b])[at]
        fits = (found >= floor[asks, None]) & (found <= q["high"][asks, None])
        fits &= (p["labels"][None, a:b] == q["labels"][asks, None]) == same
        fits &= p["ids"][None, a:b] != q["ids"][asks, None]
        i, j = np.nonzero(fits)
        if not len(i):
            continue
        of, ids, scores = np.concatenate([of, asks[i]]), np.concatenate([ids, p["ids"][a:b][j]]), np.concatenate([scores, found[i, j]])
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        full = place == k - 1
        floor[of[full]] = np.maximum(floor[of[full]], scores[full])
        of, ids, scores = of[place < k], ids[place < k], scores[place < k]
    return of, ids, scores


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, anchor_key, given_id, given_score, rank, vec_id, score: the k first rows of each query, highest scores first, then by vec_id.

    queries: block, anchor_id, anchor_key, label, v, given_id, given_score, low
    and high; rows qualify with a score in [low, high], of the anchor's label
    or (same false) of another, and with another vec_id.
    """
    space = index.space

    def pack(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by([(c, "ascending") for c in ("anchor_id", "anchor_key", "given_score", "given_id")])
        ids, keys = found["anchor_id"].to_numpy(), found["anchor_key"].to_numpy()
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
        columns = {c: found[c].to_numpy() for c in ("given_id", "given_score", "low", "high")}
        blob = _saved(ids=ids, keys=keys, labels=found["label"].to_numpy(), anchor=np.cumsum(new) - 1, v=_small(matrix(found["v"], space.width)[new]), kth=np.full(len(ids), _NO_LOW), **columns)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "queries": pa.array([blob], pa.binary())})

    blocks = cut(queries.groupBy("block").applyInArrow(pack, "block long, queries binary"))
    names = ["anchor_id", "anchor_key", "given_id", "given_score", "vec_id", "score"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, queries_, rows in zip(*(batch[c].to_pylist() for c in ("block", "queries", "rows"))):
                q = _loaded(queries_)
                of, ids, scores = nearest_first(space, q, _loaded(rows), k, same)
                found = [np.full(len(of), block), of, q["ids"][of], q["keys"][of], q["given_id"][of], q["given_score"][of], ids, scores]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["block", "q", *names])

    found, few = None, sum(index.pieces.values()) <= BROADCAST_PIECES
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    for wave in index.waves():
        asked = blocks
        if found is not None:
            full = found.groupBy("block", "q").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
            asked = asked.join(full.groupBy("block").agg(F.collect_list(F.struct("q", "score")).alias("kth")), "block", "left")  # a number for each query of a block
        else:
            asked = asked.withColumn("kth", F.lit(None).cast("array<struct<q:bigint,score:bigint>>"))
        asked = asked.select("block", "queries", "kth")
        sent = asked.mapInArrow(_targets(index, wave), "block long, leaf int, piece int, queries binary")
        wanted = asked.mapInArrow(_targets(index, wave, queries=False), "leaf int, piece int").distinct()
        pieces = index.table.join(F.broadcast(wanted) if few else wanted, ["leaf", "piece"], "left_semi")  # only these are shuffled
        # a block's queries are sent with each of its pieces, which sizes that are estimated don't show: never to be broadcast
        new = sent.join(pieces.hint("merge"), ["leaf", "piece"]).select("block", "queries", "rows").mapInArrow(look, ", ".join(f"{c} long" for c in ("block", "q", *names)))
        new = new if found is None else found.drop("rank").unionByName(new)
        found = cut(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    return found.select(*names, "rank")


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, piece: int = PIECE, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the negatives of each anchor and positive.

    embeddings: vec_id, embedding, label; see whole_vectors() for which rows
    take part, of those with a vec_id and a label. Anchors are rows whose
    vec_id is divisible by `every`, their positives the first `positives` rows
    of the same label. Negatives are the first k rows of another label with
    low * positive_score <= 100 * score <= high * positive_score. Higher scores
    come first, ties by smaller vec_id. Rows equal in vec_id, label and vector
    count once; rows of one vec_id that differ each count, but aren't each
    other's positives or negatives. Short vectors end in zeros. An anchor
    without positives or whose windows are empty gives no row. Other columns
    are ignored; an empty table gives an empty result. There are no texts, so
    no long ones. The result is exact: nothing is approximated.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # a row of the search is a block with a piece
    rows = cut(whole_vectors(embeddings).where("vec_id is not null and label is not null").distinct())
    if rows.isEmpty():
        return spark.createDataFrame([], RESULT)
    index = Index(rows, piece, sample)
    anchors = index.rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    placed, at = [], 0
    for leaf, n in sorted((r.leaf, r["n"]) for r in anchors.groupBy("leaf").agg(F.count("*").alias("n")).collect()):  # blocks are of neighbouring leaves; a large leaf fills several
        placed.append((leaf, at // BLOCK, -(-n // BLOCK)))
        at += -(-n // BLOCK) * BLOCK if n > BLOCK else n
    blocks = F.broadcast(spark.createDataFrame(placed, "leaf int, first long, many long"))
    key = F.xxhash64("label", "v").alias("anchor_key")
    anchors = cut(anchors.join(blocks, "leaf").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("many"))).alias("block"), F.col("vec_id").alias("anchor_id"), key, "label", "v"))
    none = F.lit(0).cast("long")
    found = search(index, anchors.select("*", none.alias("given_id"), none.alias("given_score"), F.lit(_NO_LOW).alias("low"), F.lit(_NO_HIGH).alias("high")), positives, True)
    score = F.col("score")
    floor = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    windows = found.select("anchor_id", "anchor_key", F.col("vec_id").alias("given_id"), score.alias("given_score"), (-floor(-low * score)).alias("low"), floor(high * score).alias("high")).where("low <= high")
    negatives = search(index, anchors.join(windows, ["anchor_id", "anchor_key"]).select("block", "anchor_id", "anchor_key", "label", "v", "given_id", "given_score", "low", "high"), k, False)
    return negatives.select("anchor_id", F.col("given_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("given_score").alias("positive_score"), F.col("score").alias("negative_score"))
