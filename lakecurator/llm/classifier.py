"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Words hash into slots. Every slot has a fixed sparse random index vector, and
its context vector is the sum of the index vectors of the words around it over
the whole corpus, in whole numbers, so the sum doesn't depend on the order of
rows. A text is pooled to the mean and the spread of its words' vectors. A
network with one hidden layer is trained on a bounded sample of labelled rows
and its probabilities are calibrated by a temperature on a part held back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, with_arrow
from .rules import labelled_sample
from .wordhash import U64, mix, span_hashes, text_slices

DIMENSIONS, NONZERO, REACH = 32, 2, 2
#: Slots by kind of token: lower-case or mixed letters, letters all upper-case, digits, other signs.
KIND_SLOTS = (12_288, 1_024, 512, 2_560)
SLOTS = sum(KIND_SLOTS)
_FIRST = np.concatenate([[0], np.cumsum(KIND_SLOTS)[:-1]])
#: Labelled rows that training takes at most, those with the smallest hash of doc_id.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
HIDDEN = 24
#: Bytes of text that are pooled at once; a word's vector takes many times its bytes.
_POOL_BYTES = 1 << 18
#: Partial tables that one task adds up at once, of 64 slots each.
_FAN_IN, _BLOCK = 64, 64

# Kinds of bytes: 0 white space and control, 1 letter (and all non-ASCII), 2 digit, 3 other sign.
_KIND = np.full(256, 3, np.int8)
_KIND[:0x21] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_SMALL = np.zeros(256, bool)
_SMALL[0x61:0x7B] = _SMALL[0x80:] = True


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each slot the dimensions that are not zero, and their signs."""
    with np.errstate(over="ignore"):
        bits = mix(np.arange(1, SLOTS * NONZERO + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)).reshape(SLOTS, NONZERO)
    return (bits % U64(DIMENSIONS)).astype(np.int64), np.where((bits >> U64(40)) & U64(1), 1, -1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and document of each token; a token is a run of bytes of one kind."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets[(offsets > 0) & (offsets < len(data))]] = True
    edge = np.flatnonzero(change)
    starts, ends = edge[:-1], edge[1:]
    real = kind[starts] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    small = np.concatenate([[0], np.cumsum(_SMALL[data])])
    which = kind[starts].astype(np.int64)
    which = np.where(which == 1, np.where((small[ends] == small[starts]) & (ends - starts > 1), 1, 0), which)
    slots = np.array(KIND_SLOTS)[which]
    slot = (span_hashes(data, starts, ends) % slots.astype(U64)).astype(np.int64) + _FIRST[which]
    return slot, np.searchsorted(offsets, starts, "right") - 1


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of the context table: (block of slots, task, whole numbers)."""
    dims, signs = index_vectors()
    table = np.zeros(SLOTS * DIMENSIONS, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_slices(batch["text"]):
            slot, doc = tokens(data, offsets)
            for gap in range(1, REACH + 1):
                near = doc[gap:] == doc[:-gap]
                for own, other in ((slot[gap:][near], slot[:-gap][near]), (slot[:-gap][near], slot[gap:][near])):
                    for j in range(NONZERO):
                        table += np.bincount(own * DIMENSIONS + dims[other, j], signs[other, j], SLOTS * DIMENSIONS).astype(np.int64)
    blocks = table.reshape(-1, _BLOCK * DIMENSIONS)
    used = np.flatnonzero(blocks.any(1))
    task = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), task), pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "task", "sums"])


def context_table(docs: DataFrame) -> np.ndarray:
    """Context vectors of all slots over all rows; the partial tables are added up in a tree."""
    parts = docs.select("text").mapInArrow(context_sums, "block int, task int, sums binary")

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK * DIMENSIONS, np.int64)
        for blob in table["sums"]:
            total += np.frombuffer(blob.as_py(), np.int64)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "task": pa.array([table["task"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    left = docs.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // _FAN_IN)
        parts = parts.withColumn("task", F.floor(F.col("task") / _FAN_IN).cast("int")).groupBy("block", "task").applyInArrow(added, "block int, task int, sums binary")
    out = np.zeros((SLOTS // _BLOCK, _BLOCK * DIMENSIONS), np.int64)
    for row in parts.collect():  # at most one row for each block of slots
        out[row.block] += np.frombuffer(bytes(row.sums), np.int64)
    return out.reshape(SLOTS, DIMENSIONS)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """A slot's own index vector and its damped, centred context, each of length 1 at most."""
    dims, signs = index_vectors()
    own = np.zeros((SLOTS, DIMENSIONS), np.float32)
    for j in range(NONZERO):
        np.add.at(own, (np.arange(SLOTS), dims[:, j]), signs[:, j])
    own /= np.maximum(1, np.linalg.norm(own, axis=1, keepdims=True))
    seen = np.sign(contexts) * np.sqrt(np.abs(contexts))
    used = contexts.any(1)
    norm = np.linalg.norm(seen, axis=1, keepdims=True)
    seen = (seen / np.maximum(norm, 1e-9)).astype(np.float32)
    if used.any():
        seen[used] -= seen[used].mean(0)
    return np.concatenate([own, seen], 1)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a text's word vectors, how alike neighbours are, and the damped number of words."""
    n, width = len(offsets) - 1, vectors.shape[1]
    slot, doc = tokens(data, offsets)
    edges = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(edges)
    full = np.flatnonzero(count)
    means, spreads, alike = np.zeros((n, width), np.float32), np.zeros((n, width), np.float32), np.zeros(n)
    if len(full):
        total = np.maximum(1, count[full])[:, None]
        rows = vectors[slot]
        means[full] = np.add.reduceat(rows, edges[full], axis=0) / total
        squares = np.add.reduceat(rows * rows, edges[full], axis=0) / total - means[full] ** 2
        spreads[full] = np.sqrt(np.maximum(0, squares) * total / np.maximum(1, total - 1))  # as of a sample, so that short texts don't look narrow
        near = doc[1:] == doc[:-1]
        pairs = np.einsum("ij,ij->i", rows[1:, :DIMENSIONS], rows[:-1, :DIMENSIONS])[near]
        alike = np.bincount(doc[1:][near], pairs, n) / np.maximum(1, count - 1)
    return np.concatenate([means, spreads, np.stack([alike, np.log1p(count) / 10], 1).astype(np.float32)], 1)


def train(X: np.ndarray, y: np.ndarray, passes: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> dict:
    """A two-layer network by Adam on four fifths of the rows; the temperature minimises the log loss of the rest."""
    n, width = X.shape
    if n == 0 or y.min() == y.max():  # nothing to tell apart: the share seen, or an even chance
        share = (float(y.sum()) + 1) / (n + 2)
        return {"mean": np.zeros(width, np.float32), "scale": np.ones(width, np.float32), "layers": [np.zeros((width, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), np.array([np.log(share / (1 - share))], np.float32)], "temperature": 1.0}
    rng = np.random.default_rng(seed)
    mean, scale = X.mean(0), X.std(0) + 1e-3
    Z = (X - mean) / scale
    held = np.arange(n) % 5 == 4
    A, t = Z[~held], y[~held]
    layers = [(rng.standard_normal((width, HIDDEN)) / np.sqrt(width)).astype(np.float32), np.zeros(HIDDEN, np.float32), (rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(t))
        for low in range(0, len(t), batch):
            part = order[low : low + batch]
            hidden = np.tanh(A[part] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30)))
            error = ((p - t[part]) / len(part)).astype(np.float32)
            back = error[:, None] * layers[2][None, :] * (1 - hidden * hidden)
            slopes = [A[part].T @ back + decay * layers[0], back.sum(0), hidden.T @ error + decay * layers[2], error.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = (layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model = {"mean": mean, "scale": scale, "layers": layers, "temperature": 1.0}
    rest, truth = (X[held], y[held]) if held.any() else (X, y)
    raw = logits(model, rest)

    def loss(temperature: float) -> float:
        z = raw / temperature
        return float(np.mean(np.logaddexp(0, z) - truth * z))

    model["temperature"] = float(min(np.geomspace(0.5, 8, 121), key=loss))
    return model


def logits(model: dict, X: np.ndarray) -> np.ndarray:
    a, b, c, d = model["layers"]
    return (np.tanh((X - model["mean"]) / model["scale"] @ a + b) @ c + d[0]).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> dict:
    """The word vectors over all of docs, and the network from at most `rows` labelled rows."""
    spark = docs.sparkSession
    prepare(spark)
    vectors = word_vectors(context_table(docs))
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batch: pa.RecordBatch) -> Iterator[dict]:
        for first, end, data, offsets in text_slices(batch["text"], _POOL_BYTES):
            yield {"doc_id": batch["doc_id"].slice(first, end - first), "y": batch["y"].slice(first, end - first), "x": [r.tobytes() for r in pooled(data, offsets, shared.value)]}

    sample = with_arrow(labelled_sample(docs, labels, target, rows), pool, "doc_id long, y int, x binary").collect()  # at most `rows` rows
    sample.sort(key=lambda r: (r.doc_id, r.y, bytes(r.x)))
    width = 2 * vectors.shape[1] + 2
    X = np.frombuffer(b"".join(bytes(r.x) for r in sample), np.float32).reshape(len(sample), width)
    return train(X, np.array([r.y for r in sample], np.float32)) | {"vectors": vectors}


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, then score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Only the whole text is an input. Null and empty texts are scored as texts
    without words. Columns of docs named score or predicted are replaced.
    Repeated rows score alike, a null doc_id is a column like others, and very
    long texts are pooled whole. A score equal to the threshold predicts 1. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        m = shared.value
        for first, end, data, offsets in text_slices(batch["text"], _POOL_BYTES):
            score = 1 / (1 + np.exp(-np.clip(logits(m, pooled(data, offsets, m["vectors"])) / m["temperature"], -30, 30)))
            part = batch.slice(first, end - first)
            yield {c: part[c] for c in kept} | {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    return with_arrow(docs.select(*[F.col(f"`{c}`") for c in kept]), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "score double, predicted int"]))
