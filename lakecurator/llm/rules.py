"""Quality rules: countable faults, and a logistic regression on hashed n-grams.

The model sees words, pairs of words and runs of three characters, which are
code points, hashed into fixed slots. It is trained on a bounded sample of labelled rows, its probabilities are calibrated
on a part of them held back, and every text is scored in Arrow batches against
a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, with_arrow
from .wordhash import U64, WHITESPACE, mix, ngram_hashes, span_hashes, text_slices, word_bounds

#: Slots for words, for pairs of words, and for runs of three characters.
SLOTS = (2048, 2048, 4096)
#: Labelled rows that training takes at most, those with the smallest hash of doc_id.
SAMPLE_ROWS = 4000
#: A text is kept if its calibrated probability of being good reaches this.
KEEP_AT = 0.5
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def learnable(doc_id) -> F.Column:
    """Rows whose labels may be learnt: the checksum of the doc_id's text isn't 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def faults(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, doc = word_bounds(data, offsets)
    inside = ~WHITESPACE[data]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_text(_SYMBOL[data], offsets)}

    breaks = np.zeros(256, bool)
    breaks[0x0A] = True
    low, high, owner = word_bounds(data, offsets, breaks)
    words_before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    real = words_before[high] > words_before[low]
    with np.errstate(over="ignore"):
        keys = mix(span_hashes(data, low[real], high[real]) ^ mix(owner[real].astype(U64) + U64(1)))
        first = np.unique(keys, return_index=True)[1]
        out["n_dup_lines"] = np.bincount(owner[real], minlength=n) - np.bincount(owner[real][first], minlength=n)

        words = span_hashes(data, starts, ends)
        grams = ngram_hashes(words, REPEAT_WINDOW)
        at = np.flatnonzero(doc[: len(grams)] == doc[REPEAT_WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
        keys = mix(grams[at] ^ mix(doc[at].astype(U64) + U64(1)))
    _, same, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = at[count[same] > 1] if len(at) else at
    cover = np.zeros(len(words) + 1, np.int64)
    cover[twice] += 1
    np.subtract.at(cover, twice + REPEAT_WINDOW, 1)
    covered = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _shares(owner: np.ndarray, hashes: np.ndarray, n: int, slots: int) -> np.ndarray:
    """A row for each text: the roots of how often each slot occurs, scaled to length 1."""
    counts = np.bincount(owner * slots + (hashes % U64(slots)).astype(np.int64), minlength=n * slots).reshape(n, slots)
    damped = np.sqrt(counts.astype(np.float32))
    return damped / np.maximum(np.sqrt((damped * damped).sum(1, keepdims=True)), 1e-6)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: shares of word slots, of slots of word pairs, then of slots of three code points."""
    n = len(offsets) - 1
    starts, ends, doc = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    pairs = ngram_hashes(words, 2)
    near = doc[1:] == doc[:-1] if len(pairs) else np.zeros(0, bool)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(U64)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # where each text begins, in code points
    runs = ngram_hashes(points, 3, 5)
    owner = np.repeat(np.arange(n), np.diff(begins))
    within = owner[2:] == owner[: len(runs)] if len(runs) else np.zeros(0, bool)
    return np.concatenate([_shares(doc, words, n, SLOTS[0]), _shares(doc[: len(pairs)][near], pairs[near], n, SLOTS[1]), _shares(owner[: len(runs)][within], runs[within], n, SLOTS[2])], 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """text and y of at most `rows` learnable labelled documents; an id that documents or labels repeat counts once, by its smallest hash."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(f"y is not null and doc_id is not null").where(learnable("doc_id"))
    chosen = good.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def calibration(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * logit + offset) a probability, by Newton steps with a prior at (1, 0)."""
    theta = np.array([1.0, 0.0])
    X = np.stack([logits, np.ones_like(logits)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ theta, -30, 30)))
        gradient = X.T @ (p - y) + 0.1 * (theta - [1, 0])
        hessian = (X * (p * (1 - p))[:, None]).T @ X + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.05)), float(theta[1])


def train(X: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 4.0, decay: float = 1e-4) -> dict:
    """Weights by full-batch gradient descent with momentum on four fifths, calibration on the rest."""
    n = len(y)
    if n == 0 or y.min() == y.max():  # nothing to tell apart: the share seen, or an even chance
        share = float(y.mean()) if n else 0.5
        return {"w": np.zeros(sum(SLOTS), np.float32), "b": 0.0, "slope": 1.0, "offset": float(np.log((share * n + 1) / (n - share * n + 1)))}
    held = np.arange(n) % 5 == 4
    A, t = (X[~held], y[~held]) if (~held).any() else (X, y)
    w, b = np.zeros(X.shape[1], np.float32), float(np.log((t.sum() + 1) / (len(t) - t.sum() + 1)))
    speed, speed_b = np.zeros_like(w), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(A @ w + b, -30, 30)))
        error = (p - t).astype(np.float32)
        speed = 0.9 * speed + (A.T @ error / len(t) + decay * w)
        speed_b = 0.9 * speed_b + float(error.mean())
        w, b = w - rate * speed, b - rate * 0.1 * speed_b
    rest = (X[held], y[held]) if held.any() else (X, y)
    slope, offset = calibration((rest[0] @ w + b).astype(np.float64), rest[1].astype(np.float64))
    return {"w": w, "b": b, "slope": slope, "offset": offset}


def _features_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for first, end, data, offsets in text_slices(batch["text"]):
        found = features(data, offsets).astype(np.float16)
        yield {"doc_id": batch["doc_id"].slice(first, end - first), "y": batch["y"].slice(first, end - first), "x": [r.tobytes() for r in found]}


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """The model, from at most `rows` labelled rows of 16 kB each on the driver."""
    sample = with_arrow(labelled_sample(docs, labels, "quality", rows), _features_of, "doc_id long, y int, x binary").collect()
    sample.sort(key=lambda r: (r.doc_id, r.y, bytes(r.x)))
    X = np.frombuffer(b"".join(bytes(r.x) for r in sample), np.float16).reshape(len(sample), sum(SLOTS)).astype(np.float32)
    return train(X, np.array([r.y for r in sample], np.float32))


def quality_rules(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score for each row of docs.

    base_failed: under 20 words, or over 30 % of the words lie in 8-word
    windows that occur twice in the text. kept: not base_failed, and the
    model's calibrated probability of a good text is at least keep_at. Null
    and empty texts have no words and fail. Without usable labels every text
    has an even chance. Repeated rows are scored alike; null ids stay null.
    Very long texts are counted and scored whole; scores at keep_at are kept.
    Other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        m = model.value
        for first, end, data, offsets in text_slices(batch["text"]):
            found = faults(data, offsets)
            logits = (features(data, offsets) @ m["w"] + m["b"]).astype(np.float64)
            score = 1 / (1 + np.exp(-np.clip(m["slope"] * logits + m["offset"], -30, 30)))
            failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])
            yield {"doc_id": batch["doc_id"].slice(first, end - first), **found, "base_failed": failed, "kept": ~failed & (score >= keep_at), "score": score}

    return with_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
