"""Vectors as codes: each part of a vector becomes the number of its codebook's nearest entry.

Distances are squared and Euclidean over whole numbers. Most entries are never
compared: of every part and entry the mean and the norm of what is left beside
the mean are known, for blocks from the whole part down to pairs of components.
For a block of n components with means m, m' and rests r, r'

    |x - y|^2 = n (m - m')^2 + |r - r'|^2 >= n (m - m')^2 + (|r| - |r'|)^2,

so the sum over blocks is a lower bound, and finer blocks give a higher one. An
entry whose bound, less the error of floating point, is above the exact distance
of the entry that looks nearest can't be nearest. What survives all levels is
compared in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare
from .vectors import whole_vectors

#: Labels up to which their sums, at some 16 bytes each, are broadcast; more are joined by a shuffle over so many salts.
BROADCAST_ROWS, SALTS = 100_000, 64
#: Part of the squared size of the numbers by which bounds may err; doubles err by far less.
_ERROR = 1e-9


def block_sizes(size: int) -> list[int]:
    """Components of a block at each level, coarse to fine; the last level has pairs."""
    out = [size]
    while out[-1] > 3:
        out.append(-(-out[-1] // 2))
    return out


def block_summary(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each block of each row, times the root of its length, and the norm of what is left."""
    starts = np.arange(0, x.shape[1], block)
    lengths = np.diff([*starts, x.shape[1]])
    means = np.add.reduceat(x, starts, axis=1) / lengths
    rest = x - np.repeat(means, lengths, axis=1)
    return means * np.sqrt(lengths), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the first of the nearest entries and its squared distance, and how many distances were made."""
    n, size = x.shape
    peak = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    slack = _ERROR * (1 + peak * peak) * size
    rows = of = guess = bound = None
    for block in block_sizes(size):
        means, norms = block_summary(x.astype(np.float64), block)
        entry_means, entry_norms = block_summary(entries.astype(np.float64), block)
        if rows is None:  # every entry; the rest of the levels take what is left
            low = sum((means[:, [b]] - entry_means[:, b]) ** 2 + (norms[:, [b]] - entry_norms[:, b]) ** 2 for b in range(means.shape[1]))
            guess = low.argmin(axis=1)
            bound = ((x - entries[guess]) ** 2).sum(axis=1)
            rows, of = np.nonzero(low <= bound[:, None] + slack)
        else:
            low = ((means[rows] - entry_means[of]) ** 2 + (norms[rows] - entry_norms[of]) ** 2).sum(axis=1)
            left = low <= bound[rows] + slack
            rows, of = rows[left], of[left]
    exact = ((x[rows] - entries[of]) ** 2).sum(axis=1)
    first = np.searchsorted(rows, np.arange(n))  # rows ascend, and so do the entries of a row
    least = np.minimum.reduceat(exact, first) if n else exact
    code = np.minimum.reduceat(np.where(exact == least[rows], of, len(entries)), first) if n else of
    return code, least, len(rows) + n


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of `width` numbers, short ones ending in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(lengths) * width:
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _replaced(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry that parts chose as the floor of their mean.

    Tasks hold a count and sums for each entry, and Spark adds these up; the
    driver gets one row for each number of the codebooks.
    """
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            x = _matrix(batch["v"], parts * size)
            for p in range(parts):
                part = x[:, p * size : (p + 1) * size]
                np.add.at(sums[p], nearest(part, books[p])[0], np.column_stack([part, np.ones(len(part), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], ["at", "sum"])

    sums = np.zeros(parts * entries * (size + 1), np.int64)
    for at, total in rows.select("v").mapInArrow(run, "at int, sum long").groupBy("at").agg(F.sum("sum")).collect():
        sums[at] = total
    sums = sums.reshape(parts, entries, size + 1)
    counts = sums[:, :, -1:]
    return np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), books)


def fit_codebooks(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, components) of whole vectors: the parts of the first rows by vec_id, then `rounds` rounds over all rows.

    Nulls come after all ids, equal ids go by their vectors. Tables with fewer rows have fewer entries.
    """
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    size = max(1, -(-width // parts))
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    seeds = np.array([r.v + [0] * (parts * size - len(r.v)) for r in first], np.int64).reshape(len(first), parts, size)
    books = seeds.transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = _replaced(rows, books)
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (a byte for each part) and error (squared distances summed over parts) of whole vectors."""
    parts, entries, size = books.shape
    if entries > 256:
        raise ValueError("a code has one byte for each part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"], parts * size)
            found = [nearest(x[:, p * size : (p + 1) * size], books[p]) for p in range(parts)]
            codes = np.column_stack([code for code, _, _ in found]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(d for _, d, _ in found))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label long, code binary, error long")


def compress(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of all embeddings with a whole vector, and the codebooks.

    Components are counted in 256ths, rounded down. A vector is cut into
    `parts` equal parts; short vectors, and all where the length isn't a
    multiple, end in zeros. Ties go to the lower entry. label_error sums error
    over equal labels, nulls together. Null and repeated vec_ids are rows like
    any other; repeated rows are coded alike. Rows whose vector is null or
    holds a null, NaN or infinite component are left out, and components beyond
    65,536 count as that. Other columns are ignored; an empty table gives an
    empty result and codebooks without entries. There are no texts, so no long ones.
    """
    prepare(embeddings.sparkSession)
    rows = cut(whole_vectors(embeddings))
    books = fit_codebooks(rows, parts, entries, rounds)
    if not books.shape[1]:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).limit(0), books
    coded = cut(encode(rows, books))
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= BROADCAST_ROWS:
        joined = coded.join(F.broadcast(sums), same)
    else:  # a label may hold a third of all rows
        salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        copies = sums.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, same & (F.col("_salt") == F.col("_at")))
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
