"""Length buckets that minimise padding, and token-budget batches inside them.

The histogram of lengths is global and exact; it has a row for each length that
occurs, so at most as many as the longest text has tokens. Dynamic programming
over it finds the bucket boundaries with the least padding of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, ranks


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets over an ascending histogram, with the least total padding.

    With one bucket more, the cost up to length i is the least over j < i of
    cost(j) + length(i) * (texts after j up to i). For each j that is a line in
    length(i), and slopes fall with j, so the lower hull of the lines gives all
    minima of a round in one pass. Whole numbers keep it exact.
    """
    n = len(lengths)
    if not n:
        return []
    many = [0]
    for c in counts:
        many.append(many[-1] + c)
    best, cuts = [x * many[i + 1] for i, x in enumerate(lengths)], []
    for _ in range(min(buckets, n) - 1):
        new, cut_at, hull, first = list(best), [-1] * n, [], 0
        for i in range(1, n):
            b, m = best[i - 1], -many[i]
            while len(hull) - first >= 2 and (b - hull[-2][0]) * (hull[-2][1] - hull[-1][1]) <= (hull[-1][0] - hull[-2][0]) * (hull[-2][1] - m):
                hull.pop()
            hull.append((b, m, i - 1))
            x = lengths[i]
            while len(hull) - first >= 2 and hull[first][0] + hull[first][1] * x >= hull[first + 1][0] + hull[first + 1][1] * x:
                first += 1
            cost = hull[first][0] + hull[first][1] * x + x * many[i + 1]
            if cost < new[i]:
                new[i], cut_at[i] = cost, hull[first][2]
        best = new
        cuts.append(cut_at)
    out, i = [lengths[-1]], n - 1
    for cut_at in reversed(cuts):
        if cut_at[i] >= 0:
            i = cut_at[i]
            out.append(lengths[i])
    return out[::-1]


def pack(counted: DataFrame, buckets: int = 16, budget: int = 16_384) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, place, padding for each row of counted (doc_id, n_tokens).

    Buckets are numbered from 0 by length. A batch holds texts of one bucket,
    padded to bucket_len, of at most `budget` tokens together, or one text
    longer than that; every batch of a bucket but its last is full. Null
    lengths count as 0. Texts of one bucket go by doc_id, then length; rows that
    tie in both are alike, so their order can't matter. Rows that repeat are batched like others, a null doc_id
    too; very long texts are lengths like others. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = counted.sparkSession
    prepare(spark)
    rows = counted.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows)  # lengths are dear and small: counted once, then read for the histogram, the ranks and the result
    histogram = sorted((r.n_tokens, r["n"]) for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())  # a row for each length that occurs
    bounds = boundaries([x for x, _ in histogram], [n for _, n in histogram], buckets) or [0]
    lengths = F.array(*[F.lit(x).cast("long") for x in bounds])
    placed = rows.withColumn("bucket", F.size(F.filter(lengths, lambda x: x < F.col("n_tokens")))).withColumn("bucket_len", F.get(lengths, F.col("bucket")))
    ranked = ranks(placed, "bucket", ["doc_id", "n_tokens", "row"])  # rows that repeat are told apart, so that many of them fill several ranges
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long")
    return ranked.select("doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_len", F.floor(F.col("rank") / capacity).cast("long").alias("batch"), F.pmod(F.col("rank"), capacity).cast("int").alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
