"""Packing into optimal length buckets.

The global histogram of lengths has one row for each distinct length. Distinct lengths
add up to at most the tokens of the corpus, so there are at most the square root of
twice that number (110,000 in 6 billion tokens), and the histogram goes to the driver
whole. Dynamic programming over it chooses
the bucket boundaries that minimise padding: a bucket of ``n`` sequences padded
to its longest costs ``n * longest - sum of lengths``. Inside a bucket the rows,
ordered by length and id, form batches of as many sequences as fit the token
budget when padded to the bucket's boundary.

Rows are numbered without a global window: one range partitioning by bucket,
length and id, row numbers inside each partition, and offsets by one row a
partition and bucket.

Nulls: a null text has length 0. A text longer than the budget forms batches of
one. Repeated rows keep their rows; null ids come first. Without rows the result
is empty. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.shared import documents, stored, text_or_empty

BUCKETS = 8
TOKEN_BUDGET = 32_768


def n_words(text: Column) -> Column:
    """Words of a text, the length that is packed by default; token counts go in as ``length``."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def choose_boundaries(count: np.ndarray, total: np.ndarray, longest: np.ndarray, k: int) -> list[int]:
    """Last length (by place) of each of at most ``k`` buckets, with the least padding.

    The cost meets the quadrangle inequality, so each layer is filled by divide
    and conquer: O(k * lengths * log lengths).
    """
    n = len(count)
    k = min(k, n)
    if not n:
        return []
    cn, ct = np.concatenate([[0], np.cumsum(count)]).astype(np.float64), np.concatenate([[0], np.cumsum(total)]).astype(np.float64)
    cost = lambda lo, hi: (cn[hi + 1] - cn[lo]) * longest[hi] - (ct[hi + 1] - ct[lo])  # noqa: E731  lengths lo..hi
    best = np.array([cost(0, j) for j in range(n)])
    came = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, k):
        new, cut = best.copy(), np.zeros(n, dtype=np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            starts = np.arange(max(a, 0), min(b, mid) + 1)
            before = np.where(starts > 0, best[starts - 1], 0.0)
            value = before + cost(starts, mid)
            at = int(np.argmin(value))
            new[mid], cut[mid] = value[at], starts[at]
            todo += [(lo, mid - 1, a, int(starts[at])), (mid + 1, hi, int(starts[at]), b)]
        came.append(cut)
        best = new
    ends, j = [], n - 1
    for layer in reversed(came):
        ends.append(j)
        j = int(layer[j]) - 1
        if j < 0:
            break
    return sorted(set(ends))


def packed(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, bucket, padded_to, batch_id, place``: one row for each input row.

    ``batch_id`` is ``bucket * 2**40 + number in the bucket``; ``place`` counts from 0.
    """
    sized = stored(docs.select(F.col(key).alias("id"), F.coalesce(length if length is not None else n_words(text_or_empty()), F.lit(0)).cast("long").alias("n")), "lengths")
    histogram = sized.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()
    n, c = (np.array([r[i] for r in histogram], dtype=np.int64) for i in (0, 1))
    ends = choose_boundaries(c, n * c, n, buckets)
    bucket, padded = F.lit(len(ends)), F.lit(0).cast("long")
    for i, e in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("n") <= int(n[e]), i).otherwise(bucket)
        padded = F.when(F.col("n") <= int(n[e]), F.lit(int(n[e])).cast("long")).otherwise(padded)
    placed = sized.select("id", "n", bucket.alias("bucket"), padded.alias("padded"))
    ranged = stored(placed.repartitionByRange("bucket", "n", "id").sortWithinPartitions("bucket", "n", "id").withColumn("row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("row", 33)
    # One row for each partition and bucket in it: at most partitions + buckets.
    held = ranged.groupBy(part.alias("part"), "bucket").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("part", "bucket", (before - F.col("first")).alias("shift"))
    rows_each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1))).cast("long"))
    numbered = ranged.withColumn("part", part).join(F.broadcast(offsets), ["part", "bucket"]).withColumn("number", F.col("row") + F.col("shift"))
    return numbered.select(
        F.col("id").alias(key), F.col("n").alias("n_tokens"), "bucket", F.col("padded").alias("padded_to"),
        (F.col("bucket").cast("long") * (1 << 40) + F.floor(F.col("number") / rows_each)).alias("batch_id"), (F.col("number") % rows_each).alias("place"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
