"""Approximate nearest neighbours by multi-index hashing.

Vectors are rotated by a learned rotation (iterative quantisation on principal
components) and cut to 64-bit codes. A code is split into substrings, and every
substring has an index: the table of codes by ``(substring, value)``. By the
pigeonhole principle two codes within Hamming radius ``r = s * m + a`` agree to
within ``s`` bits in one of the first ``a + 1`` of ``m`` substrings or to within
``s - 1`` bits in one of the others, so a query probes the values that near of each
index, and a join on ``(substring, value)`` retrieves every code within the radius,
each once (at the first substring that finds it). What is found is ranked by the
exact Euclidean distance of the original vectors.

* *Fit.* Mean and rotation are fitted on at most ``SAMPLE_ROWS`` vectors (those with
  the least hash of their id); every vector is indexed. The radius is the least one
  that holds ``WITHIN`` of the true neighbours of at most ``SAMPLE_QUERIES`` queries,
  which are compared with all vectors, so it follows the density of the whole table.
  The number of substrings is the one with the least expected work.
* *Copies.* Equal vectors are one class. Only its ``k + 1`` smallest ids can be among
  the ``k`` nearest of anything, so a hot vector costs what a rare one does.
* *Hot values.* A value with more than ``BUCKET_ROWS`` codes is split by id; its probes
  go to every part.
* *Rerank.* Vectors are dealt to blocks once, and the queries with candidates in a
  block stream past it: memory holds one block and one Arrow batch.
* A query for which fewer than ``k`` are found is compared with every block.

Left out: null vectors, those with null, NaN or infinite components, those of
another length than most, and zero vectors. Null ids are left out. Ties go to
the smaller id. Rows of equal id and vector are one row; rows of one id with different
vectors are candidates and queries of their own, and none is a candidate of a query of
its id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.shared import stored, table

SAMPLE_ROWS = 4000
SAMPLE_QUERIES = 200
BITS = 64
#: Substrings that are tried; none is wider than 16 bits, so an index has at most 65,536 values.
SUBSTRINGS = range(4, 9)
#: The radius holds this share of the true neighbours of the sampled queries.
WITHIN = 0.97
BLOCK_ROWS = 8_192
BUCKET_ROWS = 20_000
#: Probes that a task makes at once.
PROBES_AT_ONCE = 400_000

_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class BinaryCodes:
    """Mean and rotation; codes are signed 64-bit numbers."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray):
        self.mean, self.rotation = mean, rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1).view(">i8").ravel().astype(np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of codes."""
    x = np.ascontiguousarray(a ^ b)
    return _POP[x.view(np.uint8).reshape(*x.shape, 8)].sum(axis=-1)


def fit_codes(x: np.ndarray, rounds: int = 20, seed: int = 3) -> BinaryCodes:
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    centred = x - mean
    d = x.shape[1]
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    base = axes.T[:, : min(BITS, d)]
    if base.shape[1] < BITS:  # fewer axes than bits: random directions make up the rest
        base = np.concatenate([base, rng.standard_normal((d, BITS - base.shape[1])) / np.sqrt(d)], axis=1)
    v = centred @ base
    rot, _ = np.linalg.qr(rng.standard_normal((BITS, BITS)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rot).T @ v, full_matrices=False)
        rot = (u @ w).T
    return BinaryCodes(mean, base @ rot)


class Substrings:
    """``m`` substrings of a code as ``(shift, width, limit)`` for a radius."""

    def __init__(self, radius: int, m: int):
        s, a = divmod(radius, m)
        width, more = divmod(BITS, m)
        widths = [width + (j < more) for j in range(m)]
        shifts = np.cumsum([0, *widths[:-1]]).tolist()
        self.radius = radius
        self.parts = [(shift, w, min(w, s if j <= a else s - 1)) for j, (shift, w) in enumerate(zip(shifts, widths, strict=True))]

    def probes(self) -> int:
        return sum(comb(w, i) for _, w, limit in self.parts for i in range(limit + 1))

    def work(self, n: int) -> float:
        """Rows that a query's probes make and meet; a probe is moved, a meeting is not."""
        return sum(sum(comb(w, i) for i in range(limit + 1)) * (5 + n / (1 << w)) for _, w, limit in self.parts)

    def flips(self, j: int) -> np.ndarray:
        _, w, limit = self.parts[j]
        return np.array([sum(1 << b for b in c) for i in range(limit + 1) for c in combinations(range(w), i)], dtype=np.int64)

    def value(self, code: Column, j: int) -> Column:
        shift, w, _ = self.parts[j]
        return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << w) - 1).cast("long"))

    def found_first(self, differing: Column, j: Column) -> Column:
        """True where no substring before ``j`` finds two codes that differ in these bits."""
        sooner = [(j > i) & (F.bit_count(self.value(differing, i)) <= limit) for i, (_, _, limit) in enumerate(self.parts)]
        return ~reduce(or_, sooner)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64, copy=False)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0.0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _coded(hashed: DataFrame, codes, d: int) -> DataFrame:
    """``id, h1, h2, code`` of rows of ``id, h1, h2, v``: narrow, no shuffle. The 128 bits of ``h1, h2`` name a vector."""

    def run(batches):
        for b in batches:
            code = codes.value.encode(_matrix(b.column(3), d)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(code, pa.int64())], ["id", "h1", "h2", "code"])

    return hashed.mapInArrow(run, "id long, h1 long, h2 long, code long")


def _least_ids(coded: DataFrame, most: int) -> DataFrame:
    """``coded`` with ``place``: of every class the rows of its ``most`` smallest ids; tasks keep no more before rows move."""
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    return coded.distinct().withColumn("place", place).where(F.col("place") <= most)


def _named(members: DataFrame) -> DataFrame:
    """``id, h1, h2, code, name`` of the classes: the smallest id, or a number of its own where that id has another vector, too."""
    other = F.row_number().over(Window.partitionBy("id").orderBy("h1", "h2"))
    first = members.where("place = 1").withColumn("other", other)
    return first.select("id", "h1", "h2", "code", F.when(F.col("other") == 1, F.col("id")).otherwise(F.xxhash64("id", "h1", "h2")).alias("name"))


def _radius(vectors: DataFrame, asked: list, codes, k: int, d: int) -> int:
    """The radius that holds ``WITHIN`` of the true neighbours of the ``asked`` rows (a bounded sample) among all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in asked]), np.array([r["v"] for r in asked], dtype=np.float64)))

    def run(batches):
        ids, q = shared.value
        q_codes, q_square = codes.value.encode(q), (q**2).sum(axis=1)
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _matrix(b.column(1), d), b.column(0).to_numpy()
            score = q_square[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q @ x.T
            score[ids[:, None] == own[None, :]] = np.inf
            at = np.argpartition(score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
            far = apart(q_codes[:, None], codes.value.encode(x)[at])
            new = (np.repeat(np.arange(len(q)), at.shape[1]), np.take_along_axis(score, at, 1).ravel(), far.ravel().astype(np.int64))
            n, s, f = (np.concatenate([x, y]) for x, y in zip(best, new, strict=True))
            order = np.lexsort((s, n))
            n, s, f = n[order], s[order], f[order]
            place = np.arange(len(n)) - np.searchsorted(n, n)
            keep = (place < k) & np.isfinite(s)
            best = (n[keep], s[keep], f[keep])
        yield pa.RecordBatch.from_arrays([pa.array(best[0], pa.int64()), pa.array(best[1], pa.float64()), pa.array(best[2], pa.int64())], ["q", "score", "far"])

    each = vectors.select("id", "v").mapInArrow(run, "q long, score double, far long")
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "far"))
    far = [r["far"] for r in each.withColumn("place", place).where(F.col("place") <= k).select("far").collect()]  # at most k for each of SAMPLE_QUERIES
    return int(np.quantile(far, WITHIN, method="higher")) if far else BITS


def _candidates(index: DataFrame, asked: DataFrame, sub: Substrings) -> DataFrame:
    """``q, c``: ids of queries and of the codes within the radius (both ``id, code``), each pair once."""
    m = len(sub.parts)
    entries = index.select("id", "code", F.posexplode(F.array(*[sub.value(F.col("code"), j) for j in range(m)])).alias("j", "value"))
    # At most 2**16 values for each of 8 substrings; only those that are split are sent.
    hot = entries.groupBy("j", "value").count().where(F.col("count") > BUCKET_ROWS).select("j", "value", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("parts"))
    hot = F.broadcast(stored(hot, "hot"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = entries.join(hot, ["j", "value"], "left").select("j", "value", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.col("id").alias("c"), F.col("code").alias("c_code"))

    def probe(batches):
        flips = [sub.flips(j) for j in range(m)]
        total = sum(map(len, flips))
        step = max(1, PROBES_AT_ONCE // total)
        for b in batches:
            ids, codes = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo in range(0, len(ids), step):
                i, c = ids[lo : lo + step], codes[lo : lo + step]
                values = np.concatenate([((c[:, None] >> np.int64(shift)) & np.int64((1 << w) - 1)) ^ flips[j][None, :] for j, (shift, w, _) in enumerate(sub.parts)], axis=1)
                number = np.tile(np.repeat(np.arange(m, dtype=np.int32), [len(f) for f in flips]), len(i))
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(values.ravel()), pa.array(np.repeat(i, total)), pa.array(np.repeat(c, total))], ["j", "value", "q", "q_code"])

    probes = asked.select("id", "code").mapInArrow(probe, "j int, value long, q long, q_code long")
    sent = probes.join(hot, ["j", "value"], "left").select("j", "value", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "q", "q_code")
    met = dealt.join(sent.hint("merge"), ["j", "value", "part"])  # many small rows, so no side is sent whole
    differing = F.col("c_code").bitwiseXOR(F.col("q_code"))
    return met.where((F.bit_count(differing) <= sub.radius) & sub.found_first(differing, F.col("j"))).select("q", "c")


_NEAR = "q long, c long, score double"


def _reranked(vectors: DataFrame, wanted: DataFrame, queries: DataFrame, blocks: int, k: int, d: int) -> DataFrame:
    """``q, c, score``: of every query and block the ``k`` nearest wanted rows by exact distance, and those that tie with the last.

    ``vectors`` are ``id, v``; ``queries`` are ``q, v``; ``wanted`` is ``q, block, ids``, where null ``ids`` are the whole block.
    """
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("array<long>")
    held = vectors.select(block.alias("block"), F.lit(0).alias("kind"), "id", "v", none.alias("ids"))
    asking = wanted.join(queries, "q").select("block", F.lit(1).alias("kind"), F.col("q").alias("id"), "v", "ids")

    def run(batches):
        current, own, x, order = None, None, None, None
        ids, rows = [], []
        for batch in batches:
            at_block, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = [[], [], []]
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(at_block) != 0) | (np.diff(kinds) != 0)) + 1, [len(kinds)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if at_block[lo] != current:
                    current, own, ids, rows = at_block[lo], None, [], []
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    ids.append(part.column(2).to_numpy())
                    rows.append(_matrix(part.column(3), d))
                    own = None
                    continue
                if own is None and ids:
                    own, x = np.concatenate(ids), np.concatenate(rows)
                    order = np.argsort(own)
                if own is None:
                    continue
                q, names = _matrix(part.column(3), d), part.column(2).to_numpy()
                lists = part.column(4)
                for i in range(len(names)):
                    chosen = lists[i].values
                    at = np.arange(len(own)) if chosen is None else order[np.searchsorted(own, chosen.to_numpy(), sorter=order)]
                    score = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                    keep = score <= np.partition(score, k - 1)[k - 1] if len(at) > k else np.ones(len(at), dtype=bool)
                    out[0].append(np.full(int(keep.sum()), names[i]))
                    out[1].append(own[at[keep]])
                    out[2].append(score[keep])
            flat = [np.concatenate(o) if o else np.zeros(0) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64))], ["q", "c", "score"])

    tasks = min(blocks, 20_000)
    return held.unionByName(asking).repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, _NEAR)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: ``vectors`` and ``queries`` have ``id long, v array<double>``."""
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    if not lengths:
        return empty
    d = lengths[0]["d"]
    vectors, queries = vectors.where(F.size("v") == d), queries.where(F.size("v") == d)
    first = F.xxhash64("id"), "id"
    sample = vectors.orderBy(*first).limit(SAMPLE_ROWS).select("v").collect()
    asked = queries.orderBy(*first).limit(SAMPLE_QUERIES).collect()
    if not asked:
        return empty
    codes = spark.sparkContext.broadcast(fit_codes(np.array([r["v"] for r in sample], dtype=np.float64)))

    # Classes of equal vectors; of each the k + 1 smallest ids.
    hashed = lambda rows: rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"), "v")
    members = stored(_least_ids(_coded(hashed(vectors), codes, d), k + 1), "members")
    index = stored(_named(members), "index")
    n = index.count()
    asking = stored(_coded(hashed(queries), codes, d).distinct(), "asking")
    classes = stored(_named(_least_ids(asking, 1)), "classes")
    asking = asking.join(classes.select("h1", "h2", F.col("name").alias("q")), ["h1", "h2"]).select("id", "q")

    radius = _radius(vectors, asked, codes, k, d)
    sub = min((Substrings(radius, m) for m in SUBSTRINGS), key=lambda s: s.work(n))
    blocks = max(1, -(-n // BLOCK_ROWS), min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 256))
    block = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    codes_of = lambda rows: rows.select(F.col("name").alias("id"), "code")
    found = _candidates(codes_of(index), codes_of(classes), sub).groupBy("q", block.alias("block")).agg(F.collect_list("c").alias("ids"))  # at most a block's rows

    vectors_of = lambda rows, classes, name: hashed(rows).join(classes.select("id", "h1", "h2", F.col("name").alias("c")), ["id", "h1", "h2"]).select(F.col("c").alias(name), "v").dropDuplicates([name])
    of_index, of_queries = stored(vectors_of(vectors, index, "id"), "vectors"), stored(vectors_of(queries, classes, "q"), "queries")
    near = stored(_reranked(of_index, found, of_queries, blocks, k + 1, d), "near")
    same = members.join(index.select("h1", "h2", F.col("name").alias("c")), ["h1", "h2"]).select("c", F.col("id").alias("vec_id"))

    def ranked(near: DataFrame) -> DataFrame:
        by = Window.partitionBy("q").orderBy("score", "vec_id")
        rows = near.join(same, "c").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1)
        own = asking.select(F.col("id").alias("query_id"), "q").join(rows, "q").where("query_id != vec_id")
        rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
        return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "q")

    results = stored(ranked(near), "ranked")
    # Queries with too few rows within the radius meet all blocks.
    told = results.groupBy("query_id", "q").count()
    few = asking.select(F.col("id").alias("query_id"), "q").join(told, ["query_id", "q"], "left").where(F.coalesce("count", F.lit(0)) < k).select("q").distinct()
    few = stored(few, "few")
    if few.isEmpty():
        return results.drop("q")
    everywhere = few.select("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("array<long>").alias("ids"))
    again = ranked(_reranked(of_index, everywhere, of_queries, blocks, k + 1, d))
    return results.join(few, "q", "left_anti").unionByName(again).drop("q")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return nearest(vectors, vectors.where(F.col("id") % 100 == 0), 10)
