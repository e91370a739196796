"""Nearest neighbours against brute force: split values, many blocks, copies, repeated rows and outliers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import neighbours as nn


def exact(rows, query, own, k=10):
    """``(score, id)`` of the nearest distinct rows that do not have the query's id."""
    found = sorted({(float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum())), i) for i, v in rows if i != query})
    return found[:k]


def by_query(result):
    out = {}
    for r in result.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(found) for q, found in out.items()}


@pytest.mark.parametrize("blocks, bucket", [(8192, 20_000), (300, 40), (130, 7)])
def test_recall_over_blocks(spark, monkeypatch, blocks, bucket):
    monkeypatch.setattr(nn, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(nn, "BUCKET_ROWS", bucket)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = np.stack([centres[rng.integers(12)] + 0.4 * rng.normal(size=24) for _ in range(900)])
    x[100:400] = x[100]  # a third are copies of one vector
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows + rows[:20] + [(900, None), (910, [0.0] * 24), (920, [float("nan")] * 24), (930, [1.0] * 3), (940, [None] + [1.0] * 23), (None, [1.0] * 24)], "vec_id long, embedding array<double>")
    table = table.withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("q", F.lit(1))
    vectors = nn.usable(table)
    got = by_query(nn.nearest(vectors, vectors.where("id % 10 = 0")))
    assert sorted(got) == list(range(0, 900, 10))
    hits = 0
    for q, found in got.items():
        best = exact(rows, q, x[q])
        assert [k for k, *_ in found] == list(range(1, 11)) and len({v for _, v, _ in found}) == 10
        assert all(np.isclose(s, np.sqrt(((x[v] - x[q]) ** 2).sum()), rtol=1e-12, atol=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for _, v in best})
        if 100 <= q < 400:
            assert [v for _, v, _ in found] == [v for v in range(100, 112) if v != q][:10]
    assert hits >= 0.9 * 10 * len(got)


def test_few_and_far(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)] + [(100, (50 + rng.normal(size=16)).tolist())]
    vectors = nn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = by_query(nn.nearest(vectors, vectors.where("id = 100")))  # an outlier still gets its ten
    assert [(v, round(s, 9)) for _, v, s in got[100]] == [(v, round(s, 9)) for s, v in exact(rows, 100, rows[-1][1])]
    few = vectors.where("id < 4")
    assert [len(v) for v in by_query(nn.nearest(few, few.where("id = 0"))).values()] == [3]
    assert nn.nearest(vectors.limit(0), vectors.limit(0)).count() == 0 and nn.nearest(vectors, vectors.limit(0)).count() == 0
    alone = vectors.where("id = 5")
    assert nn.nearest(alone, alone).count() == 0


def test_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [5.0, 5.0])]
    vectors = nn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nn.nearest(vectors, vectors.where("id in (0, 1)"), 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2)]


def test_every_code_within_the_radius_is_found_once(spark):
    rng = np.random.default_rng(7)
    codes = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    for i in range(1, 300, 3):
        codes[i] = codes[i - 1] ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 63, 12))
    rows = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "id long, code long")
    far = nn.apart(codes[:, None], codes[None, :])
    for radius, m in ((11, 8), (12, 5), (3, 4), (24, 8)):
        got = sorted(tuple(r) for r in nn._candidates(rows, rows, nn.Substrings(radius, m)).collect())
        assert got == [(int(a), int(b)) for a, b in zip(*np.nonzero(far <= radius), strict=True)]
