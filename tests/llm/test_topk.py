import math
import random

import pytest

from freshet.llm import topk
from freshet.llm.topk import top_k


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        w = next(v for i, v in ok if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(w, v)), i) for i, v in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


@pytest.mark.parametrize("big", [1.0, 1e4])
def test_matches_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "RUN", 16)
    monkeypatch.setattr(topk, "SHARDS_A_TASK", 2)
    r = random.Random(5)
    rows = [(i, [big * r.gauss(0, 1) for _ in range(8)]) for i in range(320)]
    rows += [(400 + i, list(rows[50][1])) for i in range(9)]  # ties
    rows += [(500, None), (501, [1.0, None] + [0.0] * 6), (550, [float("nan")] * 8), (600, [float("inf")] * 8), (650, []), (700, [1.0, -2.0]), (None, [1.0] * 8), (750, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", topk.F.lit(1)).withColumn("id", topk.F.lit("x")).repartition(5)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in top_k(spark, df).collect())
    assert got == brute(rows)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark, spark.createDataFrame([], schema)).collect() == []
    assert top_k(spark, spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    got = top_k(spark, spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 256 * 512)]


def test_terms_and_vectors_are_pruned():
    r = topk.np.random.default_rng(3)
    x = r.normal(size=(2000, 64))
    weights = topk.np.floor(256 * x / topk.np.linalg.norm(x, axis=1)[:, None]).astype(topk.np.int32)
    p, work = topk.Postings(topk.np.arange(2000), topk.np.ascontiguousarray(weights.T)), topk.Work()
    scores = weights.astype(int) @ weights.T.astype(int)
    for q in range(0, 2000, 50):
        got = topk.search(p, q, weights[q], [], 5, work)
        assert got == sorted(((int(s), i) for i, s in enumerate(scores[q]) if i != q), key=lambda x: (-x[0], x[1]))[:5]
    # of all pairs of a vector and a term, not all are looked at, though one shard holds all vectors
    assert work.looked < 0.9 * work.all and work.dropped > 0.5 * 40 * 2000


def test_runs_that_cannot_compete_are_left_out(monkeypatch):
    monkeypatch.setattr(topk, "RUN", 512)
    monkeypatch.setattr(topk, "SEED", 128)
    weights = topk.np.full((8, 4000), 1, topk.np.int32)
    weights[:, :200] = 100
    p, work = topk.Postings(topk.np.arange(4000), weights), topk.Work()
    got = topk.search(p, 0, weights[:, 0], [], 5, work)
    assert got == [(80_000, i) for i in range(1, 6)] and work.skipped == len(p.starts) - 2


def test_very_long_vectors(spark):
    r = topk.np.random.default_rng(1)
    rows = [(i, r.normal(size=6000).tolist()) for i in (0, 1, 2, 50)]
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == brute(rows)


def test_long_among_short_vectors(spark):
    """Shards are cut by bytes and by the length of their vectors: one endless vector does not pad the others."""
    r = topk.np.random.default_rng(7)
    rows = [(i, r.normal(size=9).tolist()) for i in range(120)] + [(200 + i, r.normal(size=300).tolist()) for i in range(60)] + [(1000, r.normal(size=400_000).tolist()), (1001, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in top_k(spark, df).collect())
    assert got == brute(rows)


def test_wide_vectors_make_small_shards(spark, tmp_path):
    wide = spark.range(1200).select(topk.F.col("id").alias("vec_id"), topk.F.array_repeat(topk.F.rand(3), 4096).alias("embedding")).coalesce(1)
    shards = [x.shard for x in topk.write_shards(wide, f"file://{tmp_path}", 256.0, 50, "vec_id", "embedding").collect()]
    sizes = [topk._read(f)[1].nbytes for f in shards]
    assert sum(sizes) == 1200 * 4096 * 4 and max(sizes) <= topk.SHARD_BYTES and len(shards) == 3
