"""Exact top-k inner-product search by MaxScore over sharded postings.

The dimensions of a vector are its terms and floor(scale * component) its weight.  A shard keeps one posting
list a dimension: the weights of its vectors in vector order (a dense list, so the list position is the vector),
with the largest and smallest weight of every run of :data:`RUN` vectors (the first run is short: it is scored in full, and
its k-th best is the threshold that the others start with).  For one query and one run each term has
a bound, the most it can add to a score.  Terms in ascending order of their bounds whose sum stays below the
threshold (the k-th best score so far) are *non-essential*: a vector that gains nothing from the others cannot
enter the result.  The essential lists are traversed in full; the non-essential ones are probed, highest bound
first, only for vectors whose partial score plus the bounds still to come reaches the threshold.  Thresholds carry
over from shard to shard of a group, and the k best of all groups are merged.

Scores are exact integers (float arithmetic is used only where every partial sum provably fits its mantissa).

Defined results: vectors that are null, or hold a null or a non-finite component, take no part.  Shorter vectors count
as padded with zeros; an empty vector scores 0 against all.  Rows with the query's own vec_id are its own rows and no
candidates; repeated query ids give one result (of one of their rows).  Rows with a null vec_id take no part.  Ties go
to the smaller vec_id, then by nothing further (equal ids and scores are equal rows).  Weights must fit in 31 bits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm import common

#: Vectors in one shard file at most, in one run with bounds of its own, and in the first run; bytes of a shard's weights (one vector may exceed them alone).
SHARD, RUN, SEED, SHARD_BYTES = 32_768, 8_192, 256, 8 << 20
#: Shard files, and query files, that one task pairs up.
SHARDS_A_TASK, QUERIES_A_TASK = 16, 16
PROBE = 8


def _write(uri: str, ids: np.ndarray, weights: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez(out, ids=ids, weights=weights)
    common.put(uri, out.getvalue())
    return uri


def _read(uri: str) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(common.get(uri))) as z:
        return z["ids"], z["weights"]


def _matrix(column: pa.ListArray, scale: float) -> np.ndarray:
    """Weights, one row a vector, zeros beyond a vector's end."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.floor(np.asarray(column.values.slice(offsets[0], offsets[-1] - offsets[0]), dtype=np.float64) * scale)
    sizes = np.diff(offsets)
    if len(values) and np.abs(values).max() >= 2**31:
        raise ValueError("weights must fit in 31 bits")
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int32)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values.astype(np.int32)
    return out


def write_shards(vectors: DataFrame, root: str, scale: float, every: int, id_col: str, vec_col: str) -> DataFrame:
    """Shard and query files of ``vectors`` below ``root``; one row a shard: shard, queries (file or null), n_queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}  # by the power of two that holds the vectors' length, so padding at most doubles a shard
        rows: dict[int, int] = {}

        def flush(wide: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held.pop(wide)).combine_chunks()
            rows.pop(wide)
            ids = np.asarray(table.column("id"), dtype=np.int64)
            weights = _matrix(table.column("vec").combine_chunks(), scale)
            order = np.argsort(ids, kind="stable")
            ids, weights = ids[order], weights[order]
            shard = _write(f"{root}/{common.unique_name('.shard')}", ids, np.ascontiguousarray(weights.T))
            asked = ids % every == 0
            asked[1:] &= ids[1:] != ids[:-1]
            queries = _write(f"{root}/{common.unique_name('.queries')}", ids[asked], weights[asked]) if asked.any() else None
            return pa.record_batch({"shard": [shard], "queries": pa.array([queries], pa.string())})

        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets, dtype=np.int64))
            classes = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
            for wide in np.unique(classes).tolist():
                most = max(1, min(SHARD, SHARD_BYTES // (4 << wide)))
                at = np.flatnonzero(classes == wide)
                while len(at):
                    part = at[: most - rows.get(wide, 0)]
                    at = at[len(part) :]
                    held.setdefault(wide, []).append(batch.take(pa.array(part)))
                    rows[wide] = rows.get(wide, 0) + len(part)
                    if rows[wide] >= most:
                        yield flush(wide)
        for wide in list(held):
            yield flush(wide)

    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
        .where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .mapInArrow(run, "shard string, queries string")
    )


class Postings:
    """One shard in memory: dimension-major weights with run bounds, in the narrowest exact type."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.starts = np.array([0, *range(min(SEED, RUN), self.n, RUN)])
        self.ends = np.append(self.starts[1:], self.n)
        self.most = np.maximum.reduceat(weights, self.starts, axis=1).astype(np.float64)
        self.least = np.minimum.reduceat(weights, self.starts, axis=1).astype(np.float64)
        self.peak = np.maximum(self.most.max(axis=1, initial=0), -self.least.min(axis=1, initial=0)).astype(np.int64)
        self.raw = weights
        self._as: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as = {kind: self.raw.astype(kind)}
        return self._as[kind]


@dataclass
class Work:
    """What searches have done: (vector, term) pairs looked at and all there were, vectors dropped before their last term, runs left out."""

    looked: int = 0
    all: int = 0
    dropped: int = 0
    skipped: int = 0


def search(p: Postings, query_id: int, q: np.ndarray, best: list[tuple[int, int]], k: int, work: Work | None = None) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of ``best`` and the shard, by MaxScore."""
    work = work or Work()
    dims = min(len(q), len(p.raw))
    q = q[:dims].astype(np.int64)
    total = int((np.abs(q) * p.peak[:dims]).sum())
    kind = np.float32 if total < 2**24 else np.float64 if total < 2**53 else np.int64
    lists, w = p.of(kind), q.astype(kind)
    qf = q.astype(np.float64)[:, None]
    bounds = np.maximum(qf * p.most[:dims], qf * p.least[:dims])
    reach = bounds.sum(axis=0) if dims else np.zeros(len(p.starts))
    work.all += dims * p.n
    # without a threshold the short run is the first; the others come by falling reach
    runs = np.argsort(-reach, kind="stable") if len(best) == k else np.concatenate([[0], 1 + np.argsort(-reach[1:], kind="stable")])
    for nr, r in enumerate(runs):
        theta = best[-1][0] if len(best) == k else None
        if theta is not None and reach[r] < theta:
            work.skipped += len(runs) - nr
            break  # no later one can compete
        lo, hi = int(p.starts[r]), int(p.ends[r])
        order = np.argsort(-bounds[:, r], kind="stable")
        rest = np.concatenate([np.cumsum(bounds[order, r][::-1])[::-1], [0.0]])
        # essential: the fewest strongest terms that leave the others short of the threshold
        m = dims if theta is None else int(np.argmax(rest < theta)) if (rest < theta).any() else dims
        score = np.zeros(hi - lo, dtype=kind)
        for d in order[:m]:
            score += w[d] * lists[d, lo:hi]
        alive = np.flatnonzero(score + rest[m] >= theta) if theta is not None else np.arange(hi - lo)
        score = score[alive]
        work.looked += m * (hi - lo)
        for i in range(m, dims, PROBE):
            terms = order[i : i + PROBE]
            work.looked += len(terms) * len(alive)
            for d in terms:
                score = score + w[d] * lists[d, lo + alive]
            competitive = score + rest[min(dims, i + PROBE)] >= theta
            if not competitive.all():
                alive, score = alive[competitive], score[competitive]
            if not len(alive):
                break
        work.dropped += hi - lo - len(alive)
        if not len(alive):
            continue
        ids = p.ids[lo + alive]
        other = ids != query_id
        ids, score = ids[other], score[other].astype(np.int64)
        if len(ids) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            near = score >= edge
            ids, score = ids[near], score[near]
        top = np.lexsort((ids, -score))[:k]
        best = sorted([*best, *zip(score[top].tolist(), ids[top].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
    return best


def top_k(
    spark: SparkSession,
    vectors: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    query_every: int = 50,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The k best partners of every row whose id is divisible by ``query_every``: query_id, rank, vec_id, score."""
    root = common.scratch(spark, "topk")
    manifest = common.stage(spark, write_shards(vectors, f"{root}/files", scale, query_every, id_col, vec_col), f"{root}/manifest")
    shards = max(1, manifest.count())
    groups = -(-shards // SHARDS_A_TASK)
    # thresholds carry over within a group of shards, so cores are filled by parting the queries first
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-shards // QUERIES_A_TASK), min(shards, -(-2 * cores // groups)))
    numbered = manifest.withColumn("nr", F.row_number().over(Window.orderBy("shard")) - 1)  # a short row a file
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = numbered.select((F.col("nr") % groups).alias("g"), every(blocks).alias("b"), F.col("shard").alias("file"), F.lit(True).alias("is_shard"))
    right = numbered.where("queries is not null").select(every(groups).alias("g"), (F.col("nr") % blocks).alias("b"), F.col("queries").alias("file"), F.lit(False).alias("is_shard"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        asked = [_read(f) for f, is_shard in sorted(files) if not is_shard]
        best: dict[tuple[int, int], list] = {}
        for f, is_shard in sorted(files):
            if is_shard and asked:
                p = Postings(*_read(f))
                for a, (ids, weights) in enumerate(asked):
                    for j, query in enumerate(ids.tolist()):
                        best[a, j] = search(p, query, weights[j], best.get((a, j), []), k)
        rows = [(int(asked[a][0][j]), vec, score) for (a, j), found in best.items() for score, vec in found]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    # one task a pair of groups: rows are told where to go, and adaptive execution, which goes by their bytes, leaves them there
    dealt = left.unionByName(right).repartitionById(groups * blocks, (F.col("g") * blocks + F.col("b")).cast("int"))
    found = dealt.select("file", "is_shard").mapInArrow(pair, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return top_k(spark, embeddings)


ORACLE_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
