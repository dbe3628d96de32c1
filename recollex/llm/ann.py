"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors recomputed, heaps merged.

Queries and candidates are dealt into blocks by hash, and every pair of blocks meets in one run of a sorted stream. In
a run each vector is quantised to int8 codes with a scale of its own. The product of two code matrices is a tile of
whole numbers (taken in floating point, where they are exact) and gives every inner product up to a bound that follows
from the vectors' quantisation errors: |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|. Pairs whose upper bound reaches
the k-th greatest lower bound survive, are recomputed in double precision on the original components, one component
after another, and go through a heap for each query; the heaps of its runs are merged at last. Nothing is approximated:
the result is that of brute force.

Defined results: vectors that are null, zero, empty, or hold null, NaN or infinite components take no part, neither do
null ids. Vectors meet only those of their own dimension. Rows that share a vec_id are vectors of their own, but no
query finds a row of its own id, and where several rows ask under one id, the nearest of all of them are given. Ties go to the smaller vec_id. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollex.llm import kernels
from recollex.llm.common import table

NEAREST, QUERY_MODULUS = 20, 20
QUERY_BLOCK, BLOCK, TILE = 2048, 4096, 256


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, norm of the original, norm of what the codes stand for, norm of the difference) of each row."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = np.finfo(float).tiny  # components too small to divide: all codes 0, the error is the vector
    codes = np.rint(x / scale[:, None])
    stands = codes * scale[:, None]
    norm = lambda v: np.sqrt((v * v).sum(1))
    return codes.astype(np.int8), scale, norm(x), norm(stands), norm(x - stands)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows, component by component, so that any order of rows gives the same bits."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * c[:, j]
    return total


def tile_survivors(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], same: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) of pairs that may be among the k nearest; floor: known lower bounds of the k-th."""
    kind = np.float32 if q[0].shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    about = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64) * q[1][:, None] * c[1]
    bound = q[4][:, None] * c[2] + q[3][:, None] * c[4]
    bound += 1e-12 * (1 + q[2][:, None] * c[2])  # rounding of the sums
    lower = about - bound
    lower[same] = -np.inf
    if lower.shape[1] >= k:
        floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
    return np.nonzero((about + bound >= floor[:, None]) & ~same)


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest of the candidates, as (-score, id)."""
    codes = quantised(c)
    for at in range(0, len(q), TILE):
        own, ids = q[at : at + TILE], q_ids[at : at + TILE]
        of = quantised(own)
        heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)
        for start in range(0, len(c), TILE * 8):
            to = start + TILE * 8
            rows, columns = tile_survivors(of, tuple(x[start:to] for x in codes), ids[:, None] == c_ids[start:to], floor, k)
            for i in range(0, len(rows), 1 << 16):
                r, s = rows[i : i + (1 << 16)], columns[i : i + (1 << 16)] + start
                scores = _products(own[r], c[s])
                cuts = np.flatnonzero(np.diff(r)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(r)], strict=True):
                    if a < b:
                        heap = heaps[r[a]]
                        heaps[r[a]] = heapq.nsmallest(k, [*heap, *zip((-scores[a:b]).tolist(), c_ids[s[a:b]].tolist(), strict=True)])
            for i, heap in enumerate(heaps):
                if len(heap) == k:
                    floor[i] = -heap[-1][0]
        yield from zip(ids.tolist(), heaps, strict=True)


def _runs_nearest(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in kernels.sorted_runs(batches, 3):
        ids = run.column("vec_id").to_numpy()
        vectors = run.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        asks = run.column("asks").to_numpy()
        if not asks.any() or asks.all():
            continue
        found = list(nearest(ids[asks], vectors[asks], ids[~asks], vectors[~asks], k))
        query = np.repeat([x for x, _ in found], [len(h) for _, h in found])
        best = [p for _, h in found for p in h]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, asks: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of all rows to each row for which asks holds."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), asks.alias("asks")).where(F.col("vec_id").isNotNull())
    rows = rows.where(usable(F.col("vector")))
    n, queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    query_blocks, blocks = max(1, -(-queries // QUERY_BLOCK)), max(1, -(-n // BLOCK))
    rows = rows.withColumn("hash", F.xxhash64("vec_id"))
    q = rows.where("asks").withColumn("i", F.pmod("hash", F.lit(query_blocks))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    c = rows.withColumn("j", F.pmod("hash", F.lit(blocks))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))).withColumn("asks", F.lit(False))
    columns = [F.size("vector").cast("long").alias("d"), F.col("i").cast("long"), F.col("j").cast("long"), "asks", "vec_id", "vector"]
    both = q.select(columns).unionByName(c.select(columns)).repartition("d", "i", "j").sortWithinPartitions("d", "i", "j", "asks", "vec_id")
    near = both.mapInArrow(lambda it: _runs_nearest(k, it), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_MODULUS == 0)


#: Brute force. The components are added one after another in double precision.
SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_MODULUS} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {NEAREST}
"""
