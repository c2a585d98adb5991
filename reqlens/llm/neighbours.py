"""Exact nearest neighbours by a block matrix join.

Candidates are dealt evenly into ``C`` columns and queries into ``R`` rows of a
grid; a cell gets its candidates and its queries by a cogroup on (row, column)
and works in tiles. Both sides of a tile are quantised to int8 with a scale for
each vector; their product (exact in float32, as the sums stay below 2**24 for
up to 1,040 dimensions; float64 beyond) gives every squared distance up to
``2 * (|e_q| |c'| + |q'| |e_c| + |e_q| |e_c|)``, where q', c' are the quantised
vectors and e_q, e_c what quantising left out. Pairs whose lower bound exceeds the
query's k-th smallest upper bound, or the worst entry of its full heap, can't be
among the nearest; the others are recomputed in double precision on the original
vectors and enter the heap. The k best of each cell are merged by rank.

A cell holds at most about ``cell`` candidates and as many queries, whatever the
values are: vectors are dealt by row number, so equal or repeated ones don't
meet in one task more than others.

Defined results: vectors (and ids) that are null, empty, zero or hold a null or
non-finite component take no part. Only vectors of one length are compared. A
query id that comes several times is searched once, with its smallest vector;
each candidate row counts for itself. Fewer than k candidates give as many
rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1024


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) \
        & F.exists(v, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the quantised vector, norm of the rest)."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny  # a subnormal vector
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.sqrt((d * d).sum(axis=1))


def nearest_in_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest (distance, id) among the candidates."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]  # (-distance, -id)
    exact = np.float32 if q.shape[1] <= 1040 else np.float64
    for c0 in range(0, len(c), TILE):
        cv, ci = c[c0:c0 + TILE], c_ids[c0:c0 + TILE]
        c_code, c_scale, c_near, c_rest = quantise(cv)
        c_norm = (cv * cv).sum(axis=1)
        for q0 in range(0, len(q), TILE):
            qv, qi = q[q0:q0 + TILE], q_ids[q0:q0 + TILE]
            q_code, q_scale, q_near, q_rest = quantise(qv)
            q_norm = (qv * qv).sum(axis=1)
            product = (q_code.astype(exact) @ c_code.astype(exact).T).astype(np.float64)
            near = q_norm[:, None] + c_norm[None] - 2.0 * product * q_scale[:, None] * c_scale[None]
            slack = 2.0 * (q_rest[:, None] * c_near[None] + q_near[:, None] * c_rest[None] + q_rest[:, None] * c_rest[None])
            slack += 1e-9 * (q_norm[:, None] + c_norm[None])  # rounding of the sums above
            other = qi[:, None] != ci[None]
            upper = np.where(other, near + slack, np.inf)
            limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if len(ci) >= k else np.full(len(qi), np.inf)
            worst = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps[q0:q0 + TILE]])
            limit = np.minimum(limit, worst * worst * (1 + 1e-9))
            rows, cols = np.nonzero(other & (near - slack <= limit[:, None]))
            for p in range(0, len(rows), 1 << 15):
                i, j = rows[p:p + (1 << 15)], cols[p:p + (1 << 15)]
                d = _distance(qv[i], cv[j])
                for a, x, y in zip((q0 + i).tolist(), d.tolist(), ci[j].tolist()):
                    h = heaps[a]
                    if len(h) < k:
                        heapq.heappush(h, (-x, -y))
                    elif (-x, -y) > h[0]:
                        heapq.heapreplace(h, (-x, -y))
    return [[(-a, -b) for a, b in h] for h in heaps]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
            cell: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query by Euclidean
    distance, nearest first, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).alias("v"), is_query.alias("q")) \
        .where(F.col("id").isNotNull() & usable("v"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    columns = max(-(-n // cell), 2 * spark.sparkContext.defaultParallelism)
    grid_rows = max(1, -(-n_queries // cell))
    number = F.monotonically_increasing_id()
    candidates = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(number, F.lit(columns)).alias("c")) \
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid_rows - 1))))
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v")) \
        .select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(grid_rows)).cast("int").alias("r")) \
        .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))))

    def cell_best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            q_ids, c_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            q, c = _matrix(left.column("v")), _matrix(right.column("v"))
            for who, best in zip(q_ids.tolist(), nearest_in_cell(q_ids, q, c_ids, c, k)):
                out += [(who, y, x) for x, y in best]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()),
                         "score": pa.array([x[2] for x in out], pa.float64())})

    key = ["dim", "r", "c"]
    best = queries.groupBy(*key).cogroup(candidates.groupBy(*key)) \
        .applyInArrow(cell_best, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
