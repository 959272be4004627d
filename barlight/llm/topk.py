"""Exact top-k by inner product: sorted lists read in order, without random access."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Share of each list that has been read when the bounds are looked at.
DEPTHS = (0.4, 0.55, 0.7, 0.85)
# Rows of the lists that one round reads; the k-th best score so far carries over to the next.
LIST_ROWS = 1_024
# Reading stops once so small a share of the rows can still qualify; their scores are then resolved.
FEW = 0.05


class SortedLists:
    """For each component, the rows in order of its value: read from the top for a positive weight, from the bottom for a negative one."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, d = x.shape
        order = np.argsort(-x, axis=0, kind="stable")
        self.rank = np.empty_like(order)
        self.rank[order, np.arange(d)] = np.arange(n)[:, None]
        self.values = np.take_along_axis(x, order, 0)

    def bounds(self, up: np.ndarray, down: np.ndarray, read: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each row for each query after ``read`` entries of every list.

        A value not yet seen is at most the last one read and at least the list's end.
        ``up`` and ``down`` are the positive and negative parts of the queries.
        """
        n = len(self.x)
        top, low = self.rank < read, self.rank >= n - read
        first, last, at_top, at_low = self.values[0], self.values[-1], self.values[read - 1], self.values[n - read]
        least = (up @ last + down @ first)[:, None] + up @ (top * (self.x - last)).T + down @ (low * (self.x - first)).T
        most = (up @ at_top + down @ at_low)[:, None] + up @ (top * (self.x - at_top)).T + down @ (low * (self.x - at_low)).T
        return least, most


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query position, row id, score)``: the k best rows of each query, ties to the smaller id, a query's own id left out."""
    width = max(queries.shape[1], rows.shape[1])
    reach = float(max(np.abs(queries).max(initial=0), 1)) * float(max(np.abs(rows).max(initial=0), 1)) * width * 4
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64  # sums of whole numbers stay exact
    q = np.zeros((len(queries), width), kind)
    q[:, :queries.shape[1]] = queries
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    floor = np.full(len(q), -np.inf)
    for a in range(0, len(rows), LIST_ROWS):
        ids = row_ids[a:a + LIST_ROWS]
        x = np.zeros((len(ids), width), kind)
        x[:, :rows.shape[1]] = rows[a:a + LIST_ROWS]
        lists, own = SortedLists(x), query_ids[:, None] == ids[None, :]
        open_ = ~own
        score = None
        for depth in DEPTHS:
            least, most = lists.bounds(up, down, max(1, int(depth * len(ids))))
            if len(ids) > k:
                least = np.where(own, -np.inf, least)
                floor = np.maximum(floor, -np.partition(-least, k - 1, axis=1)[:, k - 1])
            open_ = ~own & (most >= floor[:, None])  # the others cannot qualify
            if open_.mean() <= FEW:
                break
        if open_.mean() > FEW:  # the lists are read to their ends
            score = q @ x.T
        for i in np.flatnonzero(open_.any(axis=1)).tolist():
            at = np.flatnonzero(open_[i])
            s = (score[i, at] if score is not None else x[at] @ q[i]).astype(np.int64)
            s, r = np.concatenate([held[i][0], s]), np.concatenate([held[i][1], ids[at]])
            keep = np.lexsort((r, -s))[:k]
            held[i] = s[keep], r[keep]
            if len(keep) == k:
                floor[i] = max(floor[i], float(s[keep[-1]]))
    n = [len(s) for s, _ in held]
    return np.repeat(np.arange(len(q)), n), np.concatenate([r for _, r in held]), np.concatenate([s for s, _ in held])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(lists.offsets.to_numpy())
    width = int(n.max(initial=0))
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width)[None, :] < n[:, None]] = values
    return out


def whole_steps(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)`` with v = floor(scale * component) as whole numbers; rows that take no part are gone."""
    x = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("v"))


def top_k(vectors: DataFrame, is_query: Callable, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest inner products over all rows but its own.

    Rows and queries are dealt by hash into a grid of cells, one pair of a row
    group and a query block each; a cell reads its sorted lists in rounds and
    keeps k rows a query, and the cells' results meet by query. Sizes of groups
    and blocks have upper bounds, so a cell's memory does not grow. Null ids, null
    vectors and null or non-finite components take no part; shorter vectors count
    as filled with zeros; rows that share the query's id are its own; repeated
    rows are ranked each; no query or no row gives no result. Scores must fit in
    64 bits.
    """
    rows = whole_steps(vectors, id_col, vector_col, scale)
    asked = rows.where(is_query(F.col("id")))
    n, m = rows.count(), asked.count()
    groups = max(1, -(-n // min(max(n // 8, 256), 16_384)))
    blocks = max(1, -(-m // min(max(m // 4, 64), 4_096)))

    def cells(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = cells(asked, "b", blocks, "g", groups).groupBy("g", "b")
    right = cells(rows, "g", groups, "b", blocks).groupBy("g", "b")

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        ids = q.column("id").to_numpy()
        at, found, score = best_of(_matrix(q.column("v")), ids, _matrix(x.column("v")), x.column("id").to_numpy(), k)
        return pa.table({"query_id": ids[at], "vec_id": found, "score": score})

    best = left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
