"""Exact top-k search by the threshold algorithm (operator 3).

Vectors are dealt into blocks.  A block keeps, for each dimension, its vectors sorted by
that component.  For a query the lists are read from the end that its component favours,
``STEP`` entries of every list at a time; vectors met for the first time are scored in
full.  The bound on all vectors not yet met is the inner product of the query with the
values at which the lists stand; the search of a block ends when the bound is below the
query's k-th best score (equal scores go on, because ties fall to the smaller id).

The stated query set meets all rows in blocks: every block of queries is sent to every
block of vectors, and only k rows of each pair of query and block go on to the merge, of which
a task sends k of each query.

Scores are exact: in 64 bits where they hold all sums, in whole numbers of any size elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbflow.llm._cluster import written

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
STEP = 64
LARGEST = 2**63 - 1


class SortedLists:
    """The per-dimension lists of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.repeats = len(np.unique(ids)) < len(ids)
        #: vectors that the last search scored
        self.met = 0
        self.rank = np.argsort(self.vectors, axis=0, kind="stable")

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own."""
        n, axes = len(self.ids), np.flatnonzero(query)
        down = query[axes] > 0
        met = np.zeros(n, bool)
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(axes):
            axes, down = np.zeros(1, np.int64), np.ones(1, bool)
        step = STEP
        depth = 0
        while depth < n:
            stop = min(n, depth + step)
            at = np.where(down, n - 1 - np.arange(depth, stop)[:, None], np.arange(depth, stop)[:, None])
            fresh = np.zeros(n, bool)
            fresh[self.rank[at, axes].ravel()] = True
            rows = np.flatnonzero(fresh & ~met)
            met |= fresh
            rows = rows[self.ids[rows] != query_id]
            fresh_score = self.vectors[rows] @ query
            if fresh_score.dtype == object:
                fresh_score = np.minimum(np.maximum(fresh_score, -LARGEST - 1), LARGEST)
            ids, score = np.concatenate([best_id, self.ids[rows]]), np.concatenate([best, fresh_score.astype(np.int64)])
            if len(score) > k and not self.repeats:
                able = score >= np.partition(score, len(score) - k)[len(score) - k]
                ids, score = ids[able], score[able]
            keep = np.lexsort((ids, ~score))  # the negative of the least long is no long
            if self.repeats:  # of rows that share an id the best counts
                keep = keep[np.sort(np.unique(ids[keep], return_index=True)[1])]
            best_id, best = ids[keep[:k]], score[keep[:k]]
            if len(best) == k and stop < n:
                last = np.where(down, n - stop, stop - 1)
                if (self.vectors[self.rank[last, axes], axes] * query[axes]).sum() < best[-1]:
                    break
            depth, step = stop, 2 * step
            if met.all():
                break
        self.met = int(met.sum())
        return best_id, best


def whole_numbers(parts: np.ndarray) -> np.ndarray:
    """The floors of finite doubles: 64-bit where no inner product of these rows passes them, else Python's."""
    floors = np.floor(parts)
    if not floors.size or np.abs(floors).max() ** 2 * floors.shape[1] < 2.0**62:
        return floors.astype(np.int64)
    out = np.empty(floors.shape, object)
    out[...] = [[int(x) for x in row] for row in floors]
    return out


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("is_query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        vectors = whole_numbers(table.column("parts").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1))
        lists = SortedLists(ids[~kind], vectors[~kind])
        out = [[], [], []]
        for q, v in zip(ids[kind], vectors[kind]):
            found, score = lists.top(q, v, k) if len(lists.ids) else ((), ())
            for column, values in zip(out, (np.full(len(found), q), found, score)):
                column.append(np.asarray(values, np.int64))
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``rows`` for each of ``queries``.

    Both tables hold (vec_id long, parts array of numbers, of which the floors count); vectors of unlike length do not meet.  The score is the integer
    inner product (beyond 64 bits it counts as the largest or least long), ties fall to the smaller vec_id, a query's own id is no candidate.  Equal
    rows count once; of rows that share an id the better score counts.  A query with fewer
    candidates returns them all, one without any no row; empty tables give no rows.
    """
    rows, queries = rows.select("vec_id", "parts").distinct(), queries.select("vec_id", "parts").distinct()
    rows, queries = written(rows, "rows"), written(queries, "queries")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    packs = max(1, -(-queries.count() // QUERY_ROWS))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = rows.select(own(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"), F.lit(False).alias("is_query"), "vec_id", "parts")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), own(packs).alias("pack"), F.lit(True).alias("is_query"), "vec_id", "parts")
    found = left.unionByName(right).groupBy("block", "pack", F.size("parts")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, parts) with ``scale * x`` of each component, whose floors ``exact_top_k`` takes.

    Rows with a null id, a null vector or a component that is null or whose multiple is not finite are left out.
    """
    x = F.col("embedding")
    # NaN compares as the largest double, so both bounds hold for finite components only
    sound = F.forall(x, lambda v: v.isNotNull() & (scale * v.cast("double") < float("inf")) & (scale * v.cast("double") > float("-inf")))
    parts = F.transform(x, lambda v: F.lit(scale) * v.cast("double"))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("parts"))
