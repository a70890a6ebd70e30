"""Approximate nearest neighbours (8): collision-counting hashing with query-centred windows (largest inner product).

Each of ``n_lines`` random directions gives one sorted array of projections. For a query the windows around its own
projections widen step by step (virtual rehashing: the same arrays serve every radius); a vector that lies in enough windows has collided
often enough to be verified. When the verified share is reached, exact inner products in double precision rank them.
Inner products become distances by one more coordinate, sqrt(greatest norm^2 - norm^2), 0 for queries.

Every row is indexed, in blocks of about ``block_rows`` by a hash of its id. A block's rows come to a task first and are indexed
once; the queries follow as a stream of batches, so a task holds one block and one batch. Vectors that are null, zero, hold null or
non-finite parts or lack the common length take no part, as query or candidate. Ties go to the smaller id. Repeated ids are
candidates as often as they come, except for a query's own id; a query row that repeats id and vector is asked once, rows that
share only the id get lists of their own. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.session import ship


class Index:
    """One block of vectors."""

    #: Half widths of the windows, in standard deviations of a projection; the last one holds everything.
    WIDTHS = (0.8, 1.1, 1.5, 2.0, 3.0, 1e9)

    def __init__(self, vectors: np.ndarray, n_lines: int = 192, seed: int = 5):
        self.vectors = vectors
        norms = (vectors * vectors).sum(axis=1)
        self.norm = float(np.sqrt(norms.max()))
        spare = np.sqrt(np.maximum(0.0, norms.max() - norms))
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, n_lines))
        projected = (np.c_[vectors, spare] @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def candidates(self, query: np.ndarray, k: int, share: float = 0.08, n_used: int = 40, need: float = 0.55) -> np.ndarray:
        """Places of the vectors to verify: those that collide in the most windows, ``share`` of all and 16 for each one asked for, or more.

        Of all lines those count on which the query lies farthest out: there its windows hold few other vectors. Windows
        widen until the verified ones lie in at least ``need`` of them.
        """
        n = len(self.vectors)
        wanted = min(n, int(share * n) + 16 * k)
        # scaling a query keeps its order: it gets the block's greatest norm
        centre = (query * (self.norm / np.sqrt(query @ query))) @ self.lines[:-1]
        used = np.argsort(-np.abs(centre), kind="stable")[:n_used]
        count = np.zeros(n, np.int64)
        low = high = None
        for width in self.WIDTHS:
            half = width * self.norm
            first = [int(np.searchsorted(self.sorted[j], centre[j] - half, "left")) for j in used]
            last = [int(np.searchsorted(self.sorted[j], centre[j] + half, "right")) for j in used]
            low, high = (low, high) if low else (first, first)
            new = [self.order[j, x:y] for j, a, b, c, d in zip(used, first, low, high, last, strict=True) for x, y in ((a, b), (c, d))]
            count += np.bincount(np.concatenate(new), minlength=n)
            low, high = first, last
            reached = np.bincount(count, minlength=n_used + 1)[::-1].cumsum()[::-1]
            threshold = int(np.flatnonzero(reached >= wanted)[-1])
            if threshold >= need * len(used):
                break
        return np.flatnonzero(count >= threshold)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(i, v): finite, non-zero vectors without nulls."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(fine).select(F.col(id_col).cast("long").alias("i"), v.cast("array<double>").alias("v"), finite.alias("ok")).where(F.coalesce(F.col("ok"), F.lit(False))).drop("ok")


def best_of(index: Index, ids: np.ndarray, query: np.ndarray, own: int, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the ``k`` best verified vectors of other ids."""
    at = index.candidates(query, k + 1, share)
    at = at[ids[at] != own]
    score = (index.vectors[at] * query).sum(axis=1)  # each row by itself, so that equal vectors score equally in any block
    best = np.lexsort((ids[at], -score))[:k]
    return ids[at][best], score[best]


def nearest_rows(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16_384, share: float = 0.08) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries`` among all rows of ``df``."""
    ship(df.sparkSession)
    n_blocks = max(1, -(-df.count() // block_rows))
    which = F.xxhash64("v").alias("which")  # tells queries of one id apart
    data = usable(df, id_col, vector_col).select(F.pmod(F.xxhash64("i"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "i", "v", F.lit(None).cast("long").alias("which"))
    asked = usable(queries, id_col, vector_col).dropDuplicates(["i", "v"]).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("asks"), "i", "v", which)
    schema = T._parse_datatype_string("query_id long, which long, vec_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, indexes = None, [], {}
        for batch in batches:
            for b, asks, i, v, w in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2))), _rows(batch.column(3)), batch.column(4).to_pylist(), strict=True):
                if b != block:
                    block, held, indexes = b, [], {}
                if not asks:
                    held.append((i, v))
                    continue
                if held:  # the block is whole: one index for each length
                    by_size: dict[int, list] = {}
                    for x in held:
                        by_size.setdefault(len(x[1]), []).append(x)
                    indexes = {size: (np.array([x[0] for x in own]), Index(np.stack([x[1] for x in own]))) for size, own in by_size.items()}
                    held = []
                if len(v) in indexes:
                    ids, index = indexes[len(v)]
                    found, score = best_of(index, ids, v, i, k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i)), pa.array(np.full(len(found), w)), pa.array(found), pa.array(score)], names=schema.names)

    met = data.unionByName(asked).repartition(4 * n_blocks, "block").sortWithinPartitions("block", "asks")
    found = met.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "which").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    """Each row's numbers, as views of one array."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
