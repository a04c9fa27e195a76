"""Exact top-k by vector-approximation files.

Candidates stand in blocks. A block's file holds, for each component, a grid of equal cells and every vector's cells in
it, a byte each at most. A query scans the cells, which bound every vector's inner product from above, then reads exact
vectors in the order of their bounds until no unread bound reaches the kth best score. Blocks of queries meet blocks of
candidates, and each pair of blocks hands on at most k rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches
from verdikt.llm.vectors import blocks, met_blocks, unpacked, usable


def approximation(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of integer vectors: each component's least value, its cells' width and the cells."""
    low = vectors.min(0)
    width = (vectors.max(0) - low) // (1 << bits) + 1
    return low, width, ((vectors - low) // width).astype(np.uint8 if bits <= 8 else np.uint16)


def upper_bounds(query: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """No vector of a cell has a larger inner product with the query. A row for each query."""
    scaled = query * width
    return scaled.astype(float) @ cells.T.astype(float) + ((query @ low) + np.maximum(query, 0) @ (width - 1))[:, None]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, file: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id, and ids and scores of the best k of the block, in no order, without the query's own."""
    bounds = upper_bounds(queries, *file)
    for row, (own, query) in enumerate(zip(query_ids, queries, strict=True)):
        bound = bounds[row]
        found_ids, found_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        unread, step, done = np.ones(len(ids), bool), 4 * k, False
        while not done and unread.any():  # the unread ones with the largest bounds, ever more of them; equal bounds in any order
            order = np.flatnonzero(unread)
            if len(order) > step:
                order = order[np.argpartition(-bound[order], step - 1)[:step]]
            order = order[np.argsort(-bound[order], kind="stable")]
            unread[order] = False
            step *= 8
            for at in range(0, len(order), 4 * k):
                if done := len(found_scores) >= k and bound[order[at]] < found_scores.min():
                    break
                part = order[at : at + 4 * k]
                part = part[ids[part] != own]
                scores = np.r_[found_scores, vectors[part] @ query]
                near = np.r_[found_ids, ids[part]]
                best = np.lexsort((near, -scores))[:k]
                found_ids, found_scores = near[best], scores[best]
        yield int(own), found_ids, found_scores


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0, bits: int = 6, block_rows: int = 2048, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (the same columns) the k rows of embeddings with the
    largest integer inner product, each component taken as floor(scale * x); ties go to the smaller id, and rows with
    the query's id aren't candidates.

    Null ids and vectors that are null, empty or hold null or non-finite components take no part. Vectors meet those
    of their own dimension. A repeated row is a candidate for itself each time; a repeated query id counts once, with
    its least vector.
    """
    bounded_batches(embeddings.sparkSession)
    whole = lambda df: df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    once = whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = blocks(once, "id", "v", query_rows, "long")
    held = blocks(whole(embeddings), "id", "v", block_rows, "long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = b"", None
        for batch in batches:
            for row in range(len(batch)):
                dim, q_ids, q_block, ids_, block = (batch.column(i)[row].as_py() for i in range(5))
                query_ids, query = unpacked(q_ids, q_block, dim, np.int64)
                ids, vectors = unpacked(ids_, block, dim, np.int64)
                if ids_ != last:
                    last, file = ids_, approximation(vectors, bits)
                found = list(search_block(query_ids, query, ids, vectors, file, k))
                if sum(len(f[1]) for f in found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    # all of a stated query set against all rows: a row of the join is a pair of blocks
    met = met_blocks(held, asked)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
