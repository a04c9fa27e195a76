"""Vectors in blocks: rows of many vectors, so that Python gets arrays and joins see few rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Whether a vector isn't null or empty and all its components are finite (and, if asked, not all are zero)."""
    x = vector.cast("array<double>")
    good = F.size(x).__gt__(0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if nonzero:
        good = good & F.exists(x, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A list column as a matrix; all lists are as long as the first."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1)


def blocks(vectors: DataFrame, id_column: str, vector_column: str, rows: int, kind: str = "double") -> DataFrame:
    """dim, block_ids and block (bytes of a row-major matrix, integers as narrow as they can be) for runs of at most rows vectors of one dimension."""
    dtype = {"double": np.float64, "long": np.int64, "int": np.int32}[kind]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def made(dim: int) -> Iterator[pa.RecordBatch]:
            ids, vectors = (np.concatenate(x) for x in held.pop(dim))
            for at in range(0, len(ids), rows):
                block = vectors[at : at + rows]
                if kind == "long":  # in the narrowest type that holds them all
                    block = block.astype(np.min_scalar_type(min(block.min(), -1 - block.max())))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[at : at + rows].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(block).tobytes()], pa.binary())], names=["dim", "block_ids", "block"])

        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dim)) if (sizes != dim).any() else batch
                ids, parts = held.setdefault(dim, ([], []))
                ids.append(own.column(0).to_numpy().astype(np.int64))
                parts.append(matrix(own.column(1), dtype))
                if sum(map(len, ids)) >= rows:
                    yield from made(dim)
        for dim in list(held):
            yield from made(dim)

    return vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("v")).mapInArrow(gather, "dim int, block_ids binary, block binary")


def unpacked(ids: bytes, block: bytes, dim: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    if dtype is np.int64:  # as narrow as they were packed
        return numbers, np.frombuffer(block, f"i{len(block) // (len(numbers) * dim)}").reshape(-1, dim).astype(np.int64)
    return numbers, np.frombuffer(block, dtype).reshape(-1, dim)


def met_blocks(held: DataFrame, asked: DataFrame) -> DataFrame:
    """dim, q_ids, q_block, block_ids and block: every block of asked with every block of held of its dimension.

    Blocks of held are dealt to as many spots as a shuffle has partitions, and each spot gets all of asked. Those copies are
    made on the way and no estimate of Spark's counts them, so the join is one of shuffled rows: a broadcast would bring
    all copies to the driver. Bytes say nothing of a pair's work, so spots aren't put together.
    """
    spots = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.withColumn("spot", F.pmod(F.xxhash64("block_ids"), F.lit(spots)).cast("int"))
    copied = asked.withColumnsRenamed({"dim": "q_dim", "block_ids": "q_ids", "block": "q_block"}).withColumn("q_spot", F.explode(F.sequence(F.lit(0), F.lit(spots - 1))))
    return dealt.repartition(spots, "dim", "spot").hint("merge").join(copied.repartition(spots, "q_dim", "q_spot").hint("merge"), (F.col("dim") == F.col("q_dim")) & (F.col("spot") == F.col("q_spot"))).select("dim", "q_ids", "q_block", "block_ids", "block")
