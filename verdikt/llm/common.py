"""What several operators share: tables cut off from their lineage, row keys, and texts as arrays of bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D], and the ASCII capitals.
WHITE = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that the array code takes at once, so that its temporaries stay within some 40 MB.
CHUNK_BYTES = 1 << 19


#: Bytes of rows that Spark hands to Python at once, whatever the rows' number: texts may be long.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps what a Python worker holds small: Spark's own limit of 64 MB a batch is lowered, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see; a session without one (tests) gets its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="verdikt-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, computed once and kept as a table in the shared folder: later jobs read them whoever was lost.

    Most of them are slim (keys, lengths, sketches); texts are kept only where several jobs compare them. The folder is
    the cluster's to clean, like other checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/verdikt/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Places to which rows of one key are dealt where they are joined with that key's one row.
SALTS = 8


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row for each key. A key may hold any share of rows: they are dealt by the
    column by to SALTS places, each of which gets few's row."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return dealt.join(few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "__salt"], how).drop("__salt")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters kept; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def row_key(*columns: str) -> list[Column]:
    """k1 and k2: 128 bits of hash over the columns, never null. Rows that are equal in them share a key, so what is
    derived from those columns alone can be joined back by it, also for null or repeated ids."""
    marks = [F.isnull(c).cast("int") for c in columns]
    return [F.xxhash64(F.lit(seed), *columns, *marks).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column if df has it, else nulls of that type."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without a copy, and the offsets of its texts (nulls count as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to limit bytes together; a longer text comes alone."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that close numbers get unrelated hashes."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = mixed(np.arange(256, dtype=np.uint64), 77)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = min(done, size - done)
                table[done : done + step] = table[:step] * np.uint64(pow(base, done, 2**64))
                done += step
            tables.append(table)
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without white space, A-Z lower-cased) of some texts in order, and the offsets
    of the texts in them. at: the texts' offsets in data, which start anywhere."""
    data = data[at[0] : at[-1]]
    at = at - at[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_IS_WHITE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    starts[edges] = inside[edges]
    begin = np.flatnonzero(starts)
    ends = inside
    ends[:-1] &= ~inside[1:] | starts[1:]
    end = np.flatnonzero(ends) + 1
    up, down = _power_tables(len(data))
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=summed[1:])
    hashes = mixed((summed[end] - summed[begin]) * down[begin])
    return hashes, np.searchsorted(begin, at)
