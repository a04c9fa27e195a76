"""Best-fit packing of token sequences by non-negative least squares over length patterns.

Documents become pieces of at most ``capacity`` tokens. The histogram of piece lengths has ``capacity`` entries at most,
however many pieces there are. Patterns of one to three pieces that fill a sequence are enumerated, how often each
repeats is fitted to the histogram by non-negative least squares and rounded, and what is left is packed largest first,
best fit, again by length and count. Pieces are then numbered within their length and find their sequence by number.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches, written

#: Pieces of one length are numbered in so many lots, so that no length has to meet in one task.
LOTS = 256
#: Parts of texts whose ids a worker keeps at most; others are encoded each time.
KEPT_PARTS = 200_000
#: Fixed value: how byte-level vocabularies of this kind split texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Parts(dict):
    """Ids of parts of texts, found when first asked for; the first ones are kept, up to a number."""

    def __init__(self, encode: Callable[[str], list[int]], before: str) -> None:
        self.encode, self.before = encode, before

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(self.before + part)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < KEPT_PARTS and len(part) < 64:
            self[part] = packed
        return packed


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    A byte-level vocabulary never joins a blank to what stands before it, so a text can be cut before each blank and the
    parts' ids kept, unless a blank stands between white space; such texts, and those with something like a special
    token, are encoded whole. Where the tokenizer's merges are numbered in their order, as in byte-level vocabularies,
    parts are encoded by rank, which gives the same ids sooner.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = re.compile(r"\s \s|<\|")
        one = self.ranked(path) or (lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.first, self.later = Parts(one, ""), Parts(one, " ")

    @staticmethod
    def ranked(path: str) -> Callable[[str], list[int]] | None:
        import tiktoken

        setup = json.loads(Path(path).read_text())
        vocabulary, merges = setup["model"]["vocab"], setup["model"].get("merges", [])
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        if setup["pre_tokenizer"].get("type") != "ByteLevel" or setup.get("normalizer") or [vocabulary.get(j) for j in joined] != list(range(256, 256 + len(joined))):
            return None
        shown = {c: c for c in (*range(33, 127), *range(161, 173), *range(174, 256))}  # bytes that stand for themselves; others follow 255
        shown |= {256 + n: c for n, c in enumerate(c for c in range(256) if c not in shown)}
        ranks = {bytes(shown[ord(c)] for c in token): number for token, number in vocabulary.items() if number < 256 + len(joined)}
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if self.whole.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *parts = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, parts))


_tokens: dict[str, Tokens] = {}


def cut(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32 and lot. A document is its ids and then end_id; a longer one
    than capacity is cut into pieces of capacity tokens, of which the first may be shorter. A null text is empty."""
    bounded_batches(documents.sparkSession)
    kind = documents.schema[id_column].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.get(tokenizer) or _tokens.setdefault(tokenizer, Tokens(tokenizer))
        end, lot = np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = tokens.ids(text.as_py() or "") + end
                n = len(ids) // 4
                view = memoryview(ids)
                at, number = 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    rows.append(row), piece.append(number), start.append(at), length.append(to - at)
                    crc.append(zlib.crc32(view[4 * at : 4 * to]))
                    at, number = to, number + 1
            if not rows:
                continue
            lots = (np.arange(len(rows)) + lot) % LOTS
            lot += len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(lots.astype(np.int32))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
            )

    return documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, lot int")


def full_patterns(lengths: np.ndarray, capacity: int, parts: int = 3) -> np.ndarray:
    """All ways to fill capacity exactly with one to parts (2 or 3) of the lengths, as rows of three lengths in falling
    order, 0 for none. There are up to capacity**2 / 12 of three."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    there[0] = False
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    second = np.arange(1, capacity // 2 + 1)
    second = second[there[second] & there[capacity - second]]
    found.append(np.stack([capacity - second, second, 0 * second], 1))
    if parts > 2:
        for third in np.flatnonzero(there[: capacity // 3 + 1]):
            middle = np.arange(third, (capacity - third) // 2 + 1)
            middle = middle[there[middle] & there[capacity - third - middle]]
            found.append(np.stack([capacity - third - middle, middle, np.full_like(middle, third)], 1))
    return np.concatenate(found).astype(np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - histogram|, A the pieces of each length in a pattern: accelerated projected
    gradient steps on the sparse matrix. Errors of short lengths weigh less, as short pieces find room elsewhere."""
    size = len(histogram)
    weight = (np.arange(size) / size) ** 0.5
    target = histogram * weight
    used = patterns > 0
    columns = weight[patterns] * used
    forward = lambda x: np.bincount(patterns.ravel(), (columns * x[:, None]).ravel(), size)
    backward = lambda r: (r[patterns] * columns).sum(1)
    v = np.ones(len(patterns))
    for _ in range(20):
        v = backward(forward(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - backward(forward(y) - target) / (1.05 * norm))
        momentum, last = (1 + (1 + 4 * momentum**2) ** 0.5) / 2, momentum
        y, x = new + (last - 1) / momentum * (new - x), new
    return x


def plan_packs(histogram: np.ndarray, capacity: int, parts: int = 3) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences), few, which together hold the histogram exactly."""
    left = np.array(histogram, np.int64)
    packs: list[tuple[list[int], int]] = []
    patterns = full_patterns(np.flatnonzero(left), capacity, parts) if left.any() else np.zeros((0, 3), np.int64)
    if len(patterns):
        repeats = np.floor(fit_repeats(patterns, left.astype(float)) + 0.5).astype(np.int64)
        for at in np.argsort(-repeats, kind="stable")[: np.count_nonzero(repeats)]:
            lengths, counts = np.unique(patterns[at][patterns[at] > 0], return_counts=True)
            if times := int(min(repeats[at], *(left[lengths] // counts))):
                left[lengths] -= counts * times
                packs.append((patterns[at][patterns[at] > 0].tolist(), times))
    active = np.flatnonzero(left).tolist()
    while active:  # each round uses up a length or more
        pack, room, taken = [], capacity, {}
        places = active
        while (at := bisect_right(places, room) - 1) >= 0:
            length = places[at]
            fits = min(room // length, int(left[length]) - taken.get(length, 0))
            if not fits:
                places = places[:at]
                continue
            pack += [length] * fits
            taken[length] = taken.get(length, 0) + fits
            room -= length * fits
            if fits == left[length]:
                places = places[:at]
        times = min(int(left[length]) // n for length, n in taken.items())
        for length, n in taken.items():
            left[length] -= n * times
        packs.append((pack, times))
        active = [x for x in active if left[x]]
    return packs


def _slots(packs: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of pieces of one length, by length and first number: that pair as one number, the first piece's sequence
    and the place in it. The next pieces of a run go to the next sequences."""
    runs, sequence, next_number = [], 0, {}
    for pack, times in packs:
        offset = 0
        for length in pack:
            number = next_number.get(length, 0)
            next_number[length] = number + times
            runs.append((length << 44 | number, sequence, offset))
            offset += length
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", parts: int = 3) -> DataFrame:
    """All pieces of all documents with their sequence_id and offset: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    Null texts are empty documents (one token, end_id), rows with equal or null ids are documents of their own, an
    empty table gives no rows. To the driver goes the histogram by length and lot (capacity x LOTS entries at most) and
    from it the plan, whose runs number at most three per pattern used and do not grow with the table.
    """
    pieces = written(cut(documents, tokenizer, capacity, end_id, id_column, text_column), "pieces")
    counted = pieces.groupBy("length", "lot").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros((capacity + 1, LOTS), np.int64)
    counts[counted["length"], counted["lot"]] = counted["n"]
    before = np.cumsum(counts, 1) - counts
    keys, sequences, offsets = _slots(plan_packs(counts.sum(1), capacity, parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "lot", "nth")}
            number = before[column["length"], column["lot"]] + column["nth"] - 1
            run = np.searchsorted(keys, column["length"] << 44 | number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(sequences[run] + number - (keys[run] & (1 << 44) - 1)), pa.array(offsets[run])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    lot = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "lot", F.row_number().over(lot).cast("long").alias("nth"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
