"""Fill-in-middle: texts cut in three and put in another order, so that a model learns to fill the gap.

A cut is drawn as a number of units (code points, words or lines), which a UTF-8 text can't be sliced by. So while the
units are counted, in blocks of bytes, a sparse index is kept: byte and code-point offset of every so many units. A cut
then takes a binary search over these checkpoints and a short scan from the nearest one.
"""

from __future__ import annotations

import re
from itertools import pairwise, permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches, utf8

#: The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
UNITS = ("code point", "word", "line")

#: Bytes that are counted at once.
BLOCK = 1 << 16

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def begins(data: np.ndarray, first: int, last: int, unit: str) -> np.ndarray:
    """Which bytes of data[first:last] begin a unit. Units cover the text: white space belongs to the word before it, a
    line feed to the line that it ends; white space at the beginning is a unit of its own."""
    part = data[first:last]
    if unit == "code point":
        return (part & 0xC0) != 0x80
    before = data[first - 1 : last - 1] if first else np.concatenate([np.full(1, 10, np.uint8), data[: last - 1]])
    marks = before == 10 if unit == "line" else ~_WHITE[part] & _WHITE[before]
    if not first and len(marks):
        marks[0] = True
    return marks


class Checkpoints:
    """n, the units of a UTF-8 text, points, its code points, and where every so many units begin."""

    def __init__(self, data: np.ndarray, unit: str = "code point", every: int = 1024) -> None:
        if unit not in UNITS or every < 1:
            raise ValueError(f"units are {', '.join(UNITS)}, every is positive")
        self.data, self.unit, self.n, self.points = data, unit, 0, 0
        kept: list[tuple[np.ndarray, ...]] = []
        for first in range(0, len(data), BLOCK):
            last = min(len(data), first + BLOCK)
            leads = np.flatnonzero(begins(data, first, last, "code point"))
            starts = leads if unit == "code point" else np.flatnonzero(begins(data, first, last, unit))
            numbers = np.arange(-self.n % every, len(starts), every)
            marks = starts[numbers]
            kept.append((self.n + numbers, first + marks, self.points + np.searchsorted(leads, marks)))
            self.n += len(starts)
            self.points += len(leads)
        self.units, self.bytes_at, self.points_at = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64),) * 3

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the unit of that number, from 0 to n."""
        if units >= self.n:
            return len(self.data), self.points
        at = int(np.searchsorted(self.units, units, "right")) - 1
        first = int(self.bytes_at[at])
        last = int(self.bytes_at[at + 1]) if at + 1 < len(self.bytes_at) else len(self.data)
        end = first + int(np.flatnonzero(begins(self.data, first, last, self.unit))[units - int(self.units[at])])
        return end, int(self.points_at[at]) + int(begins(self.data, first, end, "code point").sum())


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """The markers, if an output can always be split at them: none empty, none within another, and no end of one that
    begins one, since text beside a marker could then complete it."""
    texts = list(markers)
    clash = len(texts) != 3 or not all(texts) or any(a in b for a, b in permutations(texts, 2)) or any(a.endswith(b[:n]) for a, b in product(texts, texts) for n in range(1, min(len(a), len(b))))
    if clash:
        raise ValueError("markers must be three texts that don't overlap")
    return markers


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of that form was made of."""
    parts = F.split(output, "|".join(map(re.escape, markers)), -1)
    joined = lambda *order: F.concat(*(F.try_element_at(parts, F.lit(n)) for n in order))
    return F.when(form == "psm", joined(2, 4, 3)).when(form == "spm", joined(3, 4, 2)).otherwise(output)


def draws(id_column: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 from the hash of seed and id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * n, 8), 16, 10).cast("long") for n in range(4)]


def fill_in_middle(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str = "code point", rate: int = 90, suffix_first: int = 20, seed: str = "1", markers: tuple[str, str, str] = MARKERS, every: int = 1024) -> DataFrame:
    """The rows of documents with n (units), form, prefix_chars, middle_chars (code points; null if plain) and output as
    further columns, which replace columns of these names.

    rate of 100 texts are cut at two places drawn by id, suffix_first of 100 of those have the suffix first (spm, else
    psm). Empty texts, null ones (which count as empty) and those that hold a marker stay plain: their output is the text.
    Equal ids draw alike, so equal rows get equal outputs; a null id draws as an empty one; an empty table gives none.
    Each row stands for itself: nothing is shuffled. A very long text is held with its output, and its index has a
    place per ``every`` units.
    """
    markers = checked(markers)
    bounded_batches(documents.sparkSession)
    encoded = [m.encode() for m in markers]
    if unit not in UNITS or every < 1:
        raise ValueError(f"units are {', '.join(UNITS)}, every is positive")

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    def arranged(texts: pa.Array, forms: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        data, at = utf8(texts)
        n, prefixes, middles, outputs = [], [], [], []
        for (a, b), form, h1, h2 in zip(pairwise(at.tolist()), forms.to_pylist(), one.to_pylist(), two.to_pylist(), strict=True):
            index = Checkpoints(data[a:b], unit, every)
            n.append(index.n)
            raw = data[a:b].tobytes()
            if form == "plain":
                prefixes.append(None), middles.append(None), outputs.append(raw)
                continue
            (x, prefix), (y, upto) = map(index.cut, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
            p, s, m = encoded[0] + raw[:x], encoded[1] + raw[y:], encoded[2] + raw[x:y]
            prefixes.append(prefix), middles.append(upto - prefix), outputs.append(b"".join((p, s, m) if form == "psm" else (s, p, m)))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), forms, pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())], ["n", "form", "prefix_chars", "middle_chars", "output"])

    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{id_column}`"), seed)
    holds = F.contains(text, F.lit(markers[0])) | F.contains(text, F.lit(markers[1])) | F.contains(text, F.lit(markers[2]))
    form = F.when((text == "") | holds | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    others = [F.col(f"`{c}`") for c in documents.columns if c not in made]
    return documents.select(*others, arranged(text, form, h1, h2).alias("__fim")).select(*(F.col(f"`{c}`") for c in documents.columns if c not in made), *(F.col(f"__fim.{c}").alias(c) for c in made))
