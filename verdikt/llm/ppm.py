"""Language-model scoring by prediction by partial matching over bytes, beside a unigram baseline.

Training counts, for every byte with its context of ``order`` bytes, how often they occur; the counts of shorter contexts
are sums of those, so one table of (context, symbol) pairs is the whole trie. A symbol seen in its longest context has
probability n / (N + T) there, N the context's symbols and T its distinct ones; else the model escapes with T / (N + T)
to the next shorter context, where symbols that a longer one has seen are excluded, and below the empty context to a
uniform choice of what remains (method C). A text's score is the log10 probability of its bytes and of its end.

The table is counted by Spark and grows with the corpus; it is never gathered. What every code is worth is found by joins
with the contexts' sums. Texts are dealt to blocks of some megabytes; a block asks for the values of the codes that occur
in it, each once, by a join with the table, and its texts are scored with those. A block's part is bounded by its own
bytes, so all sizes take this one way.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches, chunks, utf8, word_hashes, written

END, PAD, BITS = 256, 257, 9
#: Kinds of counts: training words (by hash) and grams, training texts, grams of texts held out, bytes of all texts.
WORD, GRAM, LAST, OUT, BYTES = range(5)
#: Bytes of texts that are scored together, about; a longer text comes alone or with few.
BLOCK_BYTES = 16 << 20
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
#: Entries that a task gathers before it hands on their sums.
GATHERED = 3_000_000


def gram_codes(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with its order predecessors as one number, for all bytes and ends of some texts, and its offsets."""
    n, step = len(at) - 1, order + 1
    data, at = data[at[0] : at[-1]], at - at[0]
    symbols = np.full(len(data) + n * step, PAD, np.int64)
    gap = np.arange(n) * step + order
    symbols[np.arange(len(data)) + np.repeat(gap, np.diff(at))] = _LOWER[data]
    symbols[at[1:] + gap] = END
    codes = np.zeros(len(symbols) - order, np.int64)
    for k in range(step):
        codes <<= BITS
        codes |= symbols[k : len(symbols) - order + k]
    return codes[symbols[order:] != PAD], at + np.arange(n + 1)


class Gathered:
    """Sums by number, merged whenever they grow too many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, numbers: np.ndarray) -> None:
        found = np.unique(numbers, return_counts=True)
        self.parts.append(found)
        self.size += len(found[0])
        if self.size > GATHERED:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            numbers, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.argsort(numbers, kind="stable")
            numbers = numbers[order]
            first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            self.parts = [(numbers[first], np.add.reduceat(counts[order], first))]
        self.size = sum(len(p[0]) for p in self.parts)

    def drain(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for numbers, counts in self.parts:
            for at in range(0, len(numbers), 200_000):
                part = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers[part]), kind, np.int32)), pa.array(numbers[part].astype(np.int64)), pa.array(counts[part].astype(np.int64))], names=["kind", "code", "n"])
        self.parts, self.size = [], 0


def train(texts: DataFrame, order: int = 4) -> DataFrame:
    """kind, code, n over the rows' text and held_out: counts of words and grams of texts that aren't held out, of those
    texts, of the others' grams, and of all bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {WORD: Gathered(), GRAM: Gathered(), OUT: Gathered()}
        n = size = 0
        for batch in batches:
            for out in (False, True):
                data, at = utf8(batch.column(0).filter(pa.compute.equal(batch.column(1), out)))
                n += 0 if out else len(at) - 1
                size += int(at[-1] - at[0])
                for a, b in chunks(at):
                    kinds[OUT if out else GRAM].add(gram_codes(data, at[a : b + 1], order)[0])
                    if not out:
                        kinds[WORD].add(word_hashes(data, at[a : b + 1])[0].view(np.int64))
            for kind, gathered in kinds.items():
                if gathered.size > GATHERED:
                    yield from gathered.drain(kind)
        for kind, gathered in kinds.items():
            yield from gathered.drain(kind)
        yield pa.RecordBatch.from_arrays([pa.array([LAST, BYTES], pa.int32()), pa.array([0, 0], pa.int64()), pa.array([n, size], pa.int64())], names=["kind", "code", "n"])

    return texts.select("text", "held_out").mapInArrow(count, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def values(counts: DataFrame, order: int) -> DataFrame:
    """code and value, the log10 probability of its symbol in its context, of all codes in counts, learnt or held out.

    The symbols seen in a context have all been seen in the shorter ones, too. So what a longer context excludes from a
    shorter one is summed once for each context: how many symbols it has, and how often the shorter one has those. A
    context has no more symbols than there are, so no key of these joins is hot.
    """
    mask = lambda k: F.lit((1 << BITS * k) - 1)
    context = F.shiftright("code", BITS)
    grams = {order: counts.filter(F.col("kind") == GRAM).select("code", "n")}
    for k in range(order - 1, -1, -1):
        grams[k] = written(grams[k + 1].groupBy(F.col("code").bitwiseAND(mask(k + 1)).alias("code")).agg(F.sum("n").alias("n")), "grams")
    known = grams[order].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.collect_list(F.struct("code", "n")).alias("own"))
    learnt = known.select("total", "kinds", F.inline("own")).select("code", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value"))

    whole = grams[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kinds")).first()
    zero = F.lit(0).cast("long")
    left = counts.filter(F.col("kind") == OUT).select("code").join(grams[order], "code", "left_anti")
    left = left.select("code", F.lit(None).cast("double").alias("value"), F.lit(0.0).alias("escaped"), zero.alias("less_total"), zero.alias("less_kinds"))
    for k in range(order, -1, -1):
        if k:  # total and kinds of contexts of k symbols, and how often the next shorter ones have those symbols
            shorter = grams[k - 1].select(F.col("code").alias("shorter"), F.col("n").alias("shorter_n"))
            sums = grams[k].withColumn("shorter", F.col("code").bitwiseAND(mask(k))).join(shorter, "shorter").groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("shorter_n").alias("next_total"))
            left = left.withColumn("context", context.bitwiseAND(mask(k))).join(sums, "context", "left")
        else:
            left = left.withColumns({"total": F.lit(whole.total), "kinds": F.lit(whole.kinds), "next_total": zero})
        seen = F.lit(None).cast("long")
        if k < order:
            left = left.withColumn("own", F.col("code").bitwiseAND(mask(k + 1))).join(grams[k].withColumnRenamed("code", "own"), "own", "left")
            seen = F.col("n")
        kinds = F.col("kinds") - F.col("less_kinds")
        all_ = F.col("total") - F.col("less_total") + kinds
        left = left.select(
            "code", F.coalesce("value", F.when(seen.isNotNull(), F.col("escaped") + F.log10(seen / all_))).alias("value"), (F.col("escaped") + F.when(kinds > 0, F.log10(kinds / all_)).otherwise(0.0)).alias("escaped"),
            F.coalesce("next_total", "less_total").alias("less_total"), F.coalesce("kinds", "less_kinds").alias("less_kinds"),
        )
    unseen = left.select("code", F.coalesce("value", F.col("escaped") - F.log10(F.lit(257.0) - F.col("less_kinds"))).alias("value"))
    return learnt.unionByName(unseen)


def _asked(texts: pa.Table, order: int) -> pa.Table:
    """block, kind and code of the words and grams of a block's texts, each once."""
    data, at = utf8(texts.column("text"))
    kinds = {WORD: Gathered(), GRAM: Gathered()}
    for a, b in chunks(at):
        kinds[WORD].add(word_hashes(data, at[a : b + 1])[0].view(np.int64))
        kinds[GRAM].add(gram_codes(data, at[a : b + 1], order)[0])
    found = [batch for kind, gathered in kinds.items() for batch in gathered.drain(kind)]
    codes = pa.Table.from_batches(found, pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])).select(["kind", "code"])
    return codes.add_column(0, "block", pa.array(np.full(len(codes), texts.column("block")[0].as_py()), pa.int64()))


class Table:
    """The values of a block's codes of one kind, sorted; others have none."""

    def __init__(self, held: pa.Table, kind: int) -> None:
        own = held.filter(pa.compute.equal(held.column("kind"), kind))
        code, value = (own.column(name).to_numpy() for name in ("code", "value"))
        by = np.argsort(code)
        self.code, self.value = code[by], value[by]

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code has a value, and that value or 0."""
        distinct, back = np.unique(codes, return_inverse=True)  # sorted, which keeps the lookups close together
        at = np.searchsorted(self.code, distinct)
        held = at < len(self.code)
        held[held] = self.code[at[held]] == distinct[held]
        value = np.zeros(len(distinct))
        value[held] = self.value[at[held]]
        return held[back], value[back]


def _scored(texts: pa.Table, held: pa.Table, order: int) -> pa.Table:
    """id, held_out, words, known words, the sum of log10(c + 1) over its words, and the log10 probability of each text."""
    words, grams = Table(held, WORD), Table(held, GRAM)
    data, at = utf8(texts.column("text"))
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for a, b in chunks(at):
        codes, bounds = word_hashes(data, at[a : b + 1])
        known, weight = words.of(codes.view(np.int64))
        row = np.repeat(np.arange(b - a), np.diff(bounds))
        codes, ends = gram_codes(data, at[a : b + 1], order)
        columns[0].append(np.diff(bounds))
        columns[1].append(np.bincount(row, known, b - a).astype(np.int64))
        columns[2].append(np.bincount(row, weight, b - a))
        columns[3].append(np.add.reduceat(grams.of(codes)[1], ends[:-1]))
    kinds = (np.int64, np.int64, float, float)
    made = [pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind)) for x, kind in zip(columns, kinds, strict=True)]
    return pa.Table.from_arrays([texts.column("id"), texts.column("held_out"), *made], names=["id", "held_out", "words", "known", "weight", "score"])


def score_documents(documents: DataFrame, held_out: Column, order: int = 4, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out: a boolean column; where it is true, rows are not learnt from (null: false). Null texts are empty: only
    their end is scored. Equal rows are learnt from and scored each. Without training rows the model is uniform and
    nothing is known. Very long texts are worked through in parts; only the codes that occur in one are held at once.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    counts = written(train(rows, order), "counts")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    total = counts.agg((of(WORD) + of(LAST)).alias("tokens"), of(LAST).alias("ends"), F.count_if(F.col("kind") == WORD).alias("kinds"), of(BYTES).alias("bytes")).first()

    word = counts.filter(F.col("kind") == WORD).select("kind", "code", F.log10(F.col("n") + F.lit(1.0)).alias("value"))
    table = written(values(counts, order).select(F.lit(GRAM).alias("kind"), "code", "value").unionByName(word), "values")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-total.bytes // block_bytes)))))
    asked = dealt.groupBy("block").applyInArrow(lambda texts: _asked(texts, order), "block long, kind int, code long")
    held = asked.join(table, ["kind", "code"]).select("block", "kind", "code", "value")
    kind = rows.schema["id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(lambda texts, codes: _scored(texts, codes, order), f"id {kind}, held_out boolean, words long, known long, weight double, score double")

    tokens = F.col("words") + 1
    floor = log10(total.tokens + total.kinds + (total.ends > 0) + 1)
    return scored.select(
        F.col("id").alias("doc_id"), "held_out", tokens.alias("n_tokens"), (F.col("known") + int(total.ends > 0)).cast("long").alias("n_known"), F.lit(total.tokens).cast("long").alias("train_tokens"),
        (F.col("weight") + log10(total.ends + 1) - tokens * F.lit(floor)).alias("base_score"), "score",
    )
