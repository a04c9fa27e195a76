"""Quality of texts by histogram gradient-boosted trees over document statistics.

Statistics are counted in stretches of a text, so a long one takes no more memory than a short one. They are binned by
quantiles; trees grow level by level on histograms of gradients. The trees are complete and kept as flat arrays, so numpy
sends a batch of rows down all of them at once, one step per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches, chunks, utf8, word_hashes

#: Bytes of a stretch: distinct words and lines are counted within one.
STRETCH = 1 << 15

#: Classes of bytes, each with its share among the statistics: other, lower case, capitals, digits, white, line feeds, ends of sentences, other marks, symbols, and leads and others of non-ASCII characters.
_CLASSES = 11
_CLASS = np.zeros(256, np.int64)
for _n, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\x0b\x0c\r", b"\n", b".!?", b",;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", range(0xC0, 256), range(0x80, 0xC0)), 1):
    _CLASS[list(_members)] = _n

#: What is counted beside the classes.
_COUNTS = ("words", "letters squared", "short", "long", "repeated", "distinct", "top", "lines", "ended", "opened", "distinct lines", "marked", "capitalised")
STATISTICS = ("log points", "log words", "word length", "spread of word length", "lower", "capitals", "digits", "white", "line feeds", "ends", "marks", "symbols", "non-ASCII", "other", "short words", "long words", "repeated words", "distinct words", "top word", "words a line", "ended lines", "opened lines", "distinct lines", "marked words", "capitalised words")


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of stretches and the text of each: a longer text is cut after white space, or else between characters."""
    bounds, owners = [int(at[0])], []
    for n, (first, last) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while last - first > STRETCH:
            tail = data[first + STRETCH // 2 : first + STRETCH]
            white = np.flatnonzero((_CLASS[tail] == 4) | (_CLASS[tail] == 5))
            cut = first + STRETCH // 2 + int(white[-1]) + 1 if len(white) else first + STRETCH
            while _CLASS[data[cut]] == 10:
                cut -= 1
            bounds.append(cut), owners.append(n)
            first = cut
        bounds.append(last), owners.append(n)
    return np.array(bounds), np.array(owners, np.int64)


def _distinct(group: np.ndarray, hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each group and the count of its commonest."""
    keys, counts = np.unique((group.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)), return_counts=True)
    own = (keys >> np.uint64(44)).astype(np.int64)
    top = np.zeros(groups, np.int64)
    np.maximum.at(top, own, counts)
    return np.bincount(own, minlength=groups), top


def _counted(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each stretch: bytes by class, then _COUNTS."""
    n, base = len(at) - 1, at[0]
    part, at = data[base : at[-1]], at - base
    if not len(part):
        return np.zeros((n, _CLASSES + len(_COUNTS)))
    kinds = _CLASS[part]
    by_class = np.bincount(np.repeat(np.arange(n), np.diff(at)) * _CLASSES + kinds, minlength=n * _CLASSES).reshape(n, _CLASSES)
    inside = (kinds != 4) & (kinds != 5)
    edge = np.zeros(len(part) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]])
    end = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True]) + 1
    hashes, bounds = word_hashes(part, at)
    stretch = np.repeat(np.arange(n), np.diff(bounds))
    per = lambda mask: np.bincount(stretch, mask, n)
    points = np.concatenate([[0], np.cumsum(kinds != 10)])
    length = points[end] - points[begin]
    same = np.r_[False, (hashes[1:] == hashes[:-1]) & (stretch[1:] == stretch[:-1])] if len(hashes) else np.zeros(0, bool)
    distinct, top = _distinct(stretch, hashes, n)
    plain = np.concatenate([[0], np.cumsum(np.isin(kinds, (1, 2, 3, 9, 10)))])
    marked = plain[end] - plain[begin] < end - begin
    first_word = np.flatnonzero(np.r_[True, (np.diff(np.searchsorted(np.flatnonzero(kinds == 5), begin)) > 0) | (np.diff(stretch) > 0)]) if len(begin) else np.zeros(0, np.int64)
    last_word = np.r_[first_word[1:], len(begin)][: len(first_word)] - 1
    line_of = stretch[first_word] if len(begin) else first_word
    lines = np.bincount(line_of, minlength=n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
    distinct_lines, _ = _distinct(line_of, sums[last_word + 1] - sums[first_word], n)
    ended, opened = (np.bincount(line_of, mask, n) for mask in (kinds[end[last_word] - 1] == 6, kinds[begin[first_word]] == 2))
    return np.column_stack([by_class, np.diff(bounds), per(length.astype(float) ** 2), per(length <= 2), per(length >= 10), per(same), distinct, top, lines, ended, opened, distinct_lines, per(marked), per(kinds[begin] == 2)])


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; nulls and empty texts are all zeros."""
    data, at = utf8(texts)
    bounds, owners = stretches(data, at)
    total = np.zeros((len(at) - 1, _CLASSES + len(_COUNTS)))
    for a, b in chunks(bounds):
        np.add.at(total, owners[a:b], _counted(data, bounds[a : b + 1]))
    c = dict(zip(_COUNTS, total[:, _CLASSES:].T, strict=True))
    other, lower, capitals, digits, white, feeds, ends, marks, symbols, leads, tails = total[:, :_CLASSES].T
    points = total[:, :_CLASSES].sum(1) - tails
    share = lambda part, whole: part / np.maximum(whole, 1)
    mean = share(points - white - feeds, c["words"])
    of_points = [share(x, points) for x in (lower, capitals, digits, white, feeds, ends, marks, symbols, leads, other)]
    of_words = [share(c[k], c["words"]) for k in ("short", "long", "repeated", "distinct", "top")]
    of_lines = [share(c[k], c["lines"]) for k in ("words", "ended", "opened", "distinct lines")]
    return np.column_stack([np.log1p(points), np.log1p(c["words"]), mean, np.sqrt(np.maximum(share(c["letters squared"], c["words"]) - mean**2, 0)), *of_points, *of_words, *of_lines, share(c["marked"], c["words"]), share(c["capitalised"], c["words"])])


@dataclass
class Forest:
    """Complete trees of one depth as flat arrays: statistic and cut of each inner node, tree by tree and level by level,
    and the leaves' values. base is the margin before all trees."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of the leaves that each row reaches."""
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        trees = len(self.leaf) // leaves
        total = np.full(len(x), self.base)
        for first in range(0, len(x), 4096):
            rows = np.ascontiguousarray(x[first : first + 4096])
            start = np.arange(len(rows))[:, None] * rows.shape[1]
            node = np.zeros((len(rows), trees), np.int64)
            root = np.arange(trees) * inner
            for _ in range(self.depth):
                here = root + node
                node = 2 * node + 1 + (rows.ravel()[start + self.feature[here]] > self.cut[here])
            total[first : first + 4096] += self.leaf[np.arange(trees) * leaves + node - inner].sum(1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray, rounds: int = 120, rate: float = 0.1, depth: int = 4, bins: int = 64, least: float = 5.0) -> Forest:
    """Boosted on the rows that aren't held, as far as the held ones' weighted loss falls (all rounds if none is held)."""
    learnt = ~held
    cuts = [np.unique(np.quantile(x[learnt, f], np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    share = float(np.clip(np.average(y[learnt], weights=weight[learnt]), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(x), base), (1 << depth) - 1
    features, limits, leaves, best, best_loss = [], [], [], 0, np.inf
    padded = np.full((x.shape[1], bins), np.inf)
    for f, c in enumerate(cuts):
        padded[f, : len(c)] = c
    for done in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        slope, curve = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        node = np.zeros(len(x), np.int64)
        feature, place = np.zeros(inner, np.int64), np.full(inner, bins - 1)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            own = node[learnt] - first
            sums = []
            for value in (slope[learnt], curve[learnt]):
                flat = [np.bincount(own * bins + binned[learnt, f], value, width * bins).reshape(width, bins) for f in range(x.shape[1])]
                sums.append(np.cumsum(np.stack(flat, 1), 2))
            (g, h), (all_g, all_h) = sums, (s[:, :, -1:] for s in sums)
            gain = g**2 / (h + least) + (all_g - g) ** 2 / (all_h - h + least) - all_g**2 / (all_h + least)
            gain[(h < 1) | (all_h - h < 1)] = 0
            flat_gain = gain.reshape(width, -1)
            chosen = flat_gain.argmax(1)
            split = flat_gain[np.arange(width), chosen] > 1e-9
            feature[first : first + width] = np.where(split, chosen // bins, 0)
            place[first : first + width] = np.where(split, chosen % bins, bins - 1)
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > place[node])
        reached = node - inner
        value = rate * np.bincount(reached[learnt], slope[learnt], 1 << depth) / (np.bincount(reached[learnt], curve[learnt], 1 << depth) + least)
        margin += value[reached]
        features.append(feature), limits.append(padded[feature, place]), leaves.append(value)
        if held.any():
            loss = np.average(np.logaddexp(0, np.where(y[held] > 0, -margin[held], margin[held])), weights=weight[held])
            if loss < best_loss - 1e-6:
                best, best_loss = done, loss
            elif done - best > 25:
                break
        else:
            best = done
    return Forest(base, depth, np.concatenate(features[: max(1, best)]), np.concatenate(limits[: max(1, best)]), np.concatenate(leaves[: max(1, best)]))


def _statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def described(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))

    return described(text)


def learn(documents: DataFrame, labels: DataFrame, held_out: Column, id_column: str, text_column: str, label_column: str, sample_rows: int) -> Forest | float:
    """The forest, or the share of label 1 (0.5 without labels) where only one label is found.

    Of each label sample_rows / 2 rows at most are learnt from, those with the least hashes of ids; they weigh as many as
    all of that label do. Rows equal in text and label count once. A fifth of them, by hash, stops the boosting.
    """
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("y"), held_out.alias("held")).filter("id IS NOT NULL AND y IN (0, 1) AND NOT coalesce(held, false)").select("id", "y").distinct()
    total = {r.y: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total:
        return 0.5
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionAll(parts[1]).withColumnRenamed("id", "__id"))  # sample_rows at most
    texts = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).join(chosen, F.col("id") == F.col("__id"))
    rows = texts.select("y", F.xxhash64("text").alias("h"), _statistics_column(F.col("text")).alias("x")).dropDuplicates(["y", "h"])
    seen = rows.orderBy(F.xxhash64("h"), "y").limit(sample_rows).toPandas()  # an id of many texts can't exceed it either
    if seen["y"].nunique() < 2:
        return float(total.get(1, 0) / sum(total.values()))
    x, y, held = np.stack(seen["x"].to_numpy()), seen["y"].to_numpy(float), (seen["h"] % 5 == 0).to_numpy()
    weight = np.array([total[int(v)] / (y == v).sum() for v in y])
    weight /= weight.mean()
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    return fit_forest(x, y, weight, held)


def score_quality(documents: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", least: float = 0.7, sample_rows: int = 20_000) -> DataFrame:
    """The rows of documents with score (0 to 1, higher: label 1 likelier) and predicted (1 if score is least or more,
    else 0) as further columns, which replace columns of these names.

    held_out, over the id column, keeps labels from being learnt. Labels other than 0 and 1 and those of null ids aren't
    used; contradicting ones both count. Null and empty texts are scored by statistics that are all zero; equal texts
    score alike; an empty table gives none. No text is shuffled: the chosen labels (sample_rows at most) are broadcast to
    the texts for learning, and the forest for scoring.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(learn(documents, labels, held_out, id_column, text_column, label_column, sample_rows))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.full(len(texts), model.value) if isinstance(model.value, float) else model.value.score(statistics(texts)))

    others = [F.col(f"`{c}`") for c in documents.columns if c not in ("score", "predicted")]
    found = documents.select(*others, scored(F.col(f"`{text_column}`")).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))
