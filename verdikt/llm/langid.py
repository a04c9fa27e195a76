"""Language identification by hierarchical discrimination.

Texts become counts of hashed byte n-grams of all their bytes. A softmax classifier tells the language family; within a
family, one linear support vector machine for each pair of its languages votes. Both are trained on a bounded sample of
labelled rows, a fixed number for each language, chosen by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.llm.common import bounded_batches, chunks, utf8

#: Families of languages by code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af fy lb da sv no nb nn is fo",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi ur bn pa gu mr ne",
    "iranian": "fa ku ps",
    "semitic": "ar he am mt",
    "celtic": "ga gd cy br",
    "malayic": "id ms",
}
UNKNOWN = "und"
GRAMS = (2, 3, 4)

#: Bytes as the features see them: letters lower-cased, bytes of other scripts as they are, all else a blank.
_SEEN = np.zeros(256, np.int64)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language.lower().split("-")[0] in codes.split()), f"only {language}")


def features(data: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """A row for each text: roots of its n-gram counts, of unit length (all zero for an empty text)."""
    n, size = len(at) - 1, 1 << bits
    seen, at = _SEEN[data[at[0] : at[-1]]], at - at[0]
    counts = np.zeros(n * size)
    row = np.repeat(np.arange(n) * size, np.diff(at))
    code = seen
    for k in range(1, max(GRAMS)):
        code = (code[:-1] << 8) | seen[k:]
        if k + 1 in GRAMS and len(code):
            inside = row[k:] == row[:-k]
            hashed = ((code * (2 * k + 1) * 0x2545F4914F6CDD1D) >> (63 - bits)) & (size - 1)
            counts += np.bincount((row[k:] + hashed)[inside], minlength=n * size)
    roots = np.sqrt(counts).reshape(n, size)
    return roots / np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-9)


def groups(at: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose features take 8 MB at most."""
    most = max(1, (1 << 20) >> bits)
    for a, b in chunks(at):
        for i in range(a, b, most):
            yield i, min(b, i + most)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _largest(x: np.ndarray, share: np.ndarray) -> float:
    """The largest eigenvalue of the weighted second moments, by power iteration: what a gradient step must stay below."""
    v = np.ones(x.shape[1], np.float32)
    value = 1.0
    for _ in range(15):
        v = x.T @ (share * (x @ v))
        value = float(np.linalg.norm(v)) or 1.0
        v /= np.float32(value)
    return 1.1 * value


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 120, penalty: float = 1e-4) -> np.ndarray:
    """Weights (a column for each class) of multinomial logistic regression, classes weighing the same; accelerated
    gradient descent. All in single precision, like x, so that no product makes a wider copy of x."""
    share = (1 / np.bincount(y, minlength=classes)[y] / classes).astype(np.float32)
    step = 1 / (0.5 * _largest(x, share) + penalty)
    target = np.eye(classes, dtype=np.float32)[y]
    w = v = np.zeros((x.shape[1], classes), np.float32)
    for t in range(rounds):
        new = v - step * (x.T @ ((_softmax(x @ v) - target) * share[:, None]) + penalty * v)
        v, w = new + t / (t + 3) * (new - w), new
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 120, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss; y: 1 and -1, which weigh the same. Scaled so
    that half of the rows lie beyond a margin of 1."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (2 * _largest(x, share) + penalty)
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (-2 * x.T @ (share * y * slack) + penalty * v)
        v, w = new + t / (t + 3) * (new - w), new
    return w / (float(np.median(np.abs(x @ w))) or 1.0)


class Classifier:
    """Families, the softmax between them and the machines within. x, in single precision, is centred in place."""

    def __init__(self, x: np.ndarray, languages: list[str]) -> None:
        self.bits = int(x.shape[1]).bit_length() - 1
        self.languages = sorted(set(languages))
        self.families = sorted({family_of(c) for c in self.languages})
        self.members = [[c for c in self.languages if family_of(c) == f] for f in self.families]
        named = np.array(languages)
        family = np.array([self.families.index(family_of(c)) for c in languages])
        self.mean = x.mean(0)
        x -= self.mean
        self.between = fit_softmax(x, family, len(self.families)) if len(self.families) > 1 else None
        self.within: dict[tuple[str, str], np.ndarray] = {}
        for members in self.members:
            for a, b in combinations(members, 2):
                rows = (named == a) | (named == b)
                self.within[a, b] = fit_svm(x[rows], np.where(named[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each row and how sure it is, 0 to 1: the family's share times the mean of the winner's votes."""
        x = x - self.mean
        share = _softmax(x @ self.between) if self.between is not None else np.ones((len(x), 1))
        family = share.argmax(1)
        language, score = np.full(len(x), UNKNOWN, object), share.max(1)
        for k, members in enumerate(self.members):
            rows = np.flatnonzero(family == k)
            votes, wins = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                margin = x[rows] @ self.within[a, b]
                sure = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
                votes[:, i] += sure
                votes[:, j] += 1 - sure
                wins[:, i] += margin >= 0
                wins[:, j] += margin < 0
            best = (wins + votes / (2 * len(members))).argmax(1)  # most duels won; ties by the sum of votes
            language[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= votes[np.arange(len(rows)), best] / (len(members) - 1)
        return language, score


def fit(labelled: DataFrame, per_language: int = 800, bits: int = 12, most_languages: int = 60) -> Classifier | None:
    """A classifier from text and lang of the rows (nulls take no part), of which at most per_language for each
    language, chosen by hash, are looked at: whole texts, whose features alone go to the driver. Equal rows count once.
    None without rows. More languages than most_languages are refused, as the driver holds that sample's features."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''").select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages: set most_languages if the driver may hold {per_language} rows of each")
    sizes = {r.lang: r.n for r in found}
    if not sizes:
        return None
    cut = F.lit(None).cast("long")
    for language, n in sizes.items():  # a part of the range of hashes that holds a little more than is wanted
        part = min(1.0, 1.25 * per_language / n + 20 / n)
        cut = F.when(F.col("lang") == language, F.lit(int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1)).otherwise(cut)
    chosen = rows.filter(F.col("h") <= cut).dropDuplicates(["h"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            for a, b in groups(at, bits):
                x = features(data, at[a : b + 1], bits).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "x"])

    found = chosen.select("text", "lang", "h").mapInArrow(look, "lang string, h long, x binary").toArrow()
    order, languages, rows_ = np.argsort(found["h"].to_numpy(), kind="stable"), found["lang"].to_pylist(), found["x"]
    taken, kept = dict.fromkeys(sizes, 0), []
    for i in order.tolist():
        if taken[languages[i]] < per_language:
            taken[languages[i]] += 1
            kept.append(i)
    x = np.empty((len(kept), 1 << bits), np.float32)
    for to, i in enumerate(kept):
        x[to] = np.frombuffer(rows_[i].as_buffer(), np.float16)
    del found, rows_
    return Classifier(x, [languages[i] for i in kept])


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(documents: DataFrame, classifier: Classifier | None, text_column: str = "text") -> DataFrame:
    """The rows of documents with lang_pred and score, which replace columns of these names. Only the text is looked at.
    Null texts and texts without a letter, and all texts if nothing was learnt, get ``und`` and 0."""
    bounded_batches(documents.sparkSession)
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(classifier)  # of a fixed size for each pair of languages

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(kept.index(text_column))
            data, at = utf8(column)
            names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            for a, b in groups(at, model.bits) if model else ():
                part = data[at[a] : at[b]]
                ascii_letters = np.r_[0, np.cumsum((_SEEN[part] > 0) & (part < 128))]
                letters = np.diff(ascii_letters[at[a : b + 1] - at[a]]) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = _has_letter(column[a + i].as_py() or "")
                language, score = model.predict(features(data, at[a : b + 1], model.bits).astype(np.float32))
                names[a:b] = np.where(letters, language, UNKNOWN)
                scores[a:b] = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    inner = documents.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*inner.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(label, schema)


def identify(documents: DataFrame, held_out: Column, text_column: str = "text", per_language: int = 800) -> DataFrame:
    """documents with lang_pred and score, by a classifier fitted to the rows that held_out (null: false) leaves."""
    rest = documents.filter(~F.coalesce(held_out, F.lit(False))).select(F.col(f"`{text_column}`").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(documents, fit(rest, per_language), text_column)
