"""Quality: statistics against plain Python, trees against a walk of each row, and accuracy on held-out labels."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_texts, words
from verdikt.llm import quality
from verdikt.llm.common import CAPITALS, WHITE
from verdikt.llm.queries import op12_boosted_quality

LOWER = str.maketrans(CAPITALS, CAPITALS.lower())


def plain(text):
    text = text or ""
    found = re.findall(f"[^{WHITE}]+", text)
    low = [w.translate(LOWER) for w in found]
    lines = [x for x in ([w for w in re.findall(f"[^{WHITE}]+", line)] for line in text.split("\n")) if x]
    n, p, k = max(1, len(found)), max(1, len(text)), max(1, len(lines))
    mean = sum(map(len, found)) / n
    share = lambda pattern: len(re.findall(pattern, text)) / p
    return {
        "log points": np.log1p(len(text)), "log words": np.log1p(len(found)), "word length": mean, "spread of word length": np.sqrt(max(0, sum(len(w) ** 2 for w in found) / n - mean**2)),
        "lower": share("[a-z]"), "capitals": share("[A-Z]"), "digits": share("[0-9]"), "white": share(r"[ \t\x0b-\r]"), "line feeds": share("\n"), "ends": share("[.!?]"), "marks": share(r"[,;:'\"()-]"), "symbols": share(r"[#$%&*+/<=>@\[\\\]^_`{|}~]"), "non-ASCII": share(r"[^\0-\x7f]"),
        "short words": sum(len(w) <= 2 for w in found) / n, "long words": sum(len(w) >= 10 for w in found) / n, "repeated words": sum(a == b for a, b in zip(low, low[1:])) / n, "distinct words": len(set(low)) / n, "top word": max(Counter(low).values(), default=0) / n,
        "words a line": len(found) / k, "ended lines": sum(x[-1][-1] in ".!?" for x in lines) / k, "opened lines": sum(x[0][0] in CAPITALS for x in lines) / k, "distinct lines": len({tuple(w.translate(LOWER) for w in x) for x in lines}) / k,
        "marked words": sum(bool(re.search(r"[^A-Za-z0-9\x80-\U0010ffff]", w)) for w in found) / n, "capitalised words": sum(w[0] in CAPITALS for w in found) / n,
    }


def test_statistics():
    texts = [t for t in odd_texts() if len(t or "") < quality.STRETCH // 4] + ["One two.\nOne two.\n\n three ", "é É ß$ x"]
    got = quality.statistics(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        values = dict(zip(quality.STATISTICS, row, strict=True))
        for name, value in plain(text).items():
            assert values[name] == pytest.approx(value, abs=1e-12), (name, text)
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(got, alone)


def test_long_texts(monkeypatch):
    text = " ".join(words(5, 30_000))
    whole = {**plain(text)}
    row = dict(zip(quality.STATISTICS, quality.statistics(pa.array([text, "a", "x" * 100_000, "é" * 70_001]))[0], strict=True))
    for name in ("log points", "log words", "word length", "lower", "white", "short words", "long words", "repeated words", "spread of word length"):
        assert row[name] == pytest.approx(whole[name], abs=1e-9)


def test_trees():
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(size=(1500, 6)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 3] > 0.2)).astype(float)
    forest = quality.fit_forest(x[:1000], y[:1000], np.ones(1000), draw.random(1000) < 0.2)
    leaves, inner = 1 << forest.depth, (1 << forest.depth) - 1
    for row, margin in zip(x[:200], forest.margin(x[:200]), strict=True):
        total = forest.base
        for tree in range(len(forest.leaf) // leaves):
            node = 0
            while node < inner:
                node = 2 * node + 1 + (row[forest.feature[tree * inner + node]] > forest.cut[tree * inner + node])
            total += forest.leaf[tree * leaves + node - inner]
        assert total == pytest.approx(margin)
    assert ((forest.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.9


def test_odd_rows(spark, documents, nothing):
    texts = [(n, ("Fine words go here and there today. " if n % 3 else "$$ || ## ") * (1 + n % 7) + str(n)) for n in range(200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("__id", F.lit(2))
    labels = spark.createDataFrame([(n, int(n % 3 > 0), 0) for n in range(150)] + [(3, 1, 0), (4, 7, 0), (None, 0, 1), (5, None, 1), (9999, 0, 0)] + [(6, 0, 0)] * 50, "doc_id long, quality int, toxic int")
    scored = quality.score_quality(rows, labels, F.col("doc_id") % 5 == 0)
    assert scored.columns == ["doc_id", "text", "y", "__id", "score", "predicted"]
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == 200 and all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    assert all(got[n].predicted == (n % 3 > 0) for n in range(150, 200))
    held = F.lit(False)
    odd = quality.score_quality(documents, labels, held)
    assert odd.columns == [*documents.columns, "score", "predicted"] and odd.count() == documents.count() and not odd.filter("score IS NULL OR isnan(score)").count()
    assert quality.score_quality(nothing, labels, held).collect() == []
    assert {r.score for r in quality.score_quality(rows, labels.limit(0), held).collect()} == {0.5}
    assert {r.score for r in quality.score_quality(rows, labels.filter("quality = 1"), held).collect()} == {1.0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op12_boosted_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
