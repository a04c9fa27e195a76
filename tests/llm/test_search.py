"""Vector search against brute force, with null, empty, zero, non-finite, repeated and tied vectors."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.llm import nn_descent
from verdikt.llm.vectors import blocks, unpacked
from verdikt.llm.va_file import approximation, search_block, top_k, upper_bounds

SCHEMA = "vec_id long, embedding array<float>, label int, id long"


def table(spark, vectors, odd=()):
    rows = [(i, [float(x) for x in np.float32(v)], 0, 5) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *((i, v, 0, 5) for i, v in odd)], SCHEMA)


ODD = [(9000, None), (9002, []), (9004, [float("nan")] * 8), (9006, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (9050, [None] + [1.0] * 7)]


def brute(vectors, asked, k, score):
    out = []
    for q in asked:
        s = score(vectors, vectors[q])
        order = [i for i in np.lexsort((np.arange(len(vectors)), -s)) if i != q][:k]
        out += [(q, r + 1, int(i), s[i]) for r, i in enumerate(order)]
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "wide"])
def test_va_file(spark, kind):
    draw = np.random.default_rng(1)
    x = {"normal": draw.normal(0, 0.1, (700, 8)), "ties": draw.integers(-1, 2, (700, 8)) / 256, "wide": draw.normal(0, 1, (700, 8)) * 10.0 ** draw.integers(-2, 3, (700, 1))}[kind]
    whole = np.floor(256 * np.float32(x).astype(float)).astype(int)
    df = table(spark, x, ODD)
    got = top_k(df, df.filter("vec_id % 50 = 0"), 5, block_rows=64, query_rows=4)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(brute(whole, range(0, 700, 50), 5, lambda a, q: a @ q))
    few = table(spark, x[:3])
    assert top_k(few, few, 5).count() == 6
    assert top_k(few.limit(0), few, 5).count() == 0
    low, width, cells = approximation(whole, 4)
    assert (upper_bounds(whole[:20], low, width, cells) >= whole[:20] @ whole.T).all()


@pytest.mark.parametrize("k", [5, 40])
def test_va_file_copies(k):
    """Hundreds of copies of a vector share every bound: each is read once, in a block of the production size."""
    for seed in range(10):
        draw = np.random.default_rng(seed)
        vectors = draw.integers(-60, 61, (2048, 16))
        vectors[draw.permutation(2048)[:400]] = 100
        ids = draw.permutation(10_000)[:2048]
        queries = np.r_[draw.integers(50, 100, (4, 16)), vectors[:4]]
        asked = np.r_[20_000:20_004, ids[:4]]
        for (own, got_ids, got_scores), q, query in zip(search_block(asked, queries, ids, vectors, approximation(vectors, 6), k), asked, queries, strict=True):
            scores = vectors @ query
            want = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
            assert own == q
            assert (got_ids.tolist(), got_scores.tolist()) == (ids[want].tolist(), scores[want].tolist())


def test_other_dimensions(spark):
    df = table(spark, np.ones((4, 3)), [(100, [1.0, 2.0]), (101, [2.0, 2.0])])
    got = {(r.query_id, r.vec_id): r.score for r in top_k(df, df.filter("vec_id IN (0, 100)"), 9).collect()}
    assert got == {(0, 1): 3 * 256**2, (0, 2): 3 * 256**2, (0, 3): 3 * 256**2, (100, 101): 6 * 256**2}
    near = {(r.query_id, r.vec_id) for r in nn_descent.nearest(df, F.col("vec_id") == 100, 3).collect()}
    assert near == {(100, 101)}


@pytest.mark.parametrize("clusters", [1, 12])
def test_nn_descent(spark, clusters):
    draw = np.random.default_rng(4)
    x = draw.normal(0, 1, (clusters, 24))[draw.integers(0, clusters, 2000)] * (clusters > 1) + draw.normal(0, 0.6, (2000, 24))
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True))
    x[:40] = x[0]  # copies
    df = table(spark, x, [*ODD, (9008, [0.0] * 24), (60, [float(v) for v in x[60]])])
    got = defaultdict(dict)
    for r in nn_descent.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id][r.vec_id] = (r["rank"], r.score)
    wide = x.astype(float)
    hits = 0
    for q in range(0, 2000, 20):
        s = wide @ wide[q]
        s[q] = -9
        assert len(got[q]) == 20
        ranked = sorted(got[q].items(), key=lambda e: (-e[1][1], e[0]))
        assert [e[1][0] for e in ranked] == list(range(1, 21))
        assert all(abs(s[i] - value) < 1e-12 for i, (_, value) in got[q].items())
        hits += (np.sort(-np.array([v for _, v in got[q].values()])) <= -np.sort(-s)[19] + 1e-12).sum() if False else sum(v >= np.sort(s)[-20] - 1e-12 for _, v in got[q].values())
    assert hits / 2000 >= 0.9
    assert nn_descent.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = table(spark, x[50:55])
    assert nn_descent.nearest(few, F.lit(True), 20).count() == 20


def test_nn_rare_dimension(spark):
    """Few vectors of another dimension beside many: all of them are found."""
    draw = np.random.default_rng(2)
    df = table(spark, draw.normal(0, 1, (3000, 16)), [(20 * (5000 + i), [float(x) for x in draw.normal(0, 1, 5)]) for i in range(8)])
    got = defaultdict(set)
    for r in nn_descent.nearest(df, F.col("vec_id") >= 100_000, 20).collect():
        got[r.query_id].add(r.vec_id)
    everyone = {20 * (5000 + i) for i in range(8)}
    assert got == {q: everyone - {q} for q in everyone}


@pytest.mark.parametrize("n", [1500, 4500])
def test_nn_hot(spark, n):
    """A third of all vectors are copies of one, a third stand close around another: results are those of brute force."""
    draw = np.random.default_rng(n)
    x = np.float32(draw.normal(0, 1, (n, 16)))
    x[::3] = x[0]
    x[1::3] = x[1] + np.float32(draw.normal(0, 0.05, (len(x[1::3]), 16)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]
    got = defaultdict(list)
    for r in nn_descent.nearest(table(spark, x), F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    wide, hits = x.astype(float), 0
    for q in range(0, n, 20):
        s = wide @ wide[q]
        s[q] = -9
        assert len(got[q]) == 20
        if q % 3 == 0:
            assert [v for _, v, _ in sorted(got[q])] == [i for i in range(0, 63, 3) if i != q][:20]
        hits += sum(v >= np.sort(s)[-20] - 1e-9 for _, _, v in got[q])
    assert hits / (20 * len(range(0, n, 20))) >= 0.9


@pytest.mark.parametrize("far", [1, 6])
def test_nn_far(spark, far):
    """A lone vector, or a small cluster, opposite to all others: every query gets 20 rows, and good ones."""
    draw = np.random.default_rng(far)
    x = np.ones((2000, 16)) + draw.normal(0, 0.05, (2000, 16))
    away = [100 * n for n in range(1, far + 1)]
    x[away] = -1 + draw.normal(0, 0.05, (far, 16))
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = defaultdict(list)
    for r in nn_descent.nearest(table(spark, x), F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append(r)
    wide, hits = x.astype(float), 0
    for q in range(0, 2000, 20):
        s = wide @ wide[q]
        s[q] = -9
        assert len({r.vec_id for r in got[q]}) == len(got[q]) == 20
        assert all(abs(s[r.vec_id] - r.score) < 1e-12 for r in got[q])
        hits += sum(r.score >= np.sort(s)[-20] - 1e-12 for r in got[q])
        assert q not in away or {r.vec_id for r in got[q]} >= set(away) - {q}
    assert hits / 2000 >= 0.9


def test_nn_no_structure(spark):
    """Directions all over a space of many dimensions, where neighbours of neighbours are seldom near."""
    n = 6000
    x = np.random.default_rng(6).normal(0, 1, (n, 96))
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = defaultdict(list)
    for r in nn_descent.nearest(table(spark, x), F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append(r)
    wide, hits = x.astype(float), 0
    for q in range(0, n, 20):
        s = wide @ wide[q]
        s[q] = -9
        assert [r.vec_id for r in sorted(got[q], key=lambda r: r["rank"])] == sorted((r.vec_id for r in got[q]), key=lambda i: (-next(r.score for r in got[q] if r.vec_id == i), i))
        hits += sum(r.score >= np.sort(s)[-20] - 1e-12 for r in got[q])
    assert hits / n >= 0.97


def test_scanned(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for k in (5, 400):
        got = defaultdict(list)
        for r in nn_descent.scanned(df.filter("id < 30"), df, k, block_rows=64, query_rows=16).collect():
            got[r.q].append((r.v, r.s))
        for q in range(30):
            s = x @ x[q]
            s[q] = -np.inf
            assert {v for v, _ in got[q]} == set(np.argsort(-s)[: min(k, 299)].tolist())
    bars = [(q, float(np.sort(np.delete(x @ x[q], q))[-9])) if q else (q, None) for q in range(30)]
    asked = df.join(spark.createDataFrame(bars, "id long, bar double"), "id")
    found = nn_descent.scanned(asked, df, 20, block_rows=64).groupBy("q").count().collect()
    assert {r.q: r["count"] for r in found} == {q: 9 if q else 20 for q in range(30)}


def test_blocks_are_not_broadcast(spark):
    """Copies of the queries' blocks, one for each spot, never go through the driver, and integers are packed narrowly without loss."""
    x = np.random.default_rng(3).normal(0, 1, (300, 8)) * 10.0 ** np.arange(8)
    df = table(spark, x)
    found = top_k(df, df.filter("vec_id % 50 = 0"), 5, block_rows=64, query_rows=4)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    for scale, width in ((1, 1), (100, 2), (1e5, 4), (1e12, 8)):
        whole = np.array([[-1, 0, 1], [2, -3, 100]]) * int(scale)
        row = blocks(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(whole)], "id long, v array<long>").coalesce(1), "id", "v", 8, "long").first()
        assert len(row.block) == 6 * width and (unpacked(row.block_ids, row.block, 3, np.int64)[1] == whole).all()
