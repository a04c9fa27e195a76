"""Approximate nearest neighbours by NN-descent.

Equal vectors are one node. A graph holds the k nearest found of every node. It starts from random hyperplanes' buckets,
which are split by nearness to some of their own until all within one can meet, and is improved in rounds: a vector's neighbours, and those that it is a neighbour of, are likely to be neighbours
of each other, so each vector introduces them (a join of the graph with itself through it) and everyone keeps the best.
Rounds see vectors as short integers. A query walks the graph greedily: from the best nodes it knows that it hasn't visited to
their neighbours, until its best stay the same; its results are ordered by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import bounded_batches, spread_join, written
from verdikt.llm.vectors import blocks, matrix, met_blocks, unpacked, usable

EDGES = "u long, v long, s double"
#: Vectors that meet in one place at most; the circles of much-linked vectors are dealt to several, anew in every round.
PLACE = 64
#: Members by whose nearness a large bucket is split, and how often at most: what can't be split has equal codes.
PIVOTS, SPLITS = 8, 20
#: Nodes of each dimension from which every walk starts, besides the query's own neighbours: drawn by hash from the whole graph, whatever parts it falls into.
ENTRIES = 32
#: The walks' results are measured by so many queries, drawn by hash; if they hold a smaller share of the truly nearest than this, all are checked.
MEASURED, GOOD_SHARE = 128, 0.97


def coded(vectors: DataFrame) -> DataFrame:
    """id, code (two bytes for each component: in a dense cluster one would leave the order to rounding) and scale."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim_rows in _by_dimension(batch):
                v = matrix(dim_rows.column(1), np.float64)
                scale = np.abs(v).max(1) / 32767
                codes = np.rint(v / scale[:, None]).astype(np.int16)
                yield pa.RecordBatch.from_arrays([dim_rows.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], names=["id", "code", "scale"])

    return vectors.mapInArrow(code, "id long, code binary, scale double")


def _by_dimension(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        yield batch.filter(pa.array(sizes == dim)) if (sizes != dim).any() else batch


def buckets(nodes: DataFrame, bits: dict[int, int], trees: int, seed: int) -> DataFrame:
    """place and id: each node's bucket of each tree, by the signs of random projections, as many as bits says for its
    dimension."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = batch.column(0), [np.frombuffer(c, np.int16) for c in batch.column(1).to_pylist()]
            for dim in {len(c) for c in codes}:
                rows = [i for i, c in enumerate(codes) if len(c) == dim]
                x = np.stack([codes[i] for i in rows]).astype(np.float32)
                planes = np.random.default_rng(seed).standard_normal((trees, bits[dim], dim)).astype(np.float32)
                for tree in range(trees):
                    signs = (x @ planes[tree].T > 0) @ (1 << np.arange(bits[dim]))
                    yield pa.RecordBatch.from_arrays([pa.array((dim * trees + tree) * (1 << 40) + signs.astype(np.int64)), ids.take(pa.array(rows))], names=["place", "id"])

    return nodes.select("id", "code").mapInArrow(split, "place long, id long")


def split_buckets(places: DataFrame, nodes: DataFrame, leaf: int, seed: int) -> DataFrame:
    """place and id, where places of more than leaf members are split, again and again: a member goes with the nearest of
    some members that are drawn by hash. Near ones so stay together, however many they are."""
    done: DataFrame | None = None
    for nth in range(SPLITS):
        sizes = places.groupBy("place").agg(F.count("*").alias("n"), F.array_distinct(F.array(*(F.min_by("id", F.xxhash64(F.lit(seed + PIVOTS * nth + i), "id")) for i in range(PIVOTS)))).alias("pivots"))
        sizes = written(sizes, "places")
        large = sizes.filter(F.col("n") > leaf)
        if large.isEmpty():
            break
        small = places.join(large.select("place"), "place", "left_anti")
        done = small if done is None else done.unionByName(small)
        pivots = large.select("place", F.explode("pivots").alias("id")).join(nodes.select("id", F.col("code").alias("pivot")), "id").groupBy("place").agg(F.array_sort(F.collect_list("pivot")).alias("pivots"))
        met = spread_join(places.join(nodes.select("id", "code"), "id"), pivots, ["place"], "id").select("place", "id", "code", "pivots")

        def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, pivots_, side = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
                known: dict[tuple, np.ndarray] = {}
                for code, own in zip(codes, map(tuple, pivots_), strict=True):
                    if own not in known:
                        y = np.stack([np.frombuffer(p, np.int16) for p in own]).astype(np.float32)
                        known[own] = y / np.linalg.norm(y, axis=1, keepdims=True)
                    side.append(int((known[own] @ np.frombuffer(code, np.int16).astype(np.float32)).argmax()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(side, pa.int32())], names=["place", "id", "side"])

        sides = met.mapInArrow(nearest_pivot, "place long, id long, side int")
        places = written(sides.select(F.xxhash64("place", "side").alias("place"), "id"), "split")
    return places if done is None else done.unionByName(places)


def introduced(members: DataFrame, k: int, size: int, seed: int) -> DataFrame:
    """Edges u, v, s between members that meet and aren't linked yet, as far as they beat what u has: at most the k
    best for a meeting. members: place, id, fresh, and of id code, scale, bar and known (hashes of its neighbours' ids, of
    32 bits: a new one passes for a neighbour about once in 10**8). A meeting has about size members: those of a larger
    place are dealt by hash, in every round anew; in others two members that aren't fresh have met before."""
    counts = members.groupBy("place").agg(F.count("*").alias("n"))
    dealt = members.join(counts, "place").withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "place", "id"), F.ceil(F.col("n") / size))).withColumn("fresh", F.col("fresh") | (F.col("n") > size))
    met = dealt.groupBy("place", "part").agg(F.collect_list(F.struct("id", F.hash("id").alias("mark"), "code", "scale", "bar", "known", "fresh")).alias("m")).filter(F.size("m") > 1).select("m")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten()
            at = batch.column(0).offsets.to_numpy()
            at = at - at[0]
            ids, scale, bar, fresh = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("id", "scale", "bar", "fresh"))
            codes, known, marks = flat.field("code").to_pylist(), flat.field("known"), flat.field("mark").to_numpy()
            us, vs, ss = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if len({len(c) for c in codes[a:b]}) > 1:
                    continue  # vectors of several dimensions never share a bucket or an edge
                x = np.frombuffer(b"".join(codes[a:b]), np.int16).reshape(b - a, -1).astype(np.float32)
                s = (x @ x.T).astype(float) * scale[a:b, None] * scale[None, a:b]
                out = _listed(known[a:b], marks[a:b]) | (s <= bar[a:b, None]) | (ids[a:b, None] == ids[None, a:b]) | ~(fresh[a:b, None] | fresh[None, a:b])
                s[out] = -np.inf
                if b - a > k:
                    keep = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    rows, columns = np.repeat(np.arange(b - a), k), keep.ravel()
                    good = s[rows, columns] > -np.inf
                    rows, columns = rows[good], columns[good]
                else:
                    rows, columns = np.nonzero(~out)
                us.append(ids[a:b][rows]), vs.append(ids[a:b][columns]), ss.append(s[rows, columns])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ss)], names=["u", "v", "s"])

    return met.mapInArrow(meet, EDGES)


def _listed(lists: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Whether each list (a row) holds each mark (a column)."""
    at = lists.offsets.to_numpy()
    flat, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(at))
    by = np.argsort(marks, kind="stable")
    first, last = (np.searchsorted(marks[by], flat, side) for side in ("left", "right"))
    found = np.zeros((len(lists), len(marks)), bool)
    some = last > first
    found[row[some], by[first[some]]] = True
    return found


def best(edges: DataFrame, k: int, by: str = "u", to: str = "v") -> DataFrame:
    """The k edges of each u with the largest s, ties to the smaller v; the limit is applied before rows are shuffled, too."""
    order = Window.partitionBy(by).orderBy(F.col("s").desc(), to)
    return edges.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")


def build(vectors: DataFrame, k: int = 24, trees: int = 5, leaf: int = 192, rounds: int = 6, settled: float = 0.02, seed: int = 7) -> DataFrame:
    """The graph: u, v, s (about their inner product), at most k edges for each u. vectors: id and v, distinct ids.

    Ends when a round brings fewer than a share of settled new edges, or after so many rounds. All vectors of a dimension
    that has no more than leaf of them meet at the start.
    """
    nodes = written(coded(vectors), "codes")
    dims = {r.dim: r.n for r in nodes.groupBy((F.octet_length("code") / 2).cast("int").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    bits = {dim: int(np.ceil(np.log2(n / leaf))) if n > leaf else 0 for dim, n in dims.items()}
    low, nobody = F.lit(float("-inf")), F.array().cast("array<int>")
    places = split_buckets(written(buckets(nodes, bits, trees, seed), "buckets"), nodes, leaf, seed)
    start = places.join(nodes, "id").select("place", "id", "code", "scale", low.alias("bar"), nobody.alias("known"), F.lit(True).alias("fresh"))
    first = introduced(start, k, leaf, seed).groupBy("u", "v").agg(F.max("s").alias("s"))
    graph = written(best(first, k).withColumn("fresh", F.lit(True)), "graph")
    for nth in range(rounds):
        linked = graph.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") >= k, F.min("s")).otherwise(low).alias("bar"), F.collect_list(F.hash("v")).alias("known"))
        known = nodes.join(linked, "id", "left").select("id", "code", "scale", F.coalesce("bar", low).alias("bar"), F.coalesce("known", nobody).alias("known"))
        both = graph.select(F.col("u").alias("place"), F.col("v").alias("id"), "fresh").union(graph.select("v", "u", "fresh")).groupBy("place", "id").agg(F.bool_or("fresh").alias("fresh"))
        found = introduced(both.join(known, "id"), k, PLACE, seed + nth + 1)
        merged = graph.select("u", "v", "s", F.lit(False).alias("fresh")).union(found.select("u", "v", "s", F.lit(True))).groupBy("u", "v").agg(F.max("s").alias("s"), F.bool_and("fresh").alias("fresh"))
        graph = written(best(merged, k), "graph")
        fresh = graph.agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("all")).first()
        if fresh["fresh"] <= settled * fresh["all"]:
            break
    return graph.select("u", "v", "s")


def exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """q, v, s: exact inner products of pairs q, v in double precision."""
    rows = pairs.select("q", "v").join(queries.select(F.col("id").alias("q"), F.col("v").alias("x")), "q").join(vectors.select(F.col("id").alias("v"), F.col("v").alias("y")), "v")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dimension(batch.select(["q", "x", "v", "y"])):
                s = np.einsum("ij,ij->i", matrix(part.column(1), np.float64), matrix(part.column(3), np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s)], names=["q", "v", "s"])

    return rows.mapInArrow(product, "q long, v long, s double")


def walk(graph: DataFrame, queries: DataFrame, vectors: DataFrame, pool: int = 40, width: int = 24, rounds: int = 6) -> DataFrame:
    """q, v, s: for each query (id, v; nodes of the graph) the pool's best nodes by exact product. Starts from the
    query's own neighbours and from ENTRIES; each round visits the best width unvisited nodes of the pool, and the walk ends when no
    query's pool has one left, or after so many rounds."""
    ways = graph.select(F.col("u").alias("node"), F.col("v").alias("next"))
    first = graph.join(queries.select(F.col("id").alias("u")), "u").select(F.col("u").alias("q"), "v")
    drawn = vectors.select("id", F.size("v").alias("dim")).withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))).filter(F.col("nth") <= ENTRIES)
    entries = queries.select(F.col("id").alias("q"), F.size("v").alias("dim")).join(drawn.select("dim", F.col("id").alias("v")), "dim").filter("q <> v").select("q", "v")
    first = first.unionByName(entries).distinct()
    state = written(best(exact(first, queries, vectors), pool, "q").withColumn("visited", F.lit(False)), "pool")
    for _ in range(rounds):
        front = best(state.filter("NOT visited"), width, "q").select("q", F.col("v").alias("node"))
        near = front.join(ways, "node").filter(F.col("next") != F.col("q")).select("q", F.col("next").alias("v")).distinct()
        new = near.join(state.select("q", "v"), ["q", "v"], "left_anti")
        scored = exact(new, queries, vectors).withColumn("visited", F.lit(False))
        seen = state.join(front.withColumn("now", F.lit(True)).withColumnRenamed("node", "v"), ["q", "v"], "left").select("q", "v", "s", (F.col("visited") | F.coalesce("now", F.lit(False))).alias("visited"))
        state = written(best(seen.union(scored), pool, "q"), "pool")
        if state.filter("NOT visited").isEmpty():
            break
    return state.select("q", "v", "s")


def scanned(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = 2048, query_rows: int = 512) -> DataFrame:
    """q, v, s: the k best of all vectors of its dimension for each query (id, v and perhaps bar), itself left out, by products of
    blocks. With a bar, the k-th best that a query has found, only what is as near leaves a block."""
    more = k + 16  # products of blocks differ from the exact ones in the last bits
    lowest = F.lit(-float(np.finfo(np.float64).max))
    bar = F.coalesce(F.col("bar"), lowest) if "bar" in queries.columns else lowest

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim, q_ids, q_block, v_ids, block = (batch.column(i)[row].as_py() for i in range(5))
                asked_ids, query = unpacked(q_ids, q_block, dim, np.float64)
                ids, rows = unpacked(v_ids, block, dim, np.float64)
                query, least, rows = query[:, :-1], query[:, -1], rows[:, :-1]
                s = query @ rows.T
                slack = 1e-12 * np.linalg.norm(query, axis=1) * np.linalg.norm(rows, axis=1).max()
                s[(s < (least - slack)[:, None]) | (asked_ids[:, None] == ids[None])] = -np.inf
                of, chosen = np.nonzero(s > -np.inf)
                if len(of) and np.bincount(of).max() > more:
                    keep = np.argpartition(-s, more - 1, axis=1)[:, :more]
                    of, chosen = np.repeat(np.arange(len(asked_ids)), more), keep.ravel()
                    real = s[of, chosen] > -np.inf
                    of, chosen = of[real], chosen[real]
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[of]), pa.array(ids[chosen]), pa.array(s[of, chosen])], names=["q", "v", "s"])

    # a component more, in which queries hold their bars and vectors nothing
    held, asked = vectors.select("id", F.concat("v", F.array(F.lit(0.0))).alias("v")), queries.select("id", F.concat("v", F.array(bar)).alias("v"))
    met = met_blocks(blocks(held, "id", "v", block_rows), blocks(asked, "id", "v", query_rows))
    found = best(met.mapInArrow(search, "q long, v long, s double"), more, "q")
    return best(exact(found, queries, vectors), k, "q")


def found_share(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, measured: int = MEASURED) -> float:
    """The share of the truly nearest k that found (q, v, s) holds, by brute force for some queries, so linear in vectors."""
    some = written(queries.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(measured), "measured")
    true = scanned(some, vectors, k).groupBy("q").agg(F.min("s").alias("least"), F.count("*").alias("n"))
    near = F.col("s") >= F.col("least") - 1e-12 * F.abs("least")
    share = found.join(F.broadcast(true.drop("n").withColumnRenamed("q", "id")), F.col("q") == F.col("id")).groupBy("q").agg(F.count_if(near).alias("hits"))  # measured rows at most
    got = true.join(share, "q", "left").agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return (got["hits"] or 0) / got["n"] if got["n"] else 1.0


def nearest(embeddings: DataFrame, asked: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", graph_k: int = 24, pool: int = 48, **options: float) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which asked holds, the k nearest that were found, by exact inner
    product in double precision, ties to the smaller id; all others if there are no more than that.

    Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part; vectors meet
    those of their own dimension. Rows with an id count once, with their least vector. Equal vectors are one node of the
    graph, which stands for its least ids, so any number of copies is found whole; an empty table gives no rows.
    A graph may fall into parts (a far small cluster, a lone vector): walks start in all of it, and a query whose walk
    still ends with too few is compared with all vectors, block by block. Where neighbours of neighbours are no neighbours (many
    directions, none of them rare), walks miss more the more vectors there are: what they found is measured against brute
    force for a bounded sample of queries, and below GOOD_SHARE all queries are checked, with the k-th best that
    each has found as the bar. That check's time is the product of queries and vectors, its rows are few.
    """
    bounded_batches(embeddings.sparkSession)
    source = embeddings.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = source.filter(F.col("id").isNotNull() & usable(F.col("v"), nonzero=True))
    once = rows.groupBy("id").agg(F.min("v").alias("v"), F.bool_or("asked").alias("asked"))
    vectors = written(once.select("id", "v", "asked", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")), "vectors")
    same = ["h1", "h2"]
    nodes = written(vectors.groupBy(*same).agg(F.min("id").alias("node"), F.first("v").alias("v"), F.bool_or("asked").alias("asked"), F.count("*").alias("copies")), "nodes")
    distinct = nodes.select(F.col("node").alias("id"), "v")
    queries = nodes.filter("asked").select(F.col("node").alias("id"), "v")
    graph = build(distinct, max(graph_k, k), **options)
    found = written(walk(graph, queries, distinct, max(pool, k)), "found")
    # who has found fewer than there are, up to k besides itself, is compared with all
    copies = nodes.select(F.col("node").alias("v"), F.least("copies", F.lit(k + 1)).alias("copies"), F.size("v").alias("dim"))
    whole = copies.groupBy("dim").agg(F.least(F.sum("copies"), F.lit(k + 1)).alias("there"))
    asking = queries.select(F.col("id").alias("q"), F.size("v").alias("dim")).join(whole, "dim")
    have = found.select("q", "v").unionByName(queries.select(F.col("id").alias("q"), F.col("id").alias("v"))).join(copies.drop("dim"), "v").groupBy("q").agg(F.sum("copies").alias("have"))
    lacking = written(asking.join(have, "q").filter("have < there").select(F.col("q").alias("id")), "lacking")
    if found_share(found, queries, distinct, k) < GOOD_SHARE:
        bars = best(found, k, "q").groupBy(F.col("q").alias("id")).agg(F.when(F.count("*") >= k, F.min("s")).alias("bar"))
        again = scanned(queries.join(bars, "id", "left"), distinct, k)
        found = best(found.unionByName(again).groupBy("q", "v").agg(F.max("s").alias("s")), max(pool, k), "q")
    elif not lacking.isEmpty():
        again = scanned(queries.join(lacking, "id", "left_semi"), distinct, k)
        found = found.join(lacking, F.col("q") == F.col("id"), "left_anti").unionByName(again)
    found = found.unionByName(exact(queries.select(F.col("id").alias("q"), F.col("id").alias("v")), queries, distinct))

    # each node stands for its k + 1 least ids: a query among them leaves k; that limit comes before rows are shuffled
    least = vectors.select("id", *same).withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("id"))).filter(F.col("nth") <= k + 1)
    members = least.join(nodes.select(*same, F.col("node").alias("v")), same).select("v", "id")
    ranked = lambda by: Window.partitionBy(by).orderBy(F.col("s").desc(), "id")
    top = found.join(members, "v").withColumn("nth", F.row_number().over(ranked("q"))).filter(F.col("nth") <= k + 1).groupBy("q").agg(F.collect_list(F.struct("id", "s")).alias("top"))
    asking = spread_join(vectors.filter("asked").select(F.col("id").alias("query_id"), *same), nodes.select(*same, F.col("node").alias("q")), same, "query_id")
    near = spread_join(asking.select("query_id", "q"), top, ["q"], "query_id").select("query_id", F.inline("top")).filter("query_id <> id")
    return near.withColumn("rank", F.row_number().over(ranked("query_id"))).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("s").alias("score"))
