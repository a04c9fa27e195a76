"""Circles in graphs kept as tables, as expressions and their children: by recursion over written tables.

Nodes are numbered first, so that only numbers are shuffled again and again. In large graphs a third of a chain's nodes, about,
is spliced out at a time, so that what is left to shuffle falls by a third each time and all of it together is no more than a
few times the edges. What can't lie on a circle is raked off (nodes that nothing leads to, or that lead nowhere), and chains of nodes with one way in
and one way out are compressed to one edge by pointer doubling, again and again: a long chain or a deep tree takes a few
rounds, not one for each step. What stays is a core of knots, whose strongly connected parts are found by least labels
carried forward and then back. Then compressed nodes get their edge's part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.tables import written


def _raked(edges: DataFrame) -> DataFrame:
    """Edges u, v whose u has a way in and whose v has a way out."""
    starts, ends = edges.select(F.col("u").alias("x")).distinct(), edges.select(F.col("v").alias("x")).distinct()
    return edges.join(ends, edges.u == F.col("x"), "left_semi").join(starts, edges.v == F.col("x"), "left_semi")


def _through(edges: DataFrame) -> DataFrame:
    """node, from and to of nodes with one way in and one way out, to others than themselves."""
    out = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min("v").alias("to")).filter("n = 1 AND to <> node")
    in_ = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("m"), F.min("u").alias("from")).filter("m = 1 AND from <> node")
    return out.join(in_, "node").select("node", "from", "to")


def _chained(through: DataFrame) -> DataFrame:
    """node, start, end, least and closed: the nodes before and after each node's chain, found by doubling; on a chain
    that closes upon itself, least is its least node."""
    own = through.select(F.col("node").alias("n"))
    state = through.join(own, F.col("to") == F.col("n"), "left").select("node", "from", F.col("to").alias("end"), F.col("node").alias("least"), F.col("n").isNull().alias("ended"))
    state = state.join(own, F.col("from") == F.col("n"), "left").select("node", F.col("from").alias("start"), "end", "least", "ended", F.col("n").isNull().alias("started"))
    state = written(state, "chains")
    longest, steps = state.count(), 1
    while steps <= longest:  # chains are no longer than that, and most end far earlier
        ahead = state.select(F.col("node").alias("a"), F.col("end").alias("a_end"), F.col("least").alias("a_least"), F.col("ended").alias("a_ended"))
        behind = state.select(F.col("node").alias("b"), F.col("start").alias("b_start"), F.col("started").alias("b_started"))
        moved = state.join(ahead, ~F.col("ended") & (F.col("end") == F.col("a")), "left").join(behind, ~F.col("started") & (F.col("start") == F.col("b")), "left")
        state = written(
            moved.select("node", F.coalesce("b_start", "start").alias("start"), F.coalesce("a_end", "end").alias("end"), F.least("least", F.coalesce("a_least", "least")).alias("least"), F.coalesce("a_ended", "ended").alias("ended"), F.coalesce("b_started", "started").alias("started")),
            "chains",
        )
        steps *= 2
        if state.filter("NOT (ended AND started)").isEmpty():
            break
    return state.select("node", "start", "end", "least", (~F.col("ended")).alias("closed"))


def _carried(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) where each node has the least label of all from which edges (u, v) lead to it."""
    while True:
        brought = edges.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("label").alias("brought"))
        step = written(labels.join(brought, F.col("node") == F.col("v"), "left").select("node", F.least("label", F.coalesce("brought", "label")).alias("label"), (F.col("brought") < F.col("label")).alias("changed")), "labels")
        labels = step.select("node", "label")
        if step.filter("changed").isEmpty():
            return labels


def _parts(edges: DataFrame) -> DataFrame:
    """node and part (a node of its strongly connected part) for the nodes of the core that lie on a circle with others.

    Nodes that share the least node which leads to them are one colour; those of a colour that lead to that node are its
    part. Least is by hash, so that parts in a row fall into several colours. Labels go one edge a round: the rounds grow
    with the ways within what raking and compressing leave.
    """
    found = None
    while not edges.isEmpty():
        nodes = written(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("of"))), "nodes")
        colour = _carried(nodes, edges)
        of = lambda side: colour.select(F.col("node").alias(f"{side}_"), F.col("label").alias(f"{side}c"))  # noqa: E731, B023
        within = written(edges.join(of("u"), F.col("u") == F.col("u_")).join(of("v"), F.col("v") == F.col("v_")).filter("uc = vc").select("u", "v", F.col("uc").alias("c")), "coloured")
        reached = written(colour.filter("node = label.of").select("node", F.col("label").alias("c")), "reached")
        front = reached
        while not front.isEmpty():
            back = within.join(front, (F.col("v") == F.col("node")) & (within.c == front.c), "left_semi").select(F.col("u").alias("node"), "c").distinct()
            front = written(back.join(reached, ["node", "c"], "left_anti"), "front")
            reached = written(reached.unionByName(front), "reached")
        own = reached.join(reached.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1"), "c").select("node", F.col("c.of").alias("part"))
        found = own if found is None else found.unionByName(own)
        gone = reached.select("node")
        left = edges.join(gone, edges.u == gone.node, "left_anti").join(gone, edges.v == gone.node, "left_anti")
        edges = written(left, "edges")
        while True:
            raked = written(_raked(edges), "edges")
            if raked.count() == edges.count():
                break
            edges = raked
    return found


#: Above so many edges, chains are spliced until a share of the edges is left; doubling moves all nodes in each round.
SPLICED_OVER, SPLICED_TO = 1 << 16, 1 / 16


def _spliced(edges: DataFrame, nth: int) -> tuple[DataFrame, DataFrame]:
    """edges without some nodes that have one way in and one way out, each of which is bridged by an edge, and node, start
    and end of those. No two of them are neighbours: a node goes if its hash is less than that of the nodes on both sides."""
    h = lambda c: F.xxhash64(F.lit(nth), c)
    out = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("end"), F.max("v").alias("other")).filter("end = other").drop("other")
    in_ = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("start"), F.max("u").alias("other")).filter("start = other").drop("other")
    links = written(out.join(in_, "node").filter((h("node") < h("start")) & (h("node") < h("end"))).select("node", "start", "end"), "compressed")
    gone, ahead = links.select(F.col("node").alias("x")), links.select(F.col("node").alias("x"), "end")
    left = edges.join(gone, edges.u == gone.x, "left_anti").join(ahead, F.col("v") == F.col("x"), "left").select("u", F.coalesce("end", "v").alias("v"))
    return written(left, "edges"), links


def circles(edges: DataFrame) -> DataFrame:
    """node and circle for every node of edges (u, v, of one type) that some way leads back to itself. circle is the least node of
    its strongly connected part, so each circle, with all that are knotted with it, has one name.

    Null ends are dropped, repeated edges count once, an empty table gives none.
    """
    kind = edges.schema["u"].dataType.simpleString()
    edges = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    names = written(edges.select(F.col("u").alias("name")).distinct().withColumn("id", F.monotonically_increasing_id()), "names")  # a node without a way out is on no circle
    number = lambda side: names.select(F.col("name").alias(f"{side}_"), F.col("id").alias(f"{side}n"))
    whole = written(edges.join(number("u"), F.col("u") == F.col("u_")).select("un", "v").join(number("v"), F.col("v") == F.col("v_")).select(F.col("un").alias("u"), F.col("vn").alias("v")).distinct(), "edges")
    own = whole.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("part"))  # also a circle alone
    edges, n = written(whole.filter("u <> v"), "edges"), -1
    closed, compressed, loops = None, [], own
    first = size = edges.count()
    while size > max(SPLICED_OVER, SPLICED_TO * first):
        before, (bridged, links) = size, _spliced(edges, len(compressed))
        compressed.append(links)
        loops = loops.unionByName(bridged.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("part")))
        edges = bridged.filter("u <> v")
        size = edges.count()
        if size > 0.9 * before:
            break
    edges = written(edges.distinct(), "edges") if compressed else edges
    while (size := edges.count()) and (n < 0 or size < 0.8 * n):  # what is left then is for the core
        n = size
        edges = _raked(written(_raked(edges), "edges"))
        edges = written(edges, "edges")
        chains = written(_chained(_through(edges)), "compressed")
        if chains.isEmpty():
            continue
        rings = chains.filter("closed").select("node", F.col("least").alias("part"))
        closed = rings if closed is None else closed.unionByName(rings)
        links = chains.filter("NOT closed")
        compressed.append(links)
        kept = edges.join(chains.select("node"), F.col("u") == F.col("node"), "left_anti").join(chains.select("node"), F.col("v") == F.col("node"), "left_anti")
        bridged = written(kept.unionByName(links.select(F.col("start").alias("u"), F.col("end").alias("v"))).distinct(), "edges")
        loops = loops.unionByName(bridged.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("part")))
        edges = written(bridged.filter("u <> v"), "edges")
    core = _parts(edges)
    known = core if core is not None else whole.select(F.col("u").alias("node"), F.col("u").alias("part")).limit(0)
    known = known if closed is None else known.unionByName(closed)
    single = lambda rows: loops.distinct().join(rows.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti")
    known = written(known, "parts")
    for links in reversed(compressed):
        # a chain lies on a circle if both its ends do in one part; an end may be known only as a circle alone
        with_single = known.unionByName(single(known))
        part = lambda side: with_single.select(F.col("node").alias(f"{side}_"), F.col("part").alias(f"{side}_part"))  # noqa: E731, B023
        inner = links.join(part("start"), F.col("start") == F.col("start_")).join(part("end"), F.col("end") == F.col("end_")).filter("start_part = end_part")
        ends = inner.filter("start = end").select(F.col("start").alias("node"), F.col("start_part").alias("part")).distinct()
        fresh = ends.join(known.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti")
        known = written(known.unionByName(inner.select("node", F.col("start_part").alias("part"))).unionByName(fresh), "parts")
    known = known.unionByName(single(known))
    named = written(known.join(names, F.col("node") == F.col("id")).select("name", "part"), "named")
    least = named.groupBy("part").agg(F.min("name").alias("circle"))
    return named.join(least, "part").select(F.col("name").cast(kind).alias("node"), "circle")


def circular_expressions(expressions: DataFrame) -> DataFrame:
    """rule_id, circle (its least node) and nodes (how many are on it) of circles in expressions (rule_id, node_id, children)."""
    end = lambda node: F.struct(F.col("rule_id").alias("rule_id"), node.alias("node_id"))
    edges = expressions.select("rule_id", "node_id", F.explode("children").alias("child")).select(end(F.col("node_id")).alias("u"), end(F.col("child")).alias("v"))
    return circles(edges).groupBy("circle").agg(F.count("*").alias("nodes")).select(F.col("circle.rule_id").alias("rule_id"), F.col("circle.node_id").alias("circle"), "nodes")
