"""Circles in tables against a search in memory."""

import random

import pytest

from verdikt.operators.cycles import circles, circular_expressions


def parts(edges):
    """Node: least node of its strongly connected part, for nodes on circles."""
    after = {}
    for u, v in edges:
        after.setdefault(u, set()).add(v)

    def reach(node):
        seen, stack = set(), list(after.get(node, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += after.get(x, ())
        return seen

    reached = {n: reach(n) for e in edges for n in e}
    return {n: min(m for m in own if n in reached[m]) for n, own in reached.items() if n in own}


def check(spark, edges):
    rows = circles(spark.createDataFrame(edges, "u int, v int")).collect()
    assert {r.node: r.circle for r in rows} == parts([e for e in edges if None not in e]) and len(rows) == len({r.node for r in rows})


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3)], [(1, 1)], [(1, 2), (2, 1)], [(3, 1), (1, 2), (2, 3), (3, 9), (8, 1)], [(1, 1), (1, 2), (2, 3), (3, 1)], [(1, 2), (2, 2), (2, 3)], [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 4), (5, 1)],
        [(n, n + 1) for n in range(150)] + [(150, 140), (90, 60), (None, 3), (3, None), (5, 6)], [(n, n + 1) for n in range(70)] + [(70, 0), (20, 20), (30, 90), (90, 91), (91, 31)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 5)],
    ],
)
def test_small(spark, edges):
    check(spark, edges)


@pytest.mark.parametrize(("seed", "nodes", "links"), [(1, 40, 36), (2, 40, 44), (3, 60, 75), (4, 25, 60)])
def test_random(spark, seed, nodes, links):
    draw = random.Random(seed)
    check(spark, [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(links)])


def test_expressions(spark):
    rows = [("R1", "A", ["B", "C"]), ("R1", "B", ["A"]), ("R1", "C", []), ("R2", "A", ["B"]), ("R2", "B", []), ("R3", "Z", ["Z"])]
    got = circular_expressions(spark.createDataFrame(rows, "rule_id string, node_id string, children array<string>")).collect()
    assert {tuple(r) for r in got} == {("R1", "A", 2), ("R3", "Z", 1)}
    assert circular_expressions(spark.createDataFrame([], "rule_id string, node_id string, children array<string>")).collect() == []


def test_splicing(spark, monkeypatch):
    """Long chains, closed and open, a pair and a knot are spliced before anything is doubled: same circles, few nodes left."""
    from verdikt.operators import cycles

    doubled, chained = [], cycles._chained
    monkeypatch.setattr(cycles, "SPLICED_OVER", 8)
    monkeypatch.setattr(cycles, "_chained", lambda through: doubled.append(through.count()) or chained(through))
    edges = [(i, (i + 1) % 300) for i in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(1200, 1100)] + [(5000, 5001), (5001, 5000), (6000, 6000), (6000, 7000)]
    edges += [(8000, 8001), (8001, 8002), (8002, 8000), (8001, 8003), (8003, 8000)]
    got = {r.node: r.circle for r in cycles.circles(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {i: 0 for i in range(300)} | {i: 1100 for i in range(1100, 1201)} | {5000: 5000, 5001: 5000, 6000: 6000} | {i: 8000 for i in range(8000, 8004)}
    assert sum(doubled) < 100
