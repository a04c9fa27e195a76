"""Trees as programs: deep ones, shared nodes, circles, gaps; every operator against the columns' decisions."""

import random

import pytest
from pyspark.sql import functions as F

from verdikt.operators.as_data import decide_as_data, flattened, trace_as_data

RULES = "rule_id string, effect string, actions array<string>, root string"
PREDICATES = "rule_id string, predicate_id string, pos int, op string, left_scope string, left_attr string, right_scope string, right_attr string, right_kind string, right_values array<string>"
EXPRESSIONS = "rule_id string, node_id string, op string, predicate_id string, children array<string>"


def test_flattened():
    leaf = ("PRED", "P1", [])
    assert flattened("A", {"A": ("and", None, ["B", "C", "B"]), "B": leaf, "C": ("PRED", "P0", [])}) == (["P1", "P0"], [("PRED", 0, []), ("PRED", 1, []), ("AND", -1, [0, 1, 0])])
    assert flattened("A", {"A": ("NOT", None, ["B"])}) is None
    assert flattened("A", {"A": ("AND", None, ["B", "A"]), "B": leaf}) is None
    assert flattened("A", {"A": ("OR", None, ["B"]), "B": ("AND", None, ["C"]), "C": ("NOT", None, ["B"])}) is None
    assert flattened("", {}) is None
    deep = {f"N{n}": ("NOT", None, [f"N{n + 1}"]) for n in range(20_000)} | {"N20000": leaf}
    used, steps = flattened("N0", deep)
    assert used == ["P1"] and len(steps) == 20_001
    shared = {f"N{n}": ("AND", None, [f"N{n + 1}"] * 2) for n in range(60)} | {"N60": leaf}
    assert len(flattened("N0", shared)[1]) == 61


def tri_fold(node, nodes, values):
    op, predicate, children = nodes[node]
    if op == "PRED":
        return values[predicate]
    own = [tri_fold(c, nodes, values) for c in children]
    return {"AND": min([1, *own]), "OR": max([-1, *own]), "NOT": -own[0] if own else 0}.get(op, 0)


def test_random_trees(spark):
    draw = random.Random(5)
    rules, predicates, expressions, trees = [], [], [], {}
    for r in range(40):
        nodes = {f"L{n}": ("PRED", f"P{n}", []) for n in range(4)}
        for n in range(draw.randint(1, 8)):
            nodes[f"T{n}"] = (draw.choice(["AND", "OR", "NOT", "XOR"]), None, draw.choices(list(nodes), k=draw.randint(0, 3)))
        root = list(nodes)[-1]
        trees[f"R{r}"] = root, nodes
        rules.append((f"R{r}", draw.choice(["Permit", "Deny"]), ["go"] if r % 2 else ["go", "stop"], root))
        predicates += [(f"R{r}", f"P{n}", n, "EQ", "subject", f"x{n}", None, None, "scalar", ["1"]) for n in range(4)]
        expressions += [(f"R{r}", n, op, p, c) for n, (op, p, c) in nodes.items()]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((rules, RULES), (predicates, PREDICATES), (expressions, EXPRESSIONS))]
    asked = [(n, draw.choice(["go", "stop", "other", None, "UNKNOWN"]), {f"subject.x{i}": draw.choice([["1"], ["0"], None, ["1", "0"], []]) for i in range(4) if draw.random() < 0.8}) for n in range(150)]
    requests = spark.createDataFrame(asked, "request_id int, action string, facts map<string,array<string>>")
    want = {}
    for n, action, facts in asked:
        values = {f"P{i}": 0 if facts.get(f"subject.x{i}") is None else 1 if facts[f"subject.x{i}"] == ["1"] else -1 for i in range(4)}
        said = {r: (effect, tri_fold(*trees[r], values)) for r, effect, actions, _ in rules if action in actions}
        true = {effect for effect, v in said.values() if v == 1}
        decision = "InsufficientPolicyEvidence" if action in (None, "UNKNOWN") else "Deny" if "Deny" in true else "Permit" if true else "InsufficientPolicyEvidence" if any(v == 0 for _, v in said.values()) else "Deny"
        want[n] = decision, {r: {1: "TRUE", 0: "UNKNOWN", -1: "FALSE"}[v] for r, (_, v) in said.items()}
    for rules_in_row in (512, 7):
        assert {r.request_id: r.decision for r in decide_as_data(requests, *tables, rules_in_row=rules_in_row).collect()} == {n: d for n, (d, _) in want.items()}
        assert {r.request_id: (r.trace.decision, r.trace.rule_results) for r in trace_as_data(requests, *tables, rules_in_row=rules_in_row).collect()} == want


@pytest.mark.parametrize(
    ("op", "left", "right", "expected"),
    [("LT", ["2"], ["10"], "TRUE"), ("LT", ["b"], ["c"], "TRUE"), ("GE", ["b"], ["3"], "UNKNOWN"), ("LE", ["2.0"], ["2"], "TRUE"), ("EQ", [None], None, "TRUE"), ("NEQ", ["x"], None, "TRUE"), ("IN", ["a", "b"], ["b"], "TRUE"), ("NIN", ["a"], ["b"], "TRUE"), ("SUPERSET", ["a", "b"], ["b"], "TRUE"), ("CONTAINS", ["a"], ["b"], "FALSE"), ("MATCH", ["abc"], ["bc"], "TRUE"), ("SOUNDS", ["a"], ["a"], "UNKNOWN")],
)
def test_operators(spark, op, left, right, expected):
    rules = spark.createDataFrame([("R1", "Permit", ["go"], "E")], RULES)
    predicates = spark.createDataFrame([("R1", "P1", 0, op, "subject", "x", None, None, "none" if right is None else "set", right)], PREDICATES)
    requests = spark.createDataFrame([(1, "go", {"subject.x": left})], "request_id int, action string, facts map<string,array<string>>")
    assert trace_as_data(requests, rules, predicates).first().trace.rule_results == {"R1": expected}


def test_broken_and_empty(spark):
    rules = spark.createDataFrame([("R1", "Deny", ["go"], "A"), ("R2", "Permit", ["go"], "B"), ("R3", "Permit", ["stay"], "X")], RULES)
    predicates = spark.createDataFrame([("R2", "P1", 0, "EQ", "subject", "x", None, None, "scalar", ["1"])], PREDICATES)
    expressions = spark.createDataFrame([("R1", "A", "AND", None, ["A"]), ("R2", "B", "PRED", "P1", []), ("R3", "X", "PRED", "P9", [])], EXPRESSIONS)
    requests = spark.createDataFrame([(1, "go", {"subject.x": ["1"]}), (2, "stay", None)], "request_id int, action string, facts map<string,array<string>>")
    got = {r.request_id: r.trace for r in trace_as_data(requests, rules, predicates, expressions).collect()}
    assert got[1].rule_results == {"R1": "UNKNOWN", "R2": "TRUE"} and got[1].decision == "Permit"
    assert got[2].rule_results == {"R3": "UNKNOWN"} and got[2].decision == "InsufficientPolicyEvidence"
    assert trace_as_data(requests.limit(0), rules, predicates, expressions).collect() == []
    assert {r.decision for r in decide_as_data(requests, rules.limit(0), predicates, expressions).collect()} == {"Deny"}
    plan = decide_as_data(requests, rules, predicates, expressions).select(F.col("decision"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
