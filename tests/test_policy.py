import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.observatory import ACTIONS, THINGS, USERS, permitting, text
from verdikt.model import PolicyParseError, PolicyValidationError
from verdikt.operators.decide import decide, trace
from verdikt.operators.graph import neighbourhood, policy_graph
from verdikt.operators.workload import qa_tasks, request_grid
from verdikt.sources.literals import datatype_of, split_outside, value
from verdikt.sources.policies import parse_policy, with_readme


@pytest.fixture(scope="module")
def policy():
    return parse_policy(text(), "observatory")


def test_shape(policy):
    assert (len(policy.users), len(policy.resources), len(policy.rules)) == (5, 5, 5)
    assert policy.actions == ACTIONS
    assert [(p.op, p.left_attr, p.right_attr) for p in policy.rules[3].predicates.values()] == [("IN", "kind", None), ("SUPERSET", "fields", "subjects"), ("CONTAINS", "crews", "crew")]
    assert (policy.domain, parse_policy(text(), "Health-1").domain) == ("general", "healthcare")
    named = with_readme(policy, "# Policy Description: Night Sky \n*Vesion: v2*")
    assert (named.domain, named.version) == ("night sky", "v2")
    assert with_readme(policy, "Version: 3").version == policy.version


def test_all_requests(spark, policy):
    traced = trace(request_grid(spark, policy), policy).select("subject.uid", "resource.rid", "action", "trace.decision", "trace.decisive_rules").collect()
    got = {(r.uid, r.rid, r.action): (r.decision, r.decisive_rules) for r in traced}
    rules = {(u, t, a): permitting(u, t, a) for u in USERS for t in THINGS for a in ACTIONS}
    assert got == {key: ("Permit" if found else "Deny", found) for key, found in rules.items()}
    assert {r.decision: r["count"] for r in decide(request_grid(spark, policy), policy).groupBy("decision").count().collect()} == Counter("Permit" if found else "Deny" for found in rules.values())


def request(spark, policy, uid, rid, action, unknown=(), **change):
    row = request_grid(spark, policy).filter((F.col("subject.uid") == uid) & (F.col("resource.rid") == rid)).limit(1)
    for k, v in change.items():
        row = row.withColumn("subject", F.col("subject").withField(k, F.lit(v)))
    return row.withColumns({"action": F.lit(action).cast("string"), "unknown": F.array(*map(F.lit, unknown)).cast("array<string>")})


@pytest.mark.parametrize(("uid", "rid", "action", "expected"), [("vela", "lens1", "adjust", "Permit"), ("vela", "lens2", "adjust", "Deny"), ("lyra", "plate2", "annotate", "Permit"), ("mira", "plate3", "view", "Permit")])
def test_pairs(spark, policy, uid, rid, action, expected):
    assert trace(request(spark, policy, uid, rid, action), policy).first().trace.decision == expected


def test_unknown(spark, policy):
    for asked in (request(spark, policy, "vela", "lens1", "adjust", ["subject.dome"]), request(spark, policy, "vela", "lens1", "adjust", dome="UNKNOWN")):
        t = trace(asked, policy).first().trace
        assert t.decision == "InsufficientPolicyEvidence"
        assert t.missing_attributes == ["subject.dome"]
        assert t.decisive_rules == ["R1"]
        assert t.decisive_predicates["R1"] == {"P1": "TRUE", "P2": "TRUE", "P3": "UNKNOWN"}
        assert decide(asked, policy).first().decision == t.decision
    t = trace(request(spark, policy, "vela", "lens1", None), policy).first().trace
    assert (t.decision, t.missing_attributes, t.rule_results) == ("InsufficientPolicyEvidence", ["action"], {})
    t = trace(request(spark, policy, "vela", "lens1", "fly"), policy).first().trace
    assert (t.decision, t.notes) == ("Deny", ["No rules match action 'fly'"])


def test_graph(spark, policy):
    nodes, edges = policy_graph(spark, policy)
    assert {r.kind: r["count"] for r in nodes.groupBy("kind").count().collect()} == {"Policy": 1, "SubjectAttr": 6, "ResourceAttr": 6, "Action": 3, "Rule": 5, "Expr": 5, "Condition": 12, "AttrValue": 3}
    assert {r.label: r["count"] for r in edges.groupBy("label").count().collect()} == {"HAS_RULE": 5, "USES_ACTION": 6, "HAS_COND": 5, "CHILD": 12, "REF_ATTR": 18, "REF_VALUE": 6}
    around = neighbourhood(edges, nodes.filter("kind = 'Rule'").select(F.col("node_id").alias("seed"))).groupBy("seed").count()
    plain = {(r.src, r.label, r.dst) for r in edges.collect()}
    for r in around.collect():
        ring = {n for e in plain if r.seed in (e[0], e[2]) for n in (e[0], e[2])}
        assert r["count"] == sum(e[0] in ring or e[2] in ring for e in plain)


def test_seeded_order(spark, policy):
    assert len({r.task_id for r in qa_tasks(spark, policy, 7, 8).collect()}) == 8


def negative(**rule):
    base = {"id": "R1", "actions": ["read"], "predicates": [{"id": "P1", "op": "EQ", "left_scope": "subject", "left_attr": "nights", "right_value": 12}]}
    return json.dumps({"meta": {"policy_id": "p"}, "users": {"mira": {"nights": 12}}, "resources": {"lens1": {}}, "rules": [base, {**base, "id": "R2", **rule}]})


def test_negatives():
    parse_policy(negative())
    with pytest.raises(PolicyValidationError, match="R1"):
        parse_policy(negative(id="R1"))
    wrong = lambda **p: negative(predicates=[{"id": "P1", "op": "EQ", "left_scope": "subject", "left_attr": "nights", **p}])
    with pytest.raises(PolicyValidationError, match="dome"):
        parse_policy(wrong(left_attr="dome", right_value=1))
    with pytest.raises(PolicyValidationError, match="a dozen"):
        parse_policy(wrong(right_value="a dozen"))
    with pytest.raises(PolicyValidationError, match="needs a set"):
        parse_policy(wrong(op="CONTAINS", right_value=1))
    for bad in ("userAttrib(u, a=b)", "rule(a; b; {read})", "rule(; ; {}; a=b)", "{", '{"rules": []}'):
        with pytest.raises(PolicyParseError):
            parse_policy(bad)


def test_literals():
    assert split_outside("a, {b, c}, (d, e)", ",") == ["a", "{b, c}", "(d, e)"]
    assert (value("{1 2,3}"), value("TRUE"), value("-4"), value("1.5"), value("1e5")) == ({1, 2, 3}, True, -4, 1.5, "1e5")
    assert [datatype_of(v) for v in ([], [1, 2], [1, 1.5], [True], [True, 1], [{1}, {2}], [["a"]])] == ["string", "int", "float", "bool", "string", "set[int]", "set[string]"]
