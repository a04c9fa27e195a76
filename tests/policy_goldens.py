"""What readers, constraints, graph, evidence and tasks give for one small policy, with the rows that follow from its text, written by hand."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.functions.logic import all_true, any_true, negated, tri
from verdikt.model import Attribute, Expression, Policy, Predicate, Rule, all_of
from verdikt.operators.decide import trace
from verdikt.operators.graph import policy_graph, summary
from verdikt.operators.retrieve import evidence_by_rule, request_sketch, text_corpus, top_rules, top_subgraphs
from verdikt.operators.validate import dangling_children, missing_roots, single_valued_containers, type_conflicts, unfit_literals, unknown_actions
from verdikt.operators.workload import counterfactual, grid_tasks, request_grid
from verdikt.sources.policies import entities, parse_policy, tables, with_readme

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TEXT = """
# who may handle parts and orders
userAttrib(ann, role=buyer, regions={EU US}, level=3)
userAttrib(bob, role=clerk, regions={US}, level=1)   # new
resourceAttrib(p1, kind=part, region=EU, owner=ann)
resourceAttrib(o2, kind=order, region=US, owner=bob)
rule(role [ {buyer}; kind [ {order part}; {read write}; regions ] region)
rule(; kind [ {order}; {close}; uid=owner)
"""
JSON_TEXT = json.dumps({
    "meta": {"policy_id": "J", "domain": "sales", "version": "3"},
    "users": {"ann": {"level": 3, "teams": ["b", "a"]}},
    "resources": {"p1": {"least": 2.5}},
    "rules": [
        {"id": "J1", "effect": "Deny", "actions": "read", "predicates": [{"op": "LT", "left_scope": "subject", "left_attr": "level", "right_scope": "subject", "right_attr": "level"}]},
        {"actions": ["read", "sell"], "predicates": [{"id": "PX", "op": "CONTAINS", "left_scope": "subject", "left_attr": "teams", "right_value": "a"}, {"op": "GE", "left_scope": "resource", "left_attr": "least", "right_value": 2}]},
    ],
})


def query(columns: str, *rows: str) -> Callable:
    """Registers a query under its function's name, with the rows that it gives."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) v({', '.join(f'"{c.strip()}"' for c in columns.split(','))})"
        return function

    return register


def _policy() -> Policy:
    return parse_policy(TEXT, "shop")


def _joined(name: str) -> object:
    return F.array_join(name, "+").alias(name)


@query("rule_id, pos, effect, actions, root", "'R1', 0, 'Permit', 'read+write', 'EROOT'", "'R2', 1, 'Permit', 'close', 'EROOT'")
def policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, _policy())["rules"].select("rule_id", "pos", "effect", _joined("actions"), "root")


@query(
    "rule_id, predicate_id, op, lhs, rhs, right_kind, right_values",
    "'R1', 'P1', 'IN', 'subject.role', '-', 'set', 'buyer'", "'R1', 'P2', 'IN', 'resource.kind', '-', 'set', 'order+part'", "'R1', 'P3', 'CONTAINS', 'subject.regions', 'resource.region', 'attribute', '-'",
    "'R2', 'P1', 'IN', 'resource.kind', '-', 'set', 'order'", "'R2', 'P2', 'EQ', 'subject.uid', 'resource.owner', 'attribute', '-'",
)
def policy_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables(spark, _policy())["predicates"]
    return p.select("rule_id", "predicate_id", "op", F.concat_ws(".", "left_scope", "left_attr").alias("lhs"), F.coalesce(F.concat("right_scope", F.lit("."), "right_attr"), F.lit("-")).alias("rhs"), "right_kind", F.coalesce(F.array_join("right_values", "+"), F.lit("-")).alias("right_values"))


@query("scope, name, datatype, multivalue", "'subject', 'role', 'string', false", "'subject', 'regions', 'set[string]', true", "'subject', 'level', 'int', false", "'subject', 'uid', 'string', false", "'resource', 'kind', 'string', false", "'resource', 'region', 'string', false", "'resource', 'owner', 'string', false", "'resource', 'rid', 'string', false")
def policy_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, _policy())["attributes"]


@query("rule_id, node_id, op, predicate_id, children", "'R1', 'E1', 'PRED', 'P1', ''", "'R1', 'E2', 'PRED', 'P2', ''", "'R1', 'E3', 'PRED', 'P3', ''", "'R1', 'EROOT', 'AND', '-', 'E1+E2+E3'", "'R2', 'E1', 'PRED', 'P1', ''", "'R2', 'E2', 'PRED', 'P2', ''", "'R2', 'EROOT', 'AND', '-', 'E1+E2'")
def policy_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, _policy())["expressions"].select("rule_id", "node_id", "op", F.coalesce("predicate_id", F.lit("-")).alias("predicate_id"), _joined("children"))


@query("pos, uid, role, regions, level", "CAST(0 AS BIGINT), 'ann', 'buyer', 'EU+US', CAST(3 AS BIGINT)", "1, 'bob', 'clerk', 'US', 1")
def policy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, _policy(), "subject").select("pos", "uid", "role", _joined("regions"), "level")


@query("rule_id, effect, predicate_id, op, right_values", "'J1', 'Deny', 'P1', 'LT', '-'", "'R2', 'Permit', 'PX', 'CONTAINS', 'a'", "'R2', 'Permit', 'P2', 'GE', '2'")
def policy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables(spark, parse_policy(JSON_TEXT))
    return made["rules"].join(made["predicates"], "rule_id").select("rule_id", "effect", "predicate_id", "op", F.coalesce(F.array_join("right_values", "+"), F.lit("-")).alias("right_values"))


@query("policy_id, domain, version", "'J', 'sales', '3'", "'shop', 'parts trade', '1.4'")
def policy_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = with_readme(_policy(), "# Policy Description: Parts Trade\n* Vesion: 1.4 *\n")
    meta = [tables(spark, p)["policy"] for p in (parse_policy(JSON_TEXT), named)]
    return meta[0].unionByName(meta[1]).select("policy_id", "domain", "version")


@query(
    "node_id, kind",
    "'Policy:shop', 'Policy'", "'Rule:R1', 'Rule'", "'Rule:R2', 'Rule'", "'Action:read', 'Action'", "'Action:write', 'Action'", "'Action:close', 'Action'", "'Expr:R1:EROOT', 'Expr'", "'Expr:R2:EROOT', 'Expr'",
    "'Condition:R1:P1', 'Condition'", "'Condition:R1:P2', 'Condition'", "'Condition:R1:P3', 'Condition'", "'Condition:R2:P1', 'Condition'", "'Condition:R2:P2', 'Condition'",
    "'SubjectAttr:role', 'SubjectAttr'", "'SubjectAttr:regions', 'SubjectAttr'", "'SubjectAttr:level', 'SubjectAttr'", "'SubjectAttr:uid', 'SubjectAttr'", "'ResourceAttr:kind', 'ResourceAttr'", "'ResourceAttr:region', 'ResourceAttr'", "'ResourceAttr:owner', 'ResourceAttr'", "'ResourceAttr:rid', 'ResourceAttr'",
    "'AttrValue:role:''buyer''', 'AttrValue'", "'AttrValue:kind:''order''', 'AttrValue'", "'AttrValue:kind:''part''', 'AttrValue'",
)
def policy_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_graph(spark, _policy())[0].select("node_id", "kind")


@query(
    "src, label, dst",
    "'Policy:shop', 'HAS_RULE', 'Rule:R1'", "'Policy:shop', 'HAS_RULE', 'Rule:R2'", "'Rule:R1', 'USES_ACTION', 'Action:read'", "'Rule:R1', 'USES_ACTION', 'Action:write'", "'Rule:R2', 'USES_ACTION', 'Action:close'", "'Rule:R1', 'HAS_COND', 'Expr:R1:EROOT'", "'Rule:R2', 'HAS_COND', 'Expr:R2:EROOT'",
    "'Expr:R1:EROOT', 'CHILD', 'Condition:R1:P1'", "'Expr:R1:EROOT', 'CHILD', 'Condition:R1:P2'", "'Expr:R1:EROOT', 'CHILD', 'Condition:R1:P3'", "'Expr:R2:EROOT', 'CHILD', 'Condition:R2:P1'", "'Expr:R2:EROOT', 'CHILD', 'Condition:R2:P2'",
    "'Condition:R1:P1', 'REF_ATTR', 'SubjectAttr:role'", "'Condition:R1:P2', 'REF_ATTR', 'ResourceAttr:kind'", "'Condition:R1:P3', 'REF_ATTR', 'SubjectAttr:regions'", "'Condition:R1:P3', 'REF_ATTR', 'ResourceAttr:region'", "'Condition:R2:P1', 'REF_ATTR', 'ResourceAttr:kind'", "'Condition:R2:P2', 'REF_ATTR', 'SubjectAttr:uid'", "'Condition:R2:P2', 'REF_ATTR', 'ResourceAttr:owner'",
    "'Condition:R1:P1', 'REF_VALUE', 'AttrValue:role:''buyer'''", "'Condition:R1:P2', 'REF_VALUE', 'AttrValue:kind:''order'''", "'Condition:R1:P2', 'REF_VALUE', 'AttrValue:kind:''part'''", "'Condition:R2:P1', 'REF_VALUE', 'AttrValue:kind:''order'''",
)
def policy_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_graph(spark, _policy())[1].select("src", "label", "dst")


_SUMMARIES = ("R1: effect=Permit; actions=[read, write]; when subject.role IN {''buyer''} AND resource.kind IN {''order'', ''part''} AND subject.regions CONTAINS resource.region", "R2: effect=Permit; actions=[close]; when resource.kind IN {''order''} AND subject.uid EQ resource.owner")


@query("rule_id, summary", *(f"'R{n}', '{s}'" for n, s in enumerate(_SUMMARIES, 1)))
def policy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, summary(r)) for r in _policy().rules], "rule_id string, summary string")


@query("evidence_id, text", *(f"'TXT_RULE_R{n}', '{s}'" for n, s in enumerate(_SUMMARIES, 1)), *(f"'TXT_{short}ATTR_{a}', '{scope} attribute {a} datatype={t}'" for scope, short, own in (("subject", "SUB", {"role": "string", "regions": "set[string]", "level": "int", "uid": "string"}), ("resource", "RES", {"kind": "string", "region": "string", "owner": "string", "rid": "string"})) for a, t in own.items()))
def policy_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_corpus(spark, _policy()).select("evidence_id", "text")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "may bob close order o2"), (2, "read region"), (3, "nothing of this")], "query_id int, query string")


@query("query_id, evidence_id, rule_id, score", "1, 'SG1', 'R2', 0.75", "1, 'SG2', 'R1', 0.2", "2, 'SG1', 'R1', 1.35", "2, 'SG2', 'R2', 0.0", "3, 'SG1', 'R2', 0.0", "3, 'SG2', 'R1', 0.0")
def policy_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared tokens of a query's, and 0.35 for each action named in both."""
    return top_rules(_asked(spark), _policy()).withColumn("score", F.round("score", 6))


@query("query_id, evidence_id, rule_id, nodes, edges", "1, 'SG1', 'R2', 7, 6", "1, 'SG2', 'R1', 9, 8", "2, 'SG1', 'R1', 9, 8", "2, 'SG2', 'R2', 7, 6", "3, 'SG1', 'R2', 7, 6", "3, 'SG2', 'R1', 9, 8")
def policy_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's two-hop neighbourhood: its actions, its expression with the conditions, the policy with the other rule."""
    found = top_subgraphs(spark, _asked(spark), _policy())
    return found.select("query_id", "evidence_id", F.array_join("rule_ids", "+").alias("rule_id"), F.size("node_ids").alias("nodes"), F.size("edges").alias("edges"))


@query("query_id, rule_id, evidence_ids", "1, 'R2', 'SG1'", "1, 'R1', 'SG2'", "2, 'R1', 'SG1'", "2, 'R2', 'SG2'", "3, 'R2', 'SG1'", "3, 'R1', 'SG2'")
def policy_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_by_rule(top_subgraphs(spark, _asked(spark), _policy())).select("query_id", "rule_id", _joined("evidence_ids"))


@query("query_id, action, subject_id, resource_id, role, kind", "1, 'close', 'bob', 'o2', 'clerk', 'order'", "2, 'read', '-', '-', '-', '-'", "3, '-', '-', '-', '-', '-'", "4, 'sell', 'ann', '-', 'chief', '-'")
def policy_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark).unionByName(spark.createDataFrame([(4, "ann, action=sell subject.Role=chief")], "query_id int, query string"))
    shown = lambda c, name: F.coalesce(c, F.lit("-")).alias(name)
    found = request_sketch(rows, _policy())
    return found.select("query_id", *(shown(F.col(c), c) for c in ("action", "subject_id", "resource_id")), shown(F.col("subject")["role"], "role"), shown(F.col("resource")["kind"], "kind"))


@query(
    "uid, rid, action, target, scope, attr, value",
    "'ann', 'p1', 'read', 'Deny', 'subject', 'regions', 'US'", "'bob', 'o2', 'read', 'Permit', 'subject', 'role', 'buyer'", "'bob', 'p1', 'read', '-', '-', '-', '-'", "'ann', 'o2', 'read', 'Deny', 'subject', 'role', 'clerk'",
    "'ann', 'p1', 'close', 'Permit', 'resource', 'kind', 'order'", "'bob', 'o2', 'close', 'Deny', 'subject', 'uid', 'ann'", "'bob', 'p1', 'close', '-', '-', '-', '-'", "'ann', 'o2', 'close', 'Permit', 'subject', 'uid', 'bob'",
)
def policy_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first change of one attribute that turns a decision: subjects before resources, attributes and values by name."""
    policy = _policy()
    tasks = grid_tasks(request_grid(spark, policy), F.col("subject.uid"), F.col("resource.rid")).filter("task_type = 'qa' AND action <> 'write'")
    shown = lambda c, name: F.coalesce(c, F.lit("-")).alias(name)
    return counterfactual(spark, policy, tasks, F.col("pos") + 1).select("uid", "rid", "action", *(shown(f"cf_{c}", c) for c in ("target", "scope", "attr", "value")))


def _broken() -> Policy:
    declared = {("subject", n): Attribute("subject", n, t) for n, t in (("n", "int"), ("s", "string"), ("many", "set[string]"))}
    wrong = all_of("R1", "Permit", ("go",), [Predicate("P1", "EQ", "subject", "n", right_value="x"), Predicate("P2", "CONTAINS", "subject", "n", right_value=1), Predicate("P3", "EQ", "subject", "n", "subject", "s"), Predicate("P4", "SUPERSET", "subject", "many", right_value={"a"})])
    loose = Rule("R2", "Deny", ("go", "stay"), {}, {"A": Expression("A", "AND", ("B", "C")), "C": Expression("C", "OR", ("A",))}, "TOP")
    return Policy("broken", (wrong, loose), declared)


@query("constraint_, rule_id, detail", "'action', 'R2', 'stay'", "'root', 'R2', 'TOP'", "'child', 'R2', 'B'", "'types', 'R1', 'P3'", "'literal', 'R1', 'P1'", "'container', 'R1', 'P2'")
def policy_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables(spark, _broken())
    p, a = made["predicates"], made["attributes"]
    found = {"action": (unknown_actions(made["rules"], spark.createDataFrame([("go",)], "name string")), "action"), "root": (missing_roots(made["rules"], made["expressions"]), "root"), "child": (dangling_children(made["expressions"]), "child"), "types": (type_conflicts(p, a), "predicate_id"), "literal": (unfit_literals(p, a), "predicate_id"), "container": (single_valued_containers(p, a), "predicate_id")}
    whole = None
    for name, (rows, detail) in found.items():
        own = rows.select(F.lit(name).alias("constraint_"), "rule_id", F.col(detail).alias("detail"))
        whole = own if whole is None else whole.unionByName(own)
    return whole


@query("tree, value, decision", "'or', 'TRUE', 'Permit'", "'not', 'FALSE', 'Deny'", "'nested', 'UNKNOWN', 'InsufficientPolicyEvidence'", "'other', 'UNKNOWN', 'InsufficientPolicyEvidence'")
def policy_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR, NOT, a nested tree with an unknown attribute, and an operator that isn't known."""
    leaf = {f"E{n}": Expression(f"E{n}", "PRED", predicate_id=f"P{n}") for n in (1, 2)}
    predicates = {f"P{n}": Predicate(f"P{n}", "EQ", "subject", a, right_value=1) for n, a in ((1, "x"), (2, "y"))}
    trees = {"or": [Expression("T", "OR", ("E1", "E2"))], "not": [Expression("T", "NOT", ("E1",))], "nested": [Expression("T", "AND", ("E1", "N")), Expression("N", "NOT", ("E2",))], "other": [Expression("T", "XOR", ("E1", "E2"))]}
    requests = spark.createDataFrame([((1, 0), "go", ["subject.y"])], "subject struct<x:int,y:int>, action string, unknown array<string>")
    whole = None
    for name, nodes in trees.items():
        rule = Rule("R1", "Permit", ("go",), predicates, {**leaf, **{e.node_id: e for e in nodes}}, "T")
        policy = Policy("trees", (rule,), {("subject", a): Attribute("subject", a, "int") for a in "xy"})
        own = trace(requests, policy).select(F.lit(name).alias("tree"), F.col("trace.rule_results")["R1"].alias("value"), F.col("trace.decision").alias("decision"))
        whole = own if whole is None else whole.unionByName(own)
    return whole


@query("a, b, both, either, negated, all_of_none, any_of_none, not_of_none", "'T', 'T', 'TRUE', 'TRUE', 'FALSE', 'TRUE', 'FALSE', 'UNKNOWN'", "'T', 'U', 'UNKNOWN', 'TRUE', 'FALSE', 'TRUE', 'FALSE', 'UNKNOWN'", "'T', 'F', 'FALSE', 'TRUE', 'FALSE', 'TRUE', 'FALSE', 'UNKNOWN'", "'U', 'T', 'UNKNOWN', 'TRUE', 'UNKNOWN', 'TRUE', 'FALSE', 'UNKNOWN'", "'U', 'U', 'UNKNOWN', 'UNKNOWN', 'UNKNOWN', 'TRUE', 'FALSE', 'UNKNOWN'", "'U', 'F', 'FALSE', 'UNKNOWN', 'UNKNOWN', 'TRUE', 'FALSE', 'UNKNOWN'", "'F', 'T', 'FALSE', 'TRUE', 'TRUE', 'TRUE', 'FALSE', 'UNKNOWN'", "'F', 'U', 'FALSE', 'UNKNOWN', 'TRUE', 'TRUE', 'FALSE', 'UNKNOWN'", "'F', 'F', 'FALSE', 'FALSE', 'TRUE', 'TRUE', 'FALSE', 'UNKNOWN'")
def kleene_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [("T", True), ("F", False), ("U", None)]
    rows = spark.createDataFrame([(a, x, b, y) for a, x in values for b, y in values], "a string, x boolean, b string, y boolean")
    x, y = F.col("x"), F.col("y")
    return rows.select("a", "b", tri(all_true([x, y])).alias("both"), tri(any_true([x, y])).alias("either"), tri(negated([x])).alias("negated"), tri(all_true([])).alias("all_of_none"), tri(any_true([])).alias("any_of_none"), tri(negated([])).alias("not_of_none"))
