"""Readers of policies: a text form and JSON, and tables of what they declare."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from verdikt.model import Attribute, Policy, PolicyParseError, Predicate, Rule, all_of
from verdikt.operators.validate import check
from verdikt.sources.literals import datatype_of, spark_value, split_outside, value

#: The lines and signs of the text form, as existing policy files write them.
_ENTITY = re.compile(r"(user|resource)Attrib\(\s*([^,()\s]+)\s*,(.*)\)$")
_RULE = re.compile(r"rule\((.*)\)$")
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
#: How a condition's sign is read: operator and what may stand on its right, in the order in which they are tried.
_SIGNS = (
    (re.compile(rf"({_NAME})\s*\[\s*(\{{[^}}]*\}})$"), "IN", "set"),
    (re.compile(rf"({_NAME})\s*=\s*({_NAME})$"), "EQ", "attribute"),
    (re.compile(rf"({_NAME})\s*\]\s*({_NAME})$"), "CONTAINS", "attribute"),
    (re.compile(rf"({_NAME})\s*>\s*({_NAME})$"), "SUPERSET", "attribute"),
    (re.compile(rf"({_NAME})\s*=\s*(.+)$"), "EQ", "literal"),
)


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A whole file; with a session, from any store that Spark reads."""
    if spark is None:
        return Path(path).read_text(encoding="utf-8")
    return spark.read.text(path, wholetext=True).first()[0]


def read_policy(path: str, readme: str | None = None, spark: SparkSession | None = None) -> Policy:
    """The validated policy of a file, in either form; a readme adds its domain and version."""
    policy = parse(read_text(path, spark), Path(path).stem)
    policy = policy.with_(dataset=path)
    if readme:
        policy = with_readme(policy, read_text(readme, spark))
    return check(policy)


def parse_policy(text: str, policy_id: str = "inline") -> Policy:
    """The validated policy of a text."""
    return check(parse(text, policy_id))


def parse(text: str, policy_id: str) -> Policy:
    return (_json if text.lstrip().startswith("{") else _custom)(text, policy_id)


def _condition(text: str, number: int, left: str, right: str) -> Predicate:
    for sign, op, kind in _SIGNS:
        if m := sign.match(text):
            head = (f"P{number}", op, left, m[1])
            return Predicate(*head, right, m[2]) if kind == "attribute" else Predicate(*head, right_value=value(m[2]))
    raise PolicyParseError(f"condition not understood: {text!r}")


def _actions(text: str) -> tuple[str, ...]:
    inner = re.search(r"\{([^}]*)\}", text)
    found = tuple(t for t in re.split(r"[\s,]+", inner[1]) if t) if inner else (text,) if text else ()
    if not found:
        raise PolicyParseError("a rule without actions")
    return found


def _rule(number: int, body: str) -> Rule:
    subject, resource, actions, *rest = (*split_outside(body, ";"), *[None] * 3)[: max(3, body.count(";") + 1)]
    rest = [r for r in rest if r is not None]
    if actions is None or not rest:
        raise PolicyParseError(f"a rule has four parts: {body!r}")
    predicates: list[Predicate] = []
    for part, left, right in ((subject, "subject", "resource"), (resource, "resource", "subject"), (";".join(rest), "subject", "resource")):
        for condition in filter(None, split_outside(part, ",")):
            predicates.append(_condition(condition, len(predicates) + 1, left, right))
    return all_of(f"R{number}", "Permit", _actions(actions), predicates, f"rule({body})")


def _declared(users: dict[str, dict], resources: dict[str, dict]) -> dict[tuple[str, str], Attribute]:
    found = {}
    for scope, entities in (("subject", users), ("resource", resources)):
        for name in dict.fromkeys(a for e in entities.values() for a in e):
            values = [e[name] for e in entities.values() if name in e]
            found[scope, name] = Attribute(scope, name, datatype_of(values), any(isinstance(v, list) for v in values))
    return found


def _custom(text: str, policy_id: str) -> Policy:
    """Lines userAttrib(id, k=v, ...), resourceAttrib(...) and rule(a; b; c; d); # comments, other lines are skipped."""
    users: dict[str, dict[str, Any]] = {}
    resources: dict[str, dict[str, Any]] = {}
    rules: list[Rule] = []
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        if m := _ENTITY.match(line):
            pairs = (p.partition("=") for p in split_outside(m[3], ",") if "=" in p)
            entity = {k.strip(): value(v) for k, _, v in pairs}
            (users if m[1] == "user" else resources)[m[2]] = entity | {"uid" if m[1] == "user" else "rid": m[2]}
        elif m := _RULE.match(line):
            rules.append(_rule(len(rules) + 1, m[1]))
    if not rules:
        raise PolicyParseError("no rules")
    return Policy(policy_id, tuple(rules), _declared(users, resources), users, resources, "healthcare" if "health" in policy_id.lower() else "general")


def _json(text: str, policy_id: str) -> Policy:
    """{meta, users, resources, rules}: every operator, Deny effects and own ids. Lists stay lists."""
    try:
        whole = json.loads(text)
    except json.JSONDecodeError as e:
        raise PolicyParseError(f"not JSON: {e}") from e
    if not whole.get("rules"):
        raise PolicyParseError("no rules")
    meta = whole.get("meta", {})
    users = {u: {**a, "uid": a.get("uid", u)} for u, a in whole.get("users", {}).items()}
    resources = {r: {**a, "rid": a.get("rid", r)} for r, a in whole.get("resources", {}).items()}
    rules = []
    for number, r in enumerate(whole["rules"], 1):
        predicates = [Predicate(p.get("id", f"P{n}"), p["op"], p["left_scope"], p["left_attr"], p.get("right_scope"), p.get("right_attr"), p.get("right_value")) for n, p in enumerate(r.get("predicates", []), 1)]
        actions = r.get("actions", [])
        rules.append(all_of(str(r.get("id", f"R{number}")), r.get("effect", "Permit"), (actions,) if isinstance(actions, str) else tuple(actions), predicates))
    return Policy(meta.get("policy_id", policy_id), tuple(rules), _declared(users, resources), users, resources, str(meta.get("domain", "unknown")), str(meta.get("version", "unknown")), str(meta.get("dataset", "unknown")), meta.get("combining", "deny-overrides"))


#: How a policy's readme gives its domain and version, the latter spelt as such files spell it.
_DOMAIN = re.compile(r"#\s*Policy Description:\s*(.+)", re.IGNORECASE)
_VERSION = re.compile(r"Ves(?:i|e)on:\s*([^*\n]+)", re.IGNORECASE)


def with_readme(policy: Policy, readme: str) -> Policy:
    """The policy with what its readme says of domain (in lower case) and version."""
    domain, version = _DOMAIN.search(readme), _VERSION.search(readme)
    return policy.with_(domain=domain[1].strip().lower() if domain else policy.domain, version=version[1].strip() if version else policy.version)


def entities(spark: SparkSession, policy: Policy, scope: str) -> DataFrame:
    """pos (order in the file) and a typed column for each declared attribute, of the policy's users or resources."""
    rows = policy.users if scope == "subject" else policy.resources
    declared = [a for (s, _), a in policy.attributes.items() if s == scope]
    data = [(n, *(spark_value(e.get(a.name), a.base) for a in declared)) for n, e in enumerate(rows.values())]
    return spark.createDataFrame(data, ", ".join(["pos bigint", *(f"`{a.name}` {a.spark_type}" for a in declared)]))


def tables(spark: SparkSession, policy: Policy) -> dict[str, DataFrame]:
    """The policy as data: meta, attributes, actions, rules, predicates and expressions."""
    literal = lambda v: None if v is None else [str(x) for x in (sorted(v, key=str) if isinstance(v, set) else v if isinstance(v, list) else [v])]
    kind = lambda p: "attribute" if p.by_attribute else "none" if p.right_value is None else "set" if isinstance(p.right_value, set) else "list" if isinstance(p.right_value, list) else "scalar"
    made = {
        "policy": ([(policy.policy_id, policy.domain, policy.version, policy.dataset, policy.combining)], "policy_id string, domain string, version string, dataset string, combining string"),
        "attributes": ([(a.scope, a.name, a.datatype, a.multivalue) for a in policy.attributes.values()], "scope string, name string, datatype string, multivalue boolean"),
        "actions": ([(a,) for a in policy.actions], "name string"),
        "rules": ([(r.rule_id, n, r.effect, list(r.actions), r.root, r.priority, r.source) for n, r in enumerate(policy.rules)], "rule_id string, pos int, effect string, actions array<string>, root string, priority int, source string"),
        "predicates": ([(r.rule_id, p.predicate_id, n, p.op, p.left_scope, p.left_attr, p.right_scope, p.right_attr, kind(p), literal(p.right_value), None if p.by_attribute or p.right_value is None else datatype_of([p.right_value]).removeprefix("set[").removesuffix("]")) for r in policy.rules for n, p in enumerate(r.predicates.values())], "rule_id string, predicate_id string, pos int, op string, left_scope string, left_attr string, right_scope string, right_attr string, right_kind string, right_values array<string>, right_type string"),
        "expressions": ([(r.rule_id, e.node_id, e.op, e.predicate_id, list(e.children)) for r in policy.rules for e in r.expressions.values()], "rule_id string, node_id string, op string, predicate_id string, children array<string>"),
    }
    return {name: spark.createDataFrame(data, schema) for name, (data, schema) in made.items()}
