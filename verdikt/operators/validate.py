"""Integrity of policies: on the driver for one policy, and as queries over policies kept as tables."""

from __future__ import annotations

from collections import Counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.model import Policy, PolicyValidationError, Rule
from verdikt.sources.literals import scalar_type


def _acyclic(rule: Rule) -> str | None:
    done: set[str] = set()

    def visit(node: str, above: tuple[str, ...]) -> str | None:
        if node in above:
            return f"{rule.rule_id}: expressions go in a circle at {node}"
        if node not in rule.expressions:
            return f"{rule.rule_id}: no expression {node}"
        if node in done:
            return None
        found = next(filter(None, (visit(c, (*above, node)) for c in rule.expressions[node].children)), None)
        done.add(node)
        return found

    return visit(rule.root, ())


def _literal_fits(v: Any, base: str) -> bool:
    items = v if isinstance(v, (set, list, tuple)) else (v,)
    return all(scalar_type(x) == base or (base == "float" and scalar_type(x) == "int") for x in items)


def problems(policy: Policy) -> list[str]:
    """All that is wrong with a policy, in the order of the constraints."""
    found = [f"rule id {r} occurs {n} times" for r, n in Counter(r.rule_id for r in policy.rules).items() if n > 1]
    known = set(policy.actions)
    found += [f"{r.rule_id}: unknown action {a}" for r in policy.rules for a in r.actions if a not in known]
    found += [f"{r.rule_id}: no root {r.root}" for r in policy.rules if r.root not in r.expressions]
    found += [m for r in policy.rules if r.root in r.expressions and (m := _acyclic(r))]
    found += [f"{r.rule_id}: no predicate {e.predicate_id}" for r in policy.rules for e in r.expressions.values() if e.op == "PRED" and e.predicate_id not in r.predicates]
    for r in policy.rules:
        for p in r.predicates.values():
            at = f"{r.rule_id}.{p.predicate_id}"
            left = policy.attribute(p.left_scope, p.left_attr)
            right = policy.attribute(p.right_scope, p.right_attr) if p.by_attribute else None
            if left is None:
                found.append(f"{at}: unknown attribute {p.left_scope}.{p.left_attr}")
            if p.by_attribute and right is None:
                found.append(f"{at}: unknown attribute {p.right_scope}.{p.right_attr}")
            if left and right and left.base != right.base:
                found.append(f"{at}: {left.datatype} against {right.datatype}")
            if left and not p.by_attribute and p.right_value is not None and not _literal_fits(p.right_value, left.base):
                found.append(f"{at}: {p.right_value!r} isn't {left.base}")
            if left and p.op in ("CONTAINS", "SUPERSET") and not left.multivalue:
                found.append(f"{at}: {p.op} needs a set on the left")
    return found


def check(policy: Policy) -> Policy:
    if found := problems(policy):
        raise PolicyValidationError(found[0])
    return policy


def duplicate_ids(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often (n)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unknown_actions(rules: DataFrame, actions: DataFrame) -> DataFrame:
    """rule_id and action of rules (rule_id, actions) that use what actions (name) doesn't have."""
    used = rules.select("rule_id", F.explode("actions").alias("action"))
    return used.join(actions, F.col("action") == F.col("name"), "left_anti")


def missing_roots(rules: DataFrame, expressions: DataFrame) -> DataFrame:
    nodes = expressions.select(F.col("rule_id").alias("r"), "node_id")
    return rules.select("rule_id", "root").join(nodes, (F.col("rule_id") == F.col("r")) & (F.col("root") == F.col("node_id")), "left_anti")


def dangling_children(expressions: DataFrame) -> DataFrame:
    nodes = expressions.select(F.col("rule_id").alias("r"), F.col("node_id").alias("n"))
    used = expressions.select("rule_id", F.explode("children").alias("child"))
    return used.join(nodes, (F.col("rule_id") == F.col("r")) & (F.col("child") == F.col("n")), "left_anti")


def unknown_references(predicates: DataFrame, attributes: DataFrame) -> DataFrame:
    """rule_id, predicate_id, side, scope and attr of references to what attributes (scope, name) doesn't have."""
    left = predicates.select("rule_id", "predicate_id", F.lit("left").alias("side"), F.col("left_scope").alias("ref_scope"), F.col("left_attr").alias("ref_attr"))
    right = predicates.filter("right_scope IS NOT NULL AND right_attr IS NOT NULL").select("rule_id", "predicate_id", F.lit("right").alias("side"), F.col("right_scope").alias("ref_scope"), F.col("right_attr").alias("ref_attr"))
    refs = left.unionByName(right).filter("NOT (ref_scope = 'action' AND ref_attr = 'action')")
    return refs.join(attributes, (F.col("ref_scope") == F.col("scope")) & (F.col("ref_attr") == F.col("name")), "left_anti")


def type_conflicts(predicates: DataFrame, attributes: DataFrame) -> DataFrame:
    """rule_id, predicate_id and the two base types, where two attributes of different types are compared."""
    base = F.regexp_replace("datatype", r"^set\[(.*)\]$", "$1")
    side = lambda s: attributes.select(F.col("scope").alias(f"{s}_s"), F.col("name").alias(f"{s}_n"), base.alias(f"{s}_type"))
    both = predicates.join(side("l"), (F.col("left_scope") == F.col("l_s")) & (F.col("left_attr") == F.col("l_n"))).join(side("r"), (F.col("right_scope") == F.col("r_s")) & (F.col("right_attr") == F.col("r_n")))
    return both.filter("l_type <> r_type").select("rule_id", "predicate_id", "l_type", "r_type")


def unfit_literals(predicates: DataFrame, attributes: DataFrame) -> DataFrame:
    """rule_id and predicate_id of literals that aren't of their attribute's base type (an int is a float, too): by right_type,
    the literals' own type, where predicates have it, else by whether their texts read as that type."""
    base = F.regexp_replace("datatype", r"^set\[(.*)\]$", "$1")
    fits = lambda v: (
        F.when(F.col("base") == "int", v.rlike(r"^-?[0-9]+$")).when(F.col("base") == "float", v.rlike(r"^-?[0-9]+(\.[0-9]+)?$")).when(F.col("base") == "bool", F.lower(v).isin("true", "false")).otherwise(F.lit(True))
    )
    typed = predicates.filter("right_kind IN ('scalar', 'set', 'list')").join(attributes.select("scope", "name", base.alias("base")), (F.col("left_scope") == F.col("scope")) & (F.col("left_attr") == F.col("name")))
    good = F.forall("right_values", fits)
    if "right_type" in predicates.columns:
        own = (F.col("right_type") == F.col("base")) | ((F.col("right_type") == "int") & (F.col("base") == "float"))
        good = F.when(F.col("right_type").isNull(), good).otherwise(own)
    return typed.filter(~good).select("rule_id", "predicate_id")


def single_valued_containers(predicates: DataFrame, attributes: DataFrame) -> DataFrame:
    """rule_id and predicate_id of CONTAINS and SUPERSET on single-valued attributes."""
    held = attributes.filter("NOT multivalue").select("scope", "name")
    return predicates.filter("op IN ('CONTAINS', 'SUPERSET')").join(held, (F.col("left_scope") == F.col("scope")) & (F.col("left_attr") == F.col("name")), "left_semi").select("rule_id", "predicate_id")
