"""Deciding requests. A policy becomes columns, so a table of requests is decided in one projection, without a shuffle.

Requests have the columns subject and resource (structs of attributes), action, and may have environment (a struct) and
unknown (array of ``scope.attribute`` names whose values aren't known). An attribute that the policy declares and the
request lacks is null; one that it doesn't declare, or that holds the unknown token, is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdikt.functions.logic import Operand, all_true, any_true, compare, negated, tri
from verdikt.model import DENY, INSUFFICIENT, PERMIT, UNKNOWN_TOKEN, Policy, Predicate, Rule
from verdikt.sources.literals import datatype_of, spark_value

#: The notes of traces.
MISSING_ACTION = "Action is missing"
NEEDS_MORE = "Evaluation requires additional attributes"
DEFAULT_DENY = "Default deny: no applicable permit/deny rule evaluated to TRUE"


class Compiler:
    """Columns for a policy's rules over requests of some schema. strict: what can't be ordered is an error, not unknown."""

    def __init__(self, policy: Policy, requests: DataFrame, strict: bool = False) -> None:
        self.policy, self.schema, self.strict = policy, requests.schema, strict
        self.unknown = F.coalesce(F.col("unknown"), F.array().cast("array<string>")) if "unknown" in self.schema.names else None

    def _field(self, scope: str, name: str) -> Column | None:
        if scope not in self.schema.names or not isinstance(self.schema[scope].dataType, T.StructType):
            return None
        return F.col(f"`{scope}`.`{name}`") if name in self.schema[scope].dataType.names else None

    def attribute(self, scope: str, name: str) -> Operand:
        declared = self.policy.attribute(scope, name)
        if declared is None:
            return Operand(F.lit(None).cast("string"), F.lit(False))
        column = F.col("action") if scope == "action" else self._field(scope, name)
        if column is None:
            column = F.lit(None)
        column = column.cast(declared.spark_type)
        known = F.lit(True) if self.unknown is None else ~F.array_contains(self.unknown, f"{scope}.{name}")
        if declared.spark_type == "string":
            known = known & ~column.eqNullSafe(F.lit(UNKNOWN_TOKEN))
        return Operand(column, known, declared.base, ("list" if declared.ordered else "set") if declared.multivalue else "scalar")

    def literal(self, v: object) -> Operand:
        kind = "set" if isinstance(v, set) else "list" if isinstance(v, (list, tuple)) else "scalar"
        base = datatype_of([v]).removeprefix("set[").removesuffix("]")
        stored = spark_value(v, base)
        spark = {"bool": "boolean", "int": "bigint", "float": "double"}.get(base, "string")
        column = F.array(*(F.lit(x) for x in stored)).cast(f"array<{spark}>") if kind != "scalar" else F.lit(stored).cast(spark)
        return Operand(column, F.lit(True), base, kind)

    def predicate(self, p: Predicate) -> tuple[Column, Column]:
        """Value and missing attributes: the left one if it isn't known, else the right one."""
        left = self.attribute(p.left_scope, p.left_attr)
        right = self.attribute(p.right_scope, p.right_attr) if p.by_attribute else self.literal(p.right_value)
        none = F.array().cast("array<string>")
        lacks = F.when(~left.known, F.array(F.lit(f"{p.left_scope}.{p.left_attr}")))
        if p.by_attribute:
            lacks = lacks.when(~right.known, F.array(F.lit(f"{p.right_scope}.{p.right_attr}")))
        return compare(p.op, left, right, self.strict), lacks.otherwise(none)

    def value(self, rule: Rule, node: str | None = None) -> Column:
        """The rule's expression tree as one nullable boolean."""
        e = rule.expressions[node or rule.root]
        if e.op.upper() == "PRED":
            return self.predicate(rule.predicates[e.predicate_id])[0]
        fold = {"AND": all_true, "OR": any_true, "NOT": negated}.get(e.op.upper())
        return fold([self.value(rule, c) for c in e.children]) if fold else F.lit(None).cast("boolean")

    def used(self, rule: Rule, node: str | None = None) -> list[Predicate]:
        """The predicates that the tree reaches, once each."""
        e = rule.expressions[node or rule.root]
        found = [rule.predicates[e.predicate_id]] if e.op.upper() == "PRED" else [p for c in e.children for p in self.used(rule, c)]
        return list({p.predicate_id: p for p in found}.values())

    def applies(self, rule: Rule) -> Column:
        return F.col("action").isin(*rule.actions)

    def missing(self, rule: Rule) -> Column:
        return F.array_sort(F.array_distinct(F.concat(F.array().cast("array<string>"), *(self.predicate(p)[1] for p in self.used(rule)))))


def _no_action() -> Column:
    return F.col("action").isNull() | (F.col("action") == UNKNOWN_TOKEN)


class Judged(Compiler):
    """Rules over what is judged already: columns for predicates' outcomes, for whether rules' actions fit, and for the values
    of whole rules, where they are given; each by the identity of the predicate or rule."""

    def __init__(self, policy: Policy, requests: DataFrame, outcomes: dict[int, Column], fits: dict[int, Column], values: dict[int, Column]) -> None:
        super().__init__(policy, requests)
        self.outcomes, self.fits, self.values = outcomes, fits, values

    def predicate(self, p: Predicate) -> tuple[Column, Column]:
        return self.outcomes[id(p)], F.array().cast("array<string>")

    def value(self, rule: Rule, node: str | None = None) -> Column:
        return self.values[id(rule)] if node is None and id(rule) in self.values else super().value(rule, node)

    def applies(self, rule: Rule) -> Column:
        return self.fits[id(rule)]


def combined(c: Compiler) -> Column:
    """The decision by a compiler's rules: a cascade over booleans."""
    rules = c.policy.rules
    true = [(r.denies, F.coalesce(c.applies(r) & c.value(r), F.lit(False))) for r in rules]
    open_ = [c.applies(r) & c.value(r).isNull() for r in rules]
    denied, permitted = ([v for denies, v in true if denies == d] for d in (True, False))
    return F.when(_no_action(), INSUFFICIENT).when(any_true(denied), DENY).when(any_true(permitted), PERMIT).when(any_true(open_), INSUFFICIENT).otherwise(DENY)


def decision(policy: Policy, requests: DataFrame, strict: bool = False) -> Column:
    """The decision alone, for tables too large for traces."""
    return combined(Compiler(policy, requests, strict))


def decide(requests: DataFrame, policy: Policy, strict: bool = False) -> DataFrame:
    """requests with a column decision. strict: a comparison of order between known values that have none is an error."""
    return requests.withColumn("decision", decision(policy, requests, strict))


def trace(requests: DataFrame, policy: Policy, strict: bool = False) -> DataFrame:
    """requests with a column trace: decision, decisive_rules, decisive_predicates (rule to predicate to value),
    rule_results, missing_attributes, combining and notes. Denials override; a rule that is unknown matters only if none is true,
    and of such rules the one that lacks least is named, ties by id.

    Each rule is a pair of plain boolean columns; names, maps and what is missing are made only for the rules that a
    request's case needs.
    """
    c = Compiler(policy, requests, strict)
    rules = [(r, F.col(f"__applies{n}"), F.col(f"__value{n}")) for n, r in enumerate(policy.rules)]
    judged = {f"__applies{n}": F.coalesce(c.applies(r), F.lit(False)) for n, r in enumerate(policy.rules)} | {f"__value{n}": c.value(r) for n, r in enumerate(policy.rules)}
    true = [(r.denies, applies & F.coalesce(value, F.lit(False))) for r, applies, value in rules]
    any_of = lambda denies: any_true([holds for d, holds in true if d == denies])
    unknown = any_true([applies & value.isNull() for _, applies, value in rules])
    case = F.when(_no_action(), "no action").when(~any_true([applies for _, applies, _ in rules]), "none").when(any_of(True), "deny").when(any_of(False), "permit").when(unknown, "open").otherwise("default")
    is_ = lambda *names: F.col("__case").isin(*names)
    chosen_of = lambda made, kind: F.array_compact(F.array(*made)) if made else F.array().cast(f"array<{kind}>")
    lacks = [F.when(applies & value.isNull(), F.struct(F.size(c.missing(r)).alias("n"), F.lit(r.rule_id).alias("id"))) for r, applies, value in rules]
    found = requests.withColumns(judged).withColumn("__case", case).withColumn("__open", F.when(is_("open"), F.array_min(chosen_of(lacks, "struct<n:int,id:string>")).id))

    decisive = [(r, F.when(is_("open"), applies & (F.col("__open") == r.rule_id)).otherwise(is_("deny" if r.denies else "permit") & applies & F.coalesce(value, F.lit(False)))) for r, applies, value in rules]
    lacking = F.lit(None).cast("array<string>")
    for r, applies, _ in reversed(rules):
        lacking = F.when(applies & (F.col("__open") == r.rule_id), c.missing(r)).otherwise(lacking)

    def values(rule: Rule) -> Column:
        used = c.used(rule)
        return F.map_from_arrays(F.array(*(F.lit(p.predicate_id) for p in used)).cast("array<string>"), F.array(*(tri(c.predicate(p)[0]) for p in used)).cast("array<string>"))

    named = [F.when(holds, F.struct(F.lit(r.rule_id).alias("key"), values(r).alias("value"))) for r, holds in decisive]
    results = [F.when(applies & ~is_("no action"), F.struct(F.lit(r.rule_id).alias("key"), tri(value).alias("value"))) for r, applies, value in rules]
    no_text = F.array().cast("array<string>")
    notes = F.when(is_("no action"), F.array(F.lit(MISSING_ACTION))).when(is_("none"), F.array(F.concat(F.lit("No rules match action '"), F.col("action"), F.lit("'")))).when(is_("open"), F.array(F.lit(NEEDS_MORE))).when(is_("default"), F.array(F.lit(DEFAULT_DENY))).otherwise(no_text)
    made = F.struct(
        F.when(is_("no action", "open"), INSUFFICIENT).when(is_("permit"), PERMIT).otherwise(DENY).alias("decision"),
        chosen_of([F.when(holds, F.lit(r.rule_id)) for r, holds in sorted(decisive, key=lambda x: x[0].rule_id)], "string").alias("decisive_rules"),
        F.map_from_entries(chosen_of(named, "struct<key:string,value:map<string,string>>")).alias("decisive_predicates"),
        F.map_from_entries(chosen_of(results, "struct<key:string,value:string>")).alias("rule_results"),
        F.when(is_("no action"), F.array(F.lit("action"))).when(is_("open"), lacking).otherwise(no_text).alias("missing_attributes"),
        F.lit(policy.combining).alias("combining"),
        notes.alias("notes"),
    )
    return found.select(*requests.columns, made.alias("trace"))


def gathered_facts(facts: DataFrame) -> DataFrame:
    """request_id and facts (a map of scope.attr to items) of rows request_id, scope, attr, items; of equal names one counts."""
    named = facts.select("request_id", F.concat_ws(".", "scope", "attr").alias("name"), "items").dropDuplicates(["request_id", "name"])
    return named.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("facts"))
