"""All pairs of a subject and a resource that a policy permits, without forming the others.

A rule's conditions say how pairs can be found: an equality between the two is an equi-join, membership an inverted index (the
members as join keys), inclusion a join on the rarest member of the included set, an order a join of bands of the value's range.
What concerns one side alone filters it before the join. These keys only have to hold for every pair that the rule permits: found
pairs are then tried by the whole rule. A pair that several rules permit is found by the first of them, so none is
shuffled to drop repeats; denials are tried on what is permitted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions.logic import Operand, any_true, comparable
from verdikt.model import Policy, Predicate, Rule
from verdikt.operators.decide import Compiler

#: Parts of a value's range for conditions of order, cut at quantiles of so many values at most, chosen by hash.
BANDS, BAND_SAMPLE = 64, 8192
#: Places to which pairs are dealt where no condition links the two sides.
DEALT = 64

_SIDES = ("subject", "resource")
_ORDERS = ("LT", "LE", "GT", "GE")


def alternatives(rule: Rule, node: str | None = None) -> list[list[str]]:
    """The tree as alternatives of what must hold together: nodes' ids. ORs are opened at the top only."""
    e = rule.expressions[node or rule.root]
    if e.op.upper() == "OR" and e.children:
        return [a for c in e.children for a in alternatives(rule, c)]
    return [_together(rule, e.node_id)]


def _together(rule: Rule, node: str) -> list[str]:
    e = rule.expressions[node]
    return [x for c in e.children for x in _together(rule, c)] if e.op.upper() == "AND" else [node]


def _scopes(p: Predicate) -> set[str]:
    return {p.left_scope} | ({p.right_scope} if p.by_attribute else set())


def _keyed(c: Compiler, conditions: list[Predicate]) -> tuple[str, list[Predicate]]:
    """How pairs are found, and by which conditions: all equalities, or else the best single one."""
    sides = lambda p: (c.attribute(p.left_scope, p.left_attr), c.attribute(p.right_scope, p.right_attr))
    linking = [(p, p.op.upper(), *sides(p)) for p in conditions if p.by_attribute and _scopes(p) == set(_SIDES)]
    linking = [x for x in linking if comparable(x[2], x[3])]
    if equal := [p for p, op, a, b in linking if op == "EQ" and not a.many and not b.many]:
        return "equal", equal
    for how, ops, fits in (("member", ("CONTAINS", "SUPERSET"), lambda a, b: not b.many), ("include", ("CONTAINS", "SUPERSET"), lambda a, b: b.many), ("overlap", ("IN",), lambda a, b: True), ("order", _ORDERS, lambda a, b: not a.many and not b.many)):
        if chosen := [p for p, op, a, b in linking if op in ops and fits(a, b)]:
            return how, chosen[:1]
    return "none", []


def _common_type(a: Operand, b: Operand, values: tuple[Column, Column], arrays: tuple[bool, bool] = (False, False)) -> tuple[Column, Column]:
    """Both as numbers of one type where one is an integer and the other isn't."""
    if a.base == b.base:
        return values
    return tuple(v.cast("array<double>" if array else "double") for v, array in zip(values, arrays, strict=True))


def _least_members(sets: DataFrame, side: str, items: Column, others: DataFrame, key: Column) -> DataFrame:
    """sets with key: of each row's set the member that the fewest rows of others have (0: none). Rows of an empty set are left out."""
    rows = sets.withColumn("__items", F.array_distinct(items)).filter(F.size("__items") > 0)
    seen = others.select(F.explode(F.array_distinct(key)).alias("__m")).groupBy("__m").agg(F.count("*").alias("__n"))
    distinct = rows.select("__items").distinct()
    counted = distinct.select("__items", F.explode("__items").alias("__x")).join(seen, F.col("__x").eqNullSafe(F.col("__m")), "left").groupBy("__items").agg(F.min_by("__x", F.struct(F.coalesce("__n", F.lit(0)), "__x")).alias("__key"))
    return rows.join(counted, "__items").select(side, "__key")


def _bounds(values: DataFrame) -> list:
    """Up to BANDS - 1 values that cut a column into parts of about the same size."""
    drawn = sorted(r[0] for r in values.toDF("x").filter("x IS NOT NULL").orderBy(F.xxhash64("x"), "x").limit(BAND_SAMPLE).collect())  # BAND_SAMPLE at most
    return sorted({drawn[len(drawn) * n // BANDS] for n in range(1, BANDS)}) if drawn else []


def _candidates(subjects: DataFrame, resources: DataFrame, c: Compiler, conditions: list[Predicate]) -> DataFrame:
    """Pairs among which are all those for which the conditions hold."""
    how, chosen = _keyed(c, conditions)
    frames = dict(zip(_SIDES, (subjects, resources), strict=True))

    def keyed(scope: str, key: Column) -> DataFrame:
        return frames[scope].select(scope, key.alias(f"__{scope}"))

    def joined(on: Column | None = None) -> DataFrame:
        found = frames["subject"].join(frames["resource"], F.col("__subject").eqNullSafe(F.col("__resource")) if on is None else on)
        return found.select(*_SIDES)

    if how == "none":
        frames = {"subject": keyed("subject", F.pmod(F.xxhash64("subject"), F.lit(DEALT))), "resource": keyed("resource", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))}
        return joined(F.col("__subject") == F.col("__resource"))
    p = chosen[0]
    a, b = c.attribute(p.left_scope, p.left_attr), c.attribute(p.right_scope, p.right_attr)
    if how == "equal":
        by_scope: dict[str, list[Column]] = {s: [] for s in _SIDES}
        for p in chosen:
            a, b = c.attribute(p.left_scope, p.left_attr), c.attribute(p.right_scope, p.right_attr)
            for scope, v in zip((p.left_scope, p.right_scope), _common_type(a, b, (a.value, b.value)), strict=True):
                by_scope[scope].append(v)
        frames = {s: frames[s].select(s, *(v.alias(f"__{s}{n}") for n, v in enumerate(values))) for s, values in by_scope.items()}
        return joined(reduce(lambda x, y: x & y, (F.col(f"__subject{n}").eqNullSafe(F.col(f"__resource{n}")) for n in range(len(chosen)))))
    left, right = p.left_scope, p.right_scope
    if how == "order":
        x, y = _common_type(a, b, (a.value, b.value))
        cuts = _bounds(frames[left].select(x))
        band = lambda v: F.size(F.filter(F.array(*map(F.lit, cuts)).cast(f"array<{'double' if a.base != b.base else {'int': 'bigint', 'float': 'double', 'bool': 'boolean'}.get(a.base, 'string')}>"), lambda cut: cut <= v))
        above = p.op.upper() in ("GT", "GE")  # the left one's band is the right one's or a higher one
        bands = F.sequence(band(y), F.lit(len(cuts))) if above else F.sequence(F.lit(0), band(y))
        frames = {left: frames[left].filter(x.isNotNull()).select(left, band(x).alias(f"__{left}")), right: frames[right].filter(y.isNotNull()).select(right, F.explode(bands).alias(f"__{right}"))}
        return joined(F.col("__subject") == F.col("__resource"))
    x, y = _common_type(a, b, (a.as_set, b.value if how == "member" else b.as_set), (True, how != "member"))
    if how == "member":
        frames = {left: keyed(left, F.explode(x)), right: keyed(right, y)}
        return joined()
    if how == "overlap":  # by the least member that both have, once
        frames = {left: frames[left].select(left, x.alias("__x"), F.explode(x).alias(f"__{left}")), right: frames[right].select(right, y.alias("__y"), F.explode(y).alias(f"__{right}"))}
        met = frames["subject"].join(frames["resource"], F.col("__subject").eqNullSafe(F.col("__resource")))
        return met.filter(F.get(F.array_sort(F.array_intersect("__x", "__y")), F.lit(0)).eqNullSafe(F.col("__subject"))).select(*_SIDES)
    everyone = _candidates(frames["subject"] if left == "subject" else frames["subject"].filter(F.size(y) == 0), frames["resource"] if left == "resource" else frames["resource"].filter(F.size(y) == 0), c, [])  # who includes nothing at all
    least = _least_members(frames[right], right, y, frames[left], x)
    frames = {left: keyed(left, F.explode(x)), right: least.withColumnRenamed("__key", f"__{right}")}
    return joined().unionByName(everyone)


def permitted_pairs(subjects: DataFrame, resources: DataFrame, policy: Policy, action: str) -> DataFrame:
    """subject and resource of every pair that is permitted the action. subjects and resources have those columns, structs of
    attributes; each row is an entity of its own, so equal rows give equal pairs.

    The pairs are those that decide() permits over the product. Work and shuffle follow what the rules' keys let
    through. A rule that no condition links (or only NEQ, NIN or MATCH) lets all pairs of its filtered sides through, by
    an equi-join that deals them to DEALT places.
    """
    sides = (subjects.select("subject"), resources.select("resource"))
    named = F.lit(action).alias("action")
    empty = subjects.select("subject").limit(0).withColumn("resource", F.lit(None).cast(resources.schema["resource"].dataType)).withColumn("action", F.lit(action))
    c = Compiler(policy, empty)
    applying = [r for r in policy.rules if action in r.actions]
    holds = lambda rule, nodes: reduce(lambda a, b: a & b, (c.value(rule, n) for n in nodes), F.lit(True))
    denied = any_true([c.value(r) for r in applying if r.denies])
    found, before = None, []
    for rule in (r for r in applying if not r.denies):
        for nodes in alternatives(rule):
            conditions = [rule.predicates[rule.expressions[n].predicate_id] for n in nodes if rule.expressions[n].op.upper() == "PRED"]
            own = []
            for scope, frame in zip(_SIDES, sides, strict=True):
                alone = [c.predicate(p)[0] for p in conditions if _scopes(p) == {scope}]
                own.append(reduce(lambda df, test: df.filter(test), alone, frame))
            value = F.coalesce(holds(rule, nodes), F.lit(False))
            pairs = _candidates(*own, c, conditions).select(*_SIDES, named).filter(value & ~any_true(before) & ~F.coalesce(denied, F.lit(False)))
            before = [*before, value]
            found = pairs if found is None else found.unionByName(pairs)
    return empty.select(*_SIDES) if found is None else found.select(*_SIDES)
