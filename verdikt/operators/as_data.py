"""Deciding by policies kept as tables: any number of rules, any expression trees, decisions and traces.

A rule becomes one row: its tests as an array, and its tree as a program, a list of steps in which a step's children come
before it, so that one fold over the steps gives the tree's value in three-valued logic (1 true, 0 unknown, -1 false: AND is
the least, OR the greatest, NOT the negative). Trees of few tests carry a table of all their values instead.

Rules are indexed: where a tree needs some attribute to be one of given values (a guard), a request only meets the rules of its own
value, all others being false; who doesn't know the attribute meets all that it guards. So a request's rules are a few joins
on action and value, each with one array per key, and it is judged where it stands: nothing is shuffled but what a join
needs, and Spark broadcasts the arrays where it measures them as small. Only where an array would hold very many rules
they are dealt to several, and what is kept of each is merged by one aggregation.

Requests have request_id, action and facts, a map of ``scope.attr`` to items (array of strings; a scalar has one item). A fact
that is absent or null is unknown. Rules, predicates and expressions have the columns of a policy's tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.model import DENY, INSUFFICIENT, PERMIT, UNKNOWN_TOKEN
from verdikt.operators.decide import DEFAULT_DENY, MISSING_ACTION, NEEDS_MORE

#: Rules of a key that stand in one row.
RULES_IN_ROW = 512
#: Attributes by which rules are indexed, at most; rules that others guard are met by their action alone.
GUARDS = 6
#: Tests of a tree whose values are all tabled (3**6 places).
TABLED = 6

_STEPS = "array<struct<op:string,test:int,args:array<int>>>"


def flattened(root: str, nodes: dict[str, tuple[str, str | None, list[str]]]) -> tuple[list[str], list[tuple[str, int, list[int]]]] | None:
    """The predicates that a tree reaches, in the order of first use, and its steps, children first, each node once. None
    if it goes in a circle or to a node that isn't there. Nodes: id to operator, predicate and children; of any depth."""
    used: dict[str, int] = {}
    place: dict[str, int] = {}
    steps: list[tuple[str, int, list[int]]] = []
    open_: set[str] = set()
    stack = [(root, False)]
    while stack:
        node, left = stack.pop()
        if node in place:
            continue
        if node not in nodes or (node in open_ and not left):
            return None
        op, predicate, children = nodes[node]
        if op.upper() == "PRED":
            place[node] = len(steps)
            steps.append(("PRED", used.setdefault(predicate or "", len(used)), []))
        elif left:
            open_.discard(node)
            place[node] = len(steps)
            steps.append((op.upper(), -1, [place[c] for c in children]))
        else:
            open_.add(node)
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(children))
    return list(used), steps


def fold(steps: list[tuple[str, int, list[int]]], values: tuple[int, ...]) -> int:
    """The value of a program whose tests have these values."""
    done: list[int] = []
    for op, test, args in steps:
        own = [done[a] for a in args]
        done.append(values[test] if op == "PRED" else min([1, *own]) if op == "AND" else max([-1, *own]) if op == "OR" else -own[0] if op == "NOT" and own else 0)
    return done[-1]


def needed(steps: list[tuple[str, int, list[int]]]) -> list[int]:
    """Tests without which the tree is false: those that ANDs at the top join."""
    found, stack = [], [len(steps) - 1]
    while stack:
        op, test, args = steps[stack.pop()]
        if op == "PRED":
            found.append(test)
        elif op == "AND":
            stack += args
    return sorted(set(found))


def programs(rules: DataFrame, expressions: DataFrame) -> DataFrame:
    """rule_id, used (predicate ids), program, table (of its values by those of its tests in ternary digits, the first test
    first; null for many tests) and needs (places of tests that must hold). A broken tree has one step that is unknown."""
    nodes = expressions.groupBy("rule_id").agg(F.collect_list(F.struct("node_id", "op", "predicate_id", "children")).alias("nodes"))

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for root, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                made.append(flattened(root, {n["node_id"]: (n["op"] or "", n["predicate_id"], n["children"] or []) for n in own or []}) or ([], [("BROKEN", -1, [])]))
            steps = [[{"op": op, "test": test, "args": args} for op, test, args in program] for _, program in made]
            tables = ["".join(str(fold(program, values) + 1) for values in product((-1, 0, 1), repeat=len(used))) if len(used) <= TABLED else None for used, program in made]
            kind = pa.list_(pa.struct([("op", pa.string()), ("test", pa.int32()), ("args", pa.list_(pa.int32()))]))
            columns = [batch.column(0), pa.array([used for used, _ in made], pa.list_(pa.string())), pa.array(steps, kind), pa.array(tables, pa.string()), pa.array([needed(program) for _, program in made], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rule_id", "used", "program", "table", "needs"])

    return rules.select("rule_id", "root").join(nodes, "rule_id", "left").mapInArrow(flatten, f"rule_id string, used array<string>, program {_STEPS}, table string, needs array<int>")


_TESTS = "array<struct<predicate_id:string,op:string,left:string,right:string,items:array<string>>>"


def compiled(rules: DataFrame, predicates: DataFrame, expressions: DataFrame | None = None) -> DataFrame:
    """rule_id, denies, actions, tests, program, table and guard (attribute and values, or null): one row for each rule.
    Without expressions a rule holds if all its predicates do, and has no program."""
    right = F.when(F.col("right_kind") == "attribute", F.concat_ws(".", "right_scope", "right_attr"))
    items = F.when(F.col("right_kind") == "none", F.array(F.lit(None).cast("string"))).otherwise(F.col("right_values"))
    test = F.struct("predicate_id", F.upper("op").alias("op"), F.concat_ws(".", "left_scope", "left_attr").alias("left"), right.alias("right"), items.alias("items"))
    known = predicates.select("rule_id", F.col("predicate_id").alias("p"), "pos", test.alias("test"))
    heads = rules.select("rule_id", (F.lower("effect") == "deny").alias("denies"), "actions")
    in_order = lambda df: df.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "test"))), lambda x: x.test).alias("tests"))
    if expressions is None:
        whole = heads.join(in_order(known), "rule_id", "left").withColumns({"program": F.lit(None).cast(_STEPS), "table": F.lit(None).cast("string"), "needs": F.lit(None).cast("array<int>")})
    else:
        made = programs(rules, expressions)
        reached = made.select("rule_id", F.posexplode("used").alias("pos", "p")).join(known.drop("pos"), ["rule_id", "p"], "left")
        none = F.lit(None).cast("string")
        nowhere = F.struct(F.col("p").alias("predicate_id"), none.alias("op"), none.alias("left"), none.alias("right"), F.lit(None).cast("array<string>").alias("items"))  # unknown
        reached = reached.withColumn("test", F.coalesce("test", nowhere))
        whole = heads.join(made.select("rule_id", "program", "table", "needs"), "rule_id").join(in_order(reached), "rule_id", "left")
    must = F.when(F.col("program").isNull(), F.col("tests")).otherwise(F.transform("needs", lambda n: F.get("tests", n)))
    one_of = lambda t: t.right.isNull() & F.coalesce(F.forall(t["items"], lambda x: x.isNotNull()), F.lit(False)) & ((t.op == "IN") | ((t.op == "EQ") & (F.size(t["items"]) == 1)))
    fewest = F.array_min(F.transform(F.filter(must, one_of), lambda t: F.struct(F.size(t["items"]).alias("n"), t.left.alias("attr"), t["items"].alias("items"))))
    return whole.withColumn("tests", F.coalesce("tests", F.array().cast(_TESTS))).withColumn("guard", fewest).drop("needs")


def _fact(name: Column) -> Column:
    return F.try_element_at(F.col("facts"), name)


def _sides(t: Column) -> tuple[Column, Column]:
    return _fact(t.left), F.when(t.right.isNotNull(), _fact(t.right)).otherwise(t["items"])


def test_value(t: Column) -> Column:
    """1, 0 or -1 for a test over the row's facts."""
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    first = lambda items: F.get(items, F.lit(0))

    def value(x: Column) -> Column:
        left, right = x.left, x.right
        single = (F.size(left) == 1) & (F.size(right) == 1)
        equal = F.when(single, first(left).eqNullSafe(first(right))).otherwise(within(left, right) & within(right, left))
        shared = F.when(F.size(left) == 1, F.exists(right, lambda r: r.eqNullSafe(first(left)))).otherwise(F.size(F.array_intersect(left, right)) > 0)

        def ordered(compare) -> Column:  # numbers by size, texts by code points, neither with the other
            a, b = first(left).try_cast("double"), first(right).try_cast("double")
            return F.when(a.isNotNull() & b.isNotNull(), compare(a, b)).when(a.isNull() & b.isNull(), compare(first(left), first(right)))

        holds = (
            F.when(t.op == "EQ", equal)
            .when(t.op == "NEQ", ~equal)
            .when(t.op == "IN", shared)
            .when(t.op == "NIN", ~shared)
            .when(t.op == "LT", ordered(lambda a, b: a < b))
            .when(t.op == "LE", ordered(lambda a, b: a <= b))
            .when(t.op == "GT", ordered(lambda a, b: a > b))
            .when(t.op == "GE", ordered(lambda a, b: a >= b))
            .when(t.op.isin("CONTAINS", "SUPERSET"), within(right, left))
            .when(t.op == "MATCH", F.contains(first(left), first(right)))
        )
        return F.when(left.isNull() | right.isNull(), 0).otherwise(F.coalesce(holds.cast("int") * 2 - 1, F.lit(0)))

    left, right = _sides(t)
    return F.get(F.transform(F.array(F.struct(left.alias("left"), right.alias("right"))), value), F.lit(0))  # each side looked up once


def _missing(tests: Column) -> Column:
    """Names of the facts that tests lack: of each its left one, or else its right one."""

    def lacks(t: Column) -> Column:
        left, right = _sides(t)
        return F.when(left.isNull(), t.left).when(right.isNull(), t.right)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tests, lacks))))


def _value(r: Column, values: Column) -> Column:
    """The value of a rule whose tests have these values: looked up, or by its program; of no program, of all tests together."""

    def step(done: Column, s: Column) -> Column:
        args = F.transform(s.args, lambda at: F.get(done, at))
        own = (
            F.when(s.op == "PRED", F.coalesce(F.get(values, s.test), F.lit(0)))
            .when(s.op == "AND", F.coalesce(F.array_min(args), F.lit(1)))
            .when(s.op == "OR", F.coalesce(F.array_max(args), F.lit(-1)))
            .when(s.op == "NOT", F.coalesce(-F.get(args, F.lit(0)), F.lit(0)))
            .otherwise(0)
        )
        return F.concat(done, F.array(own))

    folded = F.aggregate(r.program, F.array().cast("array<int>"), step, lambda done: F.element_at(done, -1))
    place = F.aggregate(values, F.lit(0), lambda at, v: at * 3 + v + 1)
    tabled = F.substring(r.table, place + 1, F.lit(1)).cast("int") - 1
    return F.when(r.program.isNull(), F.coalesce(F.array_min(values), F.lit(1))).when(r.table.isNotNull(), tabled).otherwise(folded)


_ANY, _UNKNOWN = "*", "?"


def met_rules(requests: DataFrame, rules: DataFrame, predicates: DataFrame, expressions: DataFrame | None = None, rules_in_row: int = RULES_IN_ROW) -> tuple[DataFrame, bool]:
    """request_id, action, facts and rules, an array of those that may be other than false; and whether a request may have
    several such rows."""
    each = compiled(rules, predicates, expressions).select(F.struct("rule_id", "denies", "tests", "program", "table").alias("rule"), F.explode(F.array_distinct("actions")).alias("action"), "guard")
    common = [r.attr for r in each.filter("guard IS NOT NULL").groupBy(F.col("guard.attr").alias("attr")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "attr").limit(GUARDS).collect()]
    attr = F.when(F.col("guard.attr").isin(*common), F.col("guard.attr")).otherwise(_ANY) if common else F.lit(_ANY)
    named = each.withColumn("attr", F.coalesce(attr, F.lit(_ANY)))
    values = F.concat(F.array(F.lit(_UNKNOWN)), F.transform(F.array_distinct("guard.items"), lambda x: F.concat(F.lit("="), x)))
    keyed = named.select("rule", "action", "attr", F.explode(F.when(F.col("attr") == _ANY, F.array(F.lit(_ANY))).otherwise(values)).alias("value"))
    most = keyed.groupBy("action", "attr", "value").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // rules_in_row))
    arrays = keyed.groupBy("action", "attr", "value", F.pmod(F.xxhash64("rule.rule_id"), F.lit(parts)).alias("part")).agg(F.collect_list("rule").alias("rules")).drop("part")

    def own(name: str) -> Column:  # the key of a request for an attribute: its value, if it has one
        items = _fact(F.lit(name))
        return F.when((F.size(items) == 1) & F.get(items, F.lit(0)).isNotNull(), F.concat(F.lit("="), F.get(items, F.lit(0)))).otherwise(_UNKNOWN)

    rows = requests.select("request_id", "action", "facts")
    if parts > 1:
        keys = F.array(F.struct(F.lit(_ANY).alias("attr"), F.lit(_ANY).alias("value")), *(F.struct(F.lit(n).alias("attr"), own(n).alias("value")) for n in common))
        return rows.select("*", F.inline(keys)).join(arrays, ["action", "attr", "value"], "left").drop("attr", "value"), True
    found = rows
    for nth, name in enumerate([_ANY, *common]):
        mine = arrays.filter(F.col("attr") == name).select(F.col("action").alias(f"__a{nth}"), F.col("value").alias(f"__v{nth}"), F.col("rules").alias(f"__r{nth}"))
        value = F.lit(_ANY) if name == _ANY else own(name)
        found = found.join(mine, (F.col("action") == F.col(f"__a{nth}")) & (value == F.col(f"__v{nth}")), "left")
    kind = arrays.schema["rules"].dataType
    met = F.concat(*(F.coalesce(F.col(f"__r{nth}"), F.array().cast(kind)) for nth in range(len(common) + 1)))
    return found.select("request_id", "action", "facts", met.alias("rules")), False


def _no_action() -> Column:
    return F.col("action").isNull() | (F.col("action") == UNKNOWN_TOKEN)


def decide_as_data(requests: DataFrame, rules: DataFrame, predicates: DataFrame, expressions: DataFrame | None = None, rules_in_row: int = RULES_IN_ROW) -> DataFrame:
    """request_id and decision of each request; ids are distinct.

    What a rule says is a number: 3 a denial, 2 a permission, 1 unknown, 0 nothing. The greatest decides.
    """
    met, several = met_rules(requests, rules, predicates, expressions, rules_in_row)

    def says(r: Column) -> Column:
        value = _value(r, F.transform(r.tests, test_value))
        return F.element_at(F.when(r.denies, F.array(F.lit(0), F.lit(1), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))), value + 2)

    said = met.select("request_id", "action", F.coalesce(F.array_max(F.transform("rules", says)), F.lit(0)).alias("said"))
    if several:
        said = said.groupBy("request_id").agg(F.first("action").alias("action"), F.max("said").alias("said"))
    result = F.when(_no_action(), INSUFFICIENT).when(F.col("said") == 3, DENY).when(F.col("said") == 2, PERMIT).when(F.col("said") == 1, INSUFFICIENT).otherwise(DENY)
    return said.select("request_id", result.alias("decision"))


def trace_as_data(requests: DataFrame, rules: DataFrame, predicates: DataFrame, expressions: DataFrame | None = None, combining: str = "deny-overrides", rules_in_row: int = RULES_IN_ROW) -> DataFrame:
    """request_id and trace, a struct as decide.trace gives it: decision, decisive_rules, decisive_predicates,
    rule_results, missing_attributes, combining and notes.

    Of each array of rules stay what every rule says, the true rules with their tests' values, and of the unknown rules the one
    that lacks least (ties by id): all of it can be merged.
    """
    met, several = met_rules(requests, rules, predicates, expressions, rules_in_row)
    ids = rules.select("rule_id", F.explode(F.array_distinct("actions")).alias("action")).groupBy("action").agg(F.collect_list("rule_id").alias("all"))
    with_values = F.transform("rules", lambda r: F.struct(r.alias("r"), F.transform(r.tests, test_value).alias("values")))
    judged = met.select("request_id", "action", "facts", F.transform(with_values, lambda x: F.struct(x.r.rule_id.alias("id"), x.r.denies.alias("denies"), x.r.tests.alias("tests"), x["values"].alias("values"), _value(x.r, x["values"]).alias("value"))).alias("j"))
    tri = lambda v: F.element_at(F.array(F.lit("FALSE"), F.lit("UNKNOWN"), F.lit("TRUE")), v + 2)
    shown = lambda x: [x.id.alias("id"), F.transform(x.tests, lambda t: t.predicate_id).alias("ids"), F.transform(x["values"], tri).alias("values")]
    true = lambda denies: F.transform(F.filter("j", lambda x: (x.value == 1) & (x.denies == F.lit(denies))), lambda x: F.struct(*shown(x)))
    lacking = F.transform(F.filter("j", lambda x: x.value == 0), lambda x: F.struct(_missing(x.tests).alias("missing"), *shown(x)))
    parts = {
        "results": F.transform("j", lambda x: F.struct(x.id.alias("key"), tri(x.value).alias("value"))),
        "denials": true(True),
        "permissions": true(False),
        "open": F.array_min(F.transform(lacking, lambda x: F.struct(F.size(x.missing).alias("n"), *(x[c].alias(c) for c in ("id", "missing", "ids", "values"))))),
    }
    kept = judged.select("request_id", "action", *(c.alias(name) for name, c in parts.items()))
    if several:
        merged = {name: F.flatten(F.collect_list(name)) for name in ("results", "denials", "permissions")}
        kept = kept.groupBy("request_id").agg(F.first("action").alias("action"), *(c.alias(name) for name, c in merged.items()), F.min("open").alias("open"))
    # rules that the index passed over are false
    judged_ids = F.transform("results", lambda x: x.key)
    others = F.transform(F.array_except("all", judged_ids), lambda i: F.struct(i.alias("key"), F.lit("FALSE").alias("value")))
    kept = kept.join(ids.withColumnRenamed("action", "__action"), F.col("action") == F.col("__action"), "left").withColumn("results", F.when(F.col("all").isNotNull(), F.concat(F.coalesce("results", F.array().cast("array<struct<key:string,value:string>>")), others)))
    results, denials, permissions, open_ = (F.col(c) for c in ("results", "denials", "permissions", "open"))
    case = F.when(_no_action(), "no action").when(F.coalesce(F.size(results), F.lit(0)) <= 0, "none").when(F.size(denials) > 0, "deny").when(F.size(permissions) > 0, "permit").when(open_.isNotNull(), "open").otherwise("default")
    is_ = lambda *names: F.col("case").isin(*names)
    no_text = F.array().cast("array<string>")
    only = F.struct(open_.id.alias("id"), open_.ids.alias("ids"), open_["values"].alias("values"))
    decisive = F.when(is_("deny"), denials).when(is_("permit"), permissions).when(is_("open"), F.array(only)).otherwise(F.array().cast("array<struct<id:string,ids:array<string>,values:array<string>>>"))
    notes = F.when(is_("no action"), F.array(F.lit(MISSING_ACTION))).when(is_("none"), F.array(F.concat(F.lit("No rules match action '"), F.col("action"), F.lit("'")))).when(is_("open"), F.array(F.lit(NEEDS_MORE))).when(is_("default"), F.array(F.lit(DEFAULT_DENY))).otherwise(no_text)
    chosen = kept.withColumn("case", case).withColumn("decisive", F.array_sort(decisive))
    made = F.struct(
        F.when(is_("no action", "open"), INSUFFICIENT).when(is_("permit"), PERMIT).otherwise(DENY).alias("decision"),
        F.transform("decisive", lambda x: x.id).alias("decisive_rules"),
        F.map_from_entries(F.transform("decisive", lambda x: F.struct(x.id, F.map_from_arrays(x.ids, x["values"])))).alias("decisive_predicates"),
        F.map_from_entries(F.when(is_("no action") | results.isNull(), F.array().cast("array<struct<key:string,value:string>>")).otherwise(results)).alias("rule_results"),
        F.when(is_("no action"), F.array(F.lit("action"))).when(is_("open"), open_.missing).otherwise(no_text).alias("missing_attributes"),
        F.lit(combining).alias("combining"),
        notes.alias("notes"),
    )
    return chosen.select("request_id", made.alias("trace"))
