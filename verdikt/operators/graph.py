"""A policy's graph as tables of nodes and edges, and neighbourhoods in it by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdikt.model import Policy, Predicate, Rule

NODES = "node_id string, kind string, props map<string,string>"
EDGES = "src string, label string, dst string, side string"
_KINDS = {"subject": "SubjectAttr", "resource": "ResourceAttr"}


def shown(v: object) -> str:
    """A literal as rules print it: sets in order, else as Python would."""
    return "{" + ", ".join(repr(x) for x in sorted(v, key=str)) + "}" if isinstance(v, set) else str(v)


def summary(rule: Rule) -> str:
    """A rule in one line."""
    said = [f"{p.left_scope}.{p.left_attr} {p.op} " + (f"{p.right_scope}.{p.right_attr}" if p.by_attribute else shown(p.right_value)) for p in rule.predicates.values()]
    return f"{rule.rule_id}: effect={rule.effect}; actions=[{', '.join(rule.actions)}]; when {' AND '.join(said) or 'TRUE'}"


def _attribute_id(scope: str, name: str) -> str:
    return f"{_KINDS.get(scope, 'EnvAttr')}:{name}"


def _literals(p: Predicate) -> list:
    if p.by_attribute or p.right_value is None:
        return []
    return sorted(p.right_value, key=str) if isinstance(p.right_value, set) else [p.right_value]


def policy_graph(spark: SparkSession, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a policy, which is small: rules with their actions, expressions and conditions, and what those
    refer to. Users and resources aren't nodes."""
    at = f"Policy:{policy.policy_id}"
    nodes: dict[str, tuple[str, dict]] = {at: ("Policy", {"domain": policy.domain, "version": policy.version, "combining": policy.combining})}
    edges: list[tuple[str, str, str, str | None]] = []
    for (scope, name), a in policy.attributes.items():
        nodes.setdefault(_attribute_id(scope, name), (_KINDS.get(scope, "EnvAttr"), {"name": name, "datatype": a.datatype}))
    nodes |= {f"Action:{a}": ("Action", {"name": a}) for a in policy.actions}
    for r in policy.rules:
        rule = f"Rule:{r.rule_id}"
        nodes[rule] = ("Rule", {"effect": r.effect, "priority": str(r.priority), "source": r.source, "summary": summary(r)})
        edges += [(at, "HAS_RULE", rule, None), *((rule, "USES_ACTION", f"Action:{a}", None) for a in r.actions)]
        for e in r.expressions.values():
            if e.op == "PRED":
                continue
            here = f"Expr:{r.rule_id}:{e.node_id}"
            nodes[here] = ("Expr", {"op": e.op})
            if e.node_id == r.root:
                edges.append((rule, "HAS_COND", here, None))
            for c in e.children:
                child = r.expressions[c]
                edges.append((here, "CHILD", f"Condition:{r.rule_id}:{child.predicate_id}" if child.op == "PRED" else f"Expr:{r.rule_id}:{c}", None))
        for p in r.predicates.values():
            here = f"Condition:{r.rule_id}:{p.predicate_id}"
            nodes[here] = ("Condition", {"op": p.op, "left": f"{p.left_scope}.{p.left_attr}"})
            for side, scope, name in (("left", p.left_scope, p.left_attr), ("right", p.right_scope, p.right_attr)):
                if side == "left" or p.by_attribute:
                    nodes.setdefault(_attribute_id(scope, name), (_KINDS.get(scope, "EnvAttr"), {"name": name, "datatype": "string"}))
                    edges.append((here, "REF_ATTR", _attribute_id(scope, name), side))
            for v in _literals(p):
                literal = f"AttrValue:{p.left_attr}:{v!r}"
                nodes.setdefault(literal, ("AttrValue", {"name": p.left_attr, "value": str(v)}))
                edges.append((here, "REF_VALUE", literal, None))
    return spark.createDataFrame([(n, k, p) for n, (k, p) in nodes.items()], NODES), spark.createDataFrame(edges, EDGES)


def entity_nodes(rows: DataFrame, kind: str, key: Column) -> DataFrame:
    """A node for each distinct key of rows: node_id (kind:key) and kind, for graphs over data tables."""
    return rows.select(F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("node_id"), F.lit(kind).alias("kind")).distinct()


def entity_edges(rows: DataFrame, source: tuple[str, Column], label: str, target: tuple[str, Column]) -> DataFrame:
    """An edge for each row, from and to nodes named as entity_nodes names them."""
    end = lambda kind, key: F.concat(F.lit(f"{kind}:"), key.cast("string"))
    return rows.select(end(*source).alias("src"), F.lit(label).alias("label"), end(*target).alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """node_id and degree, over both ends of edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """seed, src, label, dst: the distinct edges at any node within hops - 1 steps of each seed, in either direction.

    Each hop is one join of the frontier with the edges taken both ways; a node that was visited isn't visited again.
    seeds: a column seed. Hubs are hot keys of that equi-join, which adaptive execution splits.
    """
    plain = edges.select("src", "label", "dst").distinct()
    ways = plain.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "label", "dst").unionByName(plain.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "label", "dst"))
    frontier = seeds.select("seed", F.col("seed").alias("node"))
    visited, found = frontier, None
    for hop in range(hops):
        step = frontier.join(ways, frontier.node == ways.at)
        met = step.select("seed", "src", "label", "dst")
        found = met if found is None else found.unionByName(met)
        if hop + 1 < hops:
            frontier = step.select("seed", F.col("to").alias("node")).distinct().join(visited, ["seed", "node"], "left_anti")
            visited = visited.unionByName(frontier)
    return found.distinct()


def shown_items(predicates: Column, quoted: bool) -> Column:
    """The literals of a predicate as they print: texts in quotes if quoted, the rest as they are."""
    plain = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    other = lambda v: F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"'))
    quote = lambda v: F.when(other(v), F.concat(F.lit('"'), plain(v), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain(v), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.when(F.lit(quoted) & (predicates.right_type == "string"), F.transform(predicates.right_values, quote)).otherwise(predicates.right_values)


def rule_summaries(rules: DataFrame, predicates: DataFrame) -> DataFrame:
    """rule_id and summary of every rule of a policy's tables, in one line each, as summary() gives them for one rule."""
    p = F.struct("right_kind", "right_values", "right_type")
    literal = (
        F.when(F.col("right_kind") == "attribute", F.concat_ws(".", "right_scope", "right_attr"))
        .when(F.col("right_kind") == "set", F.concat(F.lit("{"), F.array_join(shown_items(p, True), ", "), F.lit("}")))
        .when(F.col("right_kind") == "list", F.concat(F.lit("["), F.array_join(shown_items(p, True), ", "), F.lit("]")))
        .otherwise(F.coalesce(F.get("right_values", F.lit(0)), F.lit("None")))
    )
    said = predicates.select("rule_id", F.struct("pos", F.concat_ws(" ", F.concat_ws(".", "left_scope", "left_attr"), "op", literal).alias("text")).alias("c")).groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.text), " AND ").alias("when"))
    line = F.concat("rule_id", F.lit(": effect="), "effect", F.lit("; actions=["), F.array_join("actions", ", "), F.lit("]; when "), F.coalesce("when", F.lit("TRUE")))
    return rules.hint("merge").join(said.hint("merge"), "rule_id", "left").select("rule_id", line.alias("summary"))


def graph_tables(made: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, as policy_graph gives them, from a policy's tables: any number of rules, unions of selections alone.

    A node that is defined more than once (an attribute that is declared and used, a value that many conditions name) is the first
    in the order of declarations, rules and conditions.
    """
    # a few files of rules become dozens of rows each: they are dealt first, to a number of places that isn't cut down by their bytes
    places = int(made["rules"].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules, predicates, expressions = (made[t].repartition(places, "rule_id") for t in ("rules", "predicates", "expressions"))
    attributes = made["attributes"]
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    props = lambda **columns: F.create_map(*(x for k, c in columns.items() for x in (F.lit(k), c.cast("string")))) if columns else F.create_map().cast("map<string,string>")
    c = F.col
    kind = lambda scope: F.when(scope == "subject", "SubjectAttr").when(scope == "resource", "ResourceAttr").otherwise("EnvAttr")
    attribute = lambda scope, name: text(kind(scope), ":", name)
    policy = text("Policy:", c("policy_id"))
    rule, condition = text("Rule:", c("rule_id")), text("Condition:", c("rule_id"), ":", c("predicate_id"))
    expr = lambda node: text("Expr:", c("rule_id"), ":", node)

    def node(rows: DataFrame, rank: int, node_id: Column, of: Column, values: Column, *order: Column) -> DataFrame:
        return rows.select(node_id.alias("node_id"), of.alias("kind"), values.alias("props"), F.array(F.lit(rank).cast("string"), *(F.lpad(o.cast("string"), 12, "0") for o in order)).alias("at"))

    # what a rule becomes isn't counted by estimates that see the bytes of its file: joins are of shuffled rows, no side is broadcast
    by_rule = predicates.hint("merge").join(rules.select("rule_id", c("pos").alias("rule_pos")).hint("merge"), "rule_id")
    used = by_rule.select("rule_pos", "pos", "rule_id", "predicate_id", F.inline(F.array_compact(F.array(
        F.struct(F.lit("left").alias("side"), c("left_scope").alias("scope"), c("left_attr").alias("name")),
        F.when(c("right_kind") == "attribute", F.struct(F.lit("right").alias("side"), c("right_scope").alias("scope"), c("right_attr").alias("name"))),
    ))))
    p = F.struct("right_kind", "right_values", "right_type")
    whole = F.array(F.concat(F.lit("["), F.array_join(shown_items(p, True), ", "), F.lit("]")))
    literals = by_rule.filter(c("right_kind").isin("scalar", "set", "list")).select("rule_pos", "pos", "rule_id", "predicate_id", "left_attr", F.posexplode(F.when(c("right_kind") == "list", F.arrays_zip(whole.alias("id"), whole.alias("value"))).otherwise(F.arrays_zip(shown_items(p, True).alias("id"), c("right_values").alias("value")))).alias("nth", "v"))
    value = text("AttrValue:", c("left_attr"), ":", c("v.id"))
    inner = expressions.filter(F.upper("op") != "PRED")
    nodes = [
        node(made["policy"], 0, policy, F.lit("Policy"), props(domain=c("domain"), version=c("version"), combining=c("combining"))),
        node(attributes, 1, attribute(c("scope"), c("name")), kind(c("scope")), props(name=c("name"), datatype=c("datatype"))),
        node(rules.select(F.explode("actions").alias("name")).distinct(), 2, text("Action:", c("name")), F.lit("Action"), props(name=c("name"))),
        node(rules.hint("merge").join(rule_summaries(rules, predicates).hint("merge"), "rule_id"), 3, rule, F.lit("Rule"), props(effect=c("effect"), priority=c("priority"), source=c("source"), summary=c("summary")), c("pos")),
        node(inner, 3, expr(c("node_id")), F.lit("Expr"), props(op=c("op"))),
        node(predicates, 3, condition, F.lit("Condition"), props(op=c("op"), left=text(c("left_scope"), ".", c("left_attr")))),
        node(used, 4, attribute(c("scope"), c("name")), kind(c("scope")), props(name=c("name"), datatype=F.lit("string")), c("rule_pos"), c("pos")),
        node(literals, 4, value, F.lit("AttrValue"), props(name=c("left_attr"), value=c("v.value")), c("rule_pos"), c("pos"), c("nth")),
    ]
    everything = nodes[0]
    for rows in nodes[1:]:
        everything = everything.unionByName(rows)
    first = everything.groupBy("node_id").agg(F.min_by(F.struct("kind", "props"), "at").alias("n")).select("node_id", "n.kind", "n.props")

    edge = lambda rows, src, label, dst, side=None: rows.select(src.alias("src"), F.lit(label).alias("label"), dst.alias("dst"), (F.lit(None).cast("string") if side is None else side).alias("side"))
    ends = expressions.select(c("rule_id").alias("r"), c("node_id").alias("n"), (F.upper("op") == "PRED").alias("leaf"), c("predicate_id").alias("leaf_of"))
    leads = inner.select("rule_id", "node_id", F.explode("children").alias("child")).repartition(places, "rule_id", "child")
    children = leads.hint("merge").join(ends.repartition(places, "r", "n").hint("merge"), (c("rule_id") == c("r")) & (c("child") == c("n")))
    roots = rules.repartition(places, "rule_id", "root").hint("merge").join(ends.filter("NOT leaf").repartition(places, "r", "n").hint("merge"), (c("rule_id") == c("r")) & (c("root") == c("n")))
    edges = [
        edge(rules.join(F.broadcast(made["policy"])), policy, "HAS_RULE", rule),  # one row
        edge(rules.select("rule_id", F.explode("actions").alias("action")), rule, "USES_ACTION", text("Action:", c("action"))),
        edge(roots, rule, "HAS_COND", expr(c("root"))),
        edge(children, expr(c("node_id")), "CHILD", F.when(c("leaf"), text("Condition:", c("rule_id"), ":", c("leaf_of"))).otherwise(expr(c("child")))),
        edge(used, condition, "REF_ATTR", attribute(c("scope"), c("name")), c("side")),
        edge(literals, condition, "REF_VALUE", value),
    ]
    all_edges = edges[0]
    for rows in edges[1:]:
        all_edges = all_edges.unionByName(rows)
    return first, all_edges


def bounded_neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = 120) -> DataFrame:
    """seed and edges: of neighbourhood()'s edges of each seed the first by src, label and dst, limit at most, as an array.

    A node with many edges never shows more than its first limit ones, since no later one can be among a seed's first: they
    are chosen before anything is shuffled or joined. To find the nodes around a seed all edges are used, as pairs of ids
    alone; the seeds' edges are cut again before they are gathered.
    """
    plain = edges.select("src", "label", "dst")
    ends = plain.select(F.col("src").alias("at"), "src", "label", "dst").unionByName(plain.select(F.col("dst").alias("at"), "src", "label", "dst"))
    first = lambda by: Window.partitionBy(by).orderBy("src", "label", "dst")
    cut = lambda rows, by: rows.withColumn("__nth", F.dense_rank().over(first(by))).filter(F.col("__nth") <= limit).drop("__nth").distinct()
    shown = cut(ends, "at")
    around = seeds.select("seed", F.col("seed").alias("node")).distinct()
    ways = plain.select(F.col("src").alias("at"), F.col("dst").alias("to")).union(plain.select("dst", "src")).distinct()
    for _ in range(hops - 1):
        around = around.unionByName(around.join(ways, around.node == ways.at).select("seed", F.col("to").alias("node"))).distinct()
    met = cut(around.join(shown, around.node == shown.at).select("seed", "src", "label", "dst"), "seed")
    return met.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("src", "label", "dst"))).alias("edges"))
