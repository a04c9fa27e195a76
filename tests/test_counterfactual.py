"""Counterfactual tasks: how often requests are read, and odd values against trying every one."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from verdikt.model import UNKNOWN_TOKEN, Attribute, Expression, Policy, Predicate, Rule, all_of
from verdikt.operators.decide import decide
from verdikt.operators.workload import counterfactual

NAMES = ("n", "m", "s", "t")
SCHEMA = "struct<n:bigint,m:bigint,s:string,t:string>"
DECLARED = {(scope, n): Attribute(scope, n, "int" if n in "nm" else "string") for scope in ("subject", "resource") for n in NAMES}


def literal(name, op, attr, value, scope="subject"):
    return Predicate(name, op, scope, attr, right_value=value)


def between(name, op, attr, other, scope="resource"):
    return Predicate(name, op, "subject", attr, scope, other)


def without(rule_id, effect, test, *others):
    """A rule that holds where its first test doesn't and the others do."""
    tests = {p.predicate_id: p for p in (test, *others)}
    leaves = {f"E{n}": Expression(f"E{n}", "PRED", (), p) for n, p in enumerate(tests)}
    return Rule(rule_id, effect, ("go",), tests, leaves | {"NO": Expression("NO", "NOT", ("E0",)), "TOP": Expression("TOP", "AND", ("NO", *(f"E{n}" for n in range(1, len(tests)))))}, "TOP")


def test_requests_read_once(spark):
    """No request is read again for an attribute, or made a row for a value."""
    policy = Policy("p", (all_of("R1", "Permit", ("go",), [literal("P1", "GE", "n", 4), literal("P2", "NEQ", "s", "b"), between("P3", "EQ", "m", "m")]),), DECLARED)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    row = F.struct((F.col("id") % 7).alias("n"), (F.col("id") % 3).alias("m"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"), F.lit("x").alias("t"))
    asked = spark.range(500).select(F.col("id").alias("pos"), row.alias("subject"), row.alias("resource"), F.lit("go").alias("action"), F.lit("t").alias("task_id"), F.lit("qa").alias("task_type"), F.lit("q").alias("query"))
    domains = {(scope, n): spark.range(21).select(row.getField(n).alias("candidate")) for scope in ("subject", "resource") for n in NAMES}
    found = counterfactual(spark, policy, asked.mapInArrow(counted, asked.schema), F.lit(1), "pos", domains).collect()
    assert len(found) == 500 and {"n", "s"} <= {r.cf_attr for r in found}
    assert read.value == 500


def test_odd_values(spark):
    """Nulls, the unknown token, attributes that aren't known, negation, two others, and attributes whose values are tried as rows."""
    rules = {
        "negated": [without("R1", "Deny", literal("P1", "EQ", "s", "c")), all_of("R2", "Permit", ("go",), [literal("P1", "GE", "n", 3)])],
        "unlike": [without("R1", "Deny", between("P1", "EQ", "s", "s"), literal("P2", "LT", "n", 3)), all_of("R2", "Permit", ("go",), [literal("P1", "GE", "m", 3, "resource")])],
        "two": [all_of("R1", "Permit", ("go",), [between("P1", "EQ", "s", "s"), between("P2", "NEQ", "s", "t", "subject")]), all_of("R2", "Deny", ("go",), [literal("P1", "IN", "s", {"a", "d"}), literal("P2", "EQ", "t", "a", "resource")])],
        "mixed": [all_of("R1", "Permit", ("go",), [between("P1", "LE", "n", "m"), literal("P2", "NEQ", "s", "a")]), all_of("R2", "Deny", ("go",), [between("P1", "EQ", "m", "m")])],
    }
    draw = random.Random(3)
    number, word = (lambda: draw.choice([None, *range(6)])), (lambda: draw.choice([None, UNKNOWN_TOKEN, *"abcd"]))
    row = lambda: (number(), number(), word(), word())
    people, things = [row() for _ in range(12)], [row() for _ in range(9)]
    lacks = [None, [], ["subject.s"], ["resource.s"], ["subject.n", "resource.m"]]
    asked = [(i, u, t, draw.choice(("go", "go", "go", None)), draw.choice(lacks), "t", "qa", "q") for i, (u, t) in enumerate((u, t) for u in people for t in things)]
    requests = spark.createDataFrame(asked, f"pos int, subject {SCHEMA}, resource {SCHEMA}, action string, unknown array<string>, task_id string, task_type string, query string").cache()
    domains = {(scope, n): spark.createDataFrame([(r[at],) for r in own], f"candidate {'bigint' if n in 'nm' else 'string'}") for scope, own in (("subject", people), ("resource", things)) for at, n in enumerate(NAMES)}
    for name, made in rules.items():
        policy, changes = Policy("p", tuple(made), DECLARED), []
        for i, u, t, action, unknown, *_ in asked:
            for rank, scope, own, everyone in ((0, "subject", u, people), (1, "resource", t, things)):
                for at, attr in enumerate(NAMES):
                    for v in {e[at] for e in everyone} - {None, own[at]} if own[at] is not None else ():
                        new = tuple(v if j == at else own[j] for j in range(4))
                        changes.append((i, new if rank == 0 else u, new if rank else t, action, unknown, rank, attr, str(v), scope))
        tried = decide(spark.createDataFrame(changes, f"pos int, subject {SCHEMA}, resource {SCHEMA}, action string, unknown array<string>, rank int, attr string, value string, scope string"), policy).collect()
        now, want = {r.pos: r.decision for r in decide(requests, policy).collect()}, {}
        for r in tried:
            target = "Deny" if now[r.pos] == "Permit" else "Permit"
            if r.decision == target:
                want[r.pos] = min(want.get(r.pos, (9,)), (r["rank"], r.attr, r.value, r.scope, target))
        found = counterfactual(spark, policy, requests, F.lit(1), "pos", domains).collect()
        got = {r.pos: (0 if r.cf_scope == "subject" else 1, r.cf_attr, r.cf_value, r.cf_scope, r.cf_target) for r in found if r.cf_attr}
        assert got == want and want and len(found) == len(asked), name


def test_many_values(spark):
    """More values than a row keeps: those equal to another attribute are met by a join."""
    policy = Policy("p", (all_of("R1", "Permit", ("go",), [between("P1", "EQ", "n", "n"), literal("P2", "NEQ", "s", "b")]),), DECLARED)
    row = lambda n, s: F.struct(n.alias("n"), F.lit(1).cast("long").alias("m"), s.alias("s"), F.lit("x").alias("t"))
    pos = F.col("id")
    asked = spark.range(40).select(pos.alias("pos"), row(pos, F.lit("a")).alias("subject"), row(pos * 20 + 5, F.lit("a")).alias("resource"), F.lit("go").alias("action"), F.lit("t").alias("task_id"), F.lit("qa").alias("task_type"), F.lit("q").alias("query"))
    domains = {("subject", "n"): spark.range(600).select(pos.alias("candidate")), ("subject", "s"): spark.createDataFrame([("a",), ("b",)], "candidate string")}
    got = {r.pos: (r.cf_target, r.cf_attr, r.cf_value) for r in counterfactual(spark, policy, asked, F.lit(1), "pos", domains).collect()}
    assert got == {n: ("Permit", "n", str(n * 20 + 5)) if n * 20 + 5 < 600 else (None, None, None) for n in range(40)}


def test_request_without_action(spark, tmp_path):
    """Lines without a flag, as in SQL."""
    db = duckdb.connect()
    db.execute("CREATE TABLE customer AS SELECT i::BIGINT AS c_custkey, CASE i % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS c_mktsegment, i * 1500.0::DOUBLE - 500 AS c_acctbal, (i % 3)::INT AS c_nationkey FROM range(1, 6) t(i)")
    db.execute("CREATE TABLE supplier AS SELECT i::BIGINT AS s_suppkey, 'S' || i AS s_name, i * 700.0::DOUBLE AS s_acctbal, (i % 2)::INT AS s_nationkey FROM range(1, 4) t(i)")
    db.execute("CREATE TABLE orders AS SELECT i::BIGINT AS o_orderkey, (1 + i % 5)::BIGINT AS o_custkey FROM range(30) t(i)")
    db.execute("CREATE TABLE lineitem AS SELECT i::BIGINT AS l_orderkey, n::INT AS l_linenumber, (1 + (i + n) % 3)::BIGINT AS l_suppkey, CASE (i + n) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS l_returnflag FROM range(30) t(i), range(3) u(n)")
    for table in ("customer", "supplier", "orders", "lineitem"):
        db.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    shown = lambda rows: sorted(map(str, rows))
    want = db.execute(__spark_entry__.oracle_sql()["counterfactual_requests"]).fetchall()
    got = __spark_entry__.queries()["counterfactual_requests"](spark, str(tmp_path)).collect()
    assert shown(tuple(r) for r in got) == shown(want) and any(r[0] is None for r in want)
