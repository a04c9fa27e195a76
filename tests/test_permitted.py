"""Permitted pairs against deciding the whole product, for all kinds of links, and their plans."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdikt.model import Attribute, Expression, Policy, Predicate, Rule, all_of
from verdikt.operators.decide import decide
from verdikt.operators import totals
from verdikt.operators.permitted import permitted_pairs
from verdikt.plans.catalog import TRADE
from verdikt.plans.data_catalog import SALES, _traders

KINDS = {"n": "int", "x": "float", "s": "string", "many": "set[string]", "numbers": "set[int]"}
SCHEMA = "id int, n long, x double, s string, many array<string>, numbers array<long>"


def both(name, op, other=None):
    return Predicate(name, op, "subject", name[1:].rstrip("0123456789"), "resource", other or name[1:].rstrip("0123456789"))


def people(spark, scope, seed, n):
    draw = random.Random(seed)
    some = lambda items, k: sorted(draw.sample(items, draw.randint(0, k)))
    maybe = lambda v: None if draw.random() < 0.1 else v
    rows = [((i, maybe(draw.randint(0, 6)), maybe(draw.choice([0.0, 1.0, 2.5, -3.0])), maybe(draw.choice(["a", "b", "UNKNOWN", "c"])), maybe(some(["a", "b", "c", "d"], 3)), maybe(some([1, 2, 3, 4], 2))),) for i in range(n)]
    return spark.createDataFrame(rows + rows[:2], f"{scope} struct<{SCHEMA.replace(' ', ':').replace(',:', ', ')}>")


def policy(*rules):
    return Policy("p", rules, {(scope, n): Attribute(scope, n, kind) for scope in ("subject", "resource") for n, kind in KINDS.items()})


def tree(op, *predicates, effect="Permit"):
    leaves = {f"E{n}": Expression(f"E{n}", "PRED", predicate_id=p.predicate_id) for n, p in enumerate(predicates)}
    return Rule("T", effect, ("go",), {p.predicate_id: p for p in predicates}, {**leaves, "TOP": Expression("TOP", op, tuple(leaves))}, "TOP")


CASES = {
    "equal": [all_of("R", "Permit", ("go",), [both("Pn", "EQ"), both("Ps", "EQ")])],
    "equal of two types": [all_of("R", "Permit", ("go",), [both("Pn", "EQ", "x")])],
    "member": [all_of("R", "Permit", ("go",), [both("Pmany", "CONTAINS", "s")])],
    "member of two types": [all_of("R", "Permit", ("go",), [both("Pnumbers", "CONTAINS", "x")])],
    "include": [all_of("R", "Permit", ("go",), [both("Pmany", "SUPERSET")])],
    "included the other way": [all_of("R", "Permit", ("go",), [Predicate("P", "SUPERSET", "resource", "many", "subject", "many")])],
    "overlap": [all_of("R", "Permit", ("go",), [both("Pmany", "IN")])],
    "one in many": [all_of("R", "Permit", ("go",), [both("Ps", "IN", "many")])],
    **{f"order {op}": [all_of("R", "Permit", ("go",), [both("Px", op)])] for op in ("LT", "LE", "GT", "GE")},
    "order of two types": [all_of("R", "Permit", ("go",), [both("Pn", "LE", "x")])],
    "order of texts": [all_of("R", "Permit", ("go",), [both("Ps", "GT")])],
    "no link": [all_of("R", "Permit", ("go",), [both("Pn", "NEQ"), Predicate("P2", "GE", "subject", "n", right_value=2)])],
    "nothing asked": [all_of("R", "Permit", ("go",), [])],
    "types that never meet": [all_of("R", "Permit", ("go",), [both("Ps", "EQ", "n")])],
    "either, and a denial": [tree("OR", both("Pn", "EQ"), both("Pmany", "SUPERSET"), both("Px", "LT")), all_of("D", "Deny", ("go",), [both("Ps", "EQ"), Predicate("P2", "LT", "subject", "x", right_value=1)])],
    "negated": [tree("NOT", both("Pn", "EQ"))],
    "other operator": [tree("XOR", both("Pn", "EQ"))],
    "only denials": [all_of("D", "Deny", ("go",), [both("Pn", "EQ")])],
    "several rules": [all_of("A", "Permit", ("go",), [both("Pn", "EQ")]), all_of("B", "Permit", ("go",), [both("Ps", "EQ")]), all_of("C", "Permit", ("stay",), [])],
}


@pytest.mark.parametrize("name", CASES)
def test_pairs(spark, name):
    subjects, resources, made = people(spark, "subject", 1, 40), people(spark, "resource", 2, 30), policy(*CASES[name])
    product = subjects.crossJoin(resources).withColumn("action", F.lit("go"))
    want = Counter((r.subject.id, r.resource.id) for r in decide(product, made).filter("decision = 'Permit'").collect())
    found = permitted_pairs(subjects, resources, made, "go")
    assert Counter((r.subject.id, r.resource.id) for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert permitted_pairs(subjects.limit(0), resources, made, "go").collect() == []


def test_plans_of_queries(spark):
    subjects, resources = _traders(spark, "/root/testdata/sf0.001")
    plan = permitted_pairs(subjects, resources, TRADE, "N")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.rule_id for r in SALES.rules} == {"R1", "R2", "R3", "R4"}


@pytest.mark.parametrize("name", CASES)
def test_totals(spark, name, monkeypatch):
    """Totals over pairs by blocks, also where a subject or a resource meets several."""
    monkeypatch.setattr(totals, "SUBJECT_ROWS", 16)
    monkeypatch.setattr(totals, "RESOURCE_ROWS", 8)
    monkeypatch.setattr(totals, "MEMBERS", 3)
    subjects, resources, made = people(spark, "subject", 1, 40), people(spark, "resource", 2, 30), policy(*CASES[name])
    product = subjects.crossJoin(resources).withColumn("action", F.lit("go"))
    want = {}
    for r in decide(product, made).filter("decision = 'Permit'").collect():
        n, s = want.get(r.subject.id, (0, 0))
        want[r.subject.id] = (n + 1, s + r.resource.id)
    found = totals.permitted_totals(subjects, resources, made, "go", F.col("subject.id"), {"of": F.col("resource.id")})
    assert {r.key: (r.n, r.of) for r in found.collect()} == want


def test_totals_form_no_pairs(spark):
    """A pair of large numbers, and of subjects and resources far more than could be rows in the time."""
    side = lambda scope, n: spark.range(n).select(F.struct(F.col("id"), *(F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias(c) if c == "n" else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")[1:]))).alias(scope))
    found = totals.permitted_totals(side("subject", 20_000), side("resource", 20_000), policy(*CASES["no link"]), "go", F.col("subject.id"), {"of": F.col("resource.id") + 2**45})
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "NestedLoop" not in plan
    got = {r.key: (r.n, r.of) for r in found.filter("key < 12").collect()}
    there = [None if i % 3 == 0 else i % 7 for i in range(20_000)]
    for key in (2, 5, 11):
        ids = [i for i, n in enumerate(there) if n != there[key]]
        assert got[key] == (len(ids), sum(ids) + len(ids) * 2**45)
    assert 3 not in got and 1 not in got  # unknown, and below two


def test_members_are_numbered_by_block():
    """Pairs of blocks compare dictionaries, in which nulls and both zeros are one member each, in whatever chunks the rows come."""
    draw = random.Random(5)
    rows = [[[draw.choice([None, -0.0, 0.0, 1.5, 2.0, float("nan")]) for _ in range(draw.randint(0, 3))] for _ in range(n)] for n in (9, 7)]
    one = lambda r: [list({repr(0.0 if x == 0 else x): x for x in s}.values()) for s in r]
    a, b = (totals._numbered(pa.table({"x": pa.chunked_array([pa.array(r[:4], pa.list_(pa.float64())), pa.array(r[4:], pa.list_(pa.float64()))])})) for r in map(one, rows))
    assert all(pa.types.is_dictionary(t.schema.field("x").type.value_type) for t in (a, b))
    common, size_a, size_b = totals._shared(*(totals._array(t, "x") for t in (a, b)))
    key = lambda s: {repr(0.0 if x == 0 else x) for x in s}
    assert common.tolist() == [[len(key(p) & key(q)) for q in one(rows[1])] for p in one(rows[0])]
    assert size_a[:, 0].tolist() == [len(p) for p in one(rows[0])]


@pytest.mark.parametrize("mapped", [512, 2])
@pytest.mark.parametrize("name", CASES)
def test_totals_by_bits(spark, name, mapped, monkeypatch):
    """Blocks of more than a word, in slices of a few rows, with a bitmap for each value and without, equal resources met as one."""
    for constant, value in (("SUBJECT_ROWS", 100), ("RESOURCE_ROWS", 70), ("WORDS", 26), ("STEP", 3), ("MAPPED", mapped)):
        monkeypatch.setattr(totals, constant, value)
    subjects, resources, made = people(spark, "subject", 3, 110), people(spark, "resource", 4, 140), policy(*CASES[name])
    resources = resources.unionByName(resources.select(resources.resource.withField("id", resources.resource.id + 1000).alias("resource")))
    product = subjects.crossJoin(resources).withColumn("action", F.lit("go"))
    want = {}
    for r in decide(product, made).filter("decision = 'Permit'").select("subject.id", F.col("resource.id").alias("of")).groupBy("id").agg(F.count("*").alias("n"), F.sum("of").alias("of")).collect():
        want[r.id] = (r.n, r.of)
    found = totals.permitted_totals(subjects, resources, made, "go", F.col("subject.id"), {"of": F.col("resource.id").cast("long")})
    assert {r.key: (r.n, r.of) for r in found.collect()} == want


def test_equal_resources_are_one(spark):
    """Of a great many resources in a few kinds and many subjects, whose pairs couldn't be judged one by one in the time."""
    side = lambda scope, n: spark.range(n).select(F.struct(F.col("id"), *((F.col("id") % 7 if c == "n" else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")[1:]))).alias(scope))
    found = totals.permitted_totals(side("subject", 100_000), side("resource", 2_000_000), policy(*CASES["no link"]), "go", F.col("subject.id"), {"of": F.col("resource.id")})
    got = {r.key: (r.n, r.of) for r in found.filter("key < 7").collect()}
    each = {k: (len(range(k, 2_000_000, 7)), sum(range(k, 2_000_000, 7))) for k in range(7)}
    assert got == {k: tuple(sum(each[o][i] for o in each if o != k) for i in (0, 1)) for k in range(2, 7)}


def test_weights_are_summed_over_bits():
    """Numbers of any size and sign, in blocks that end within a word and are wider than sums of lanes."""
    draw = random.Random(9)
    for rows, most in ((1, 5), (64, 1), (700, 2**50), (300_000, 3)):
        weights = [draw.randint(-most, most) for _ in range(rows)]
        words = -(-rows // 64)
        marks = [[draw.random() < 0.9 for _ in range(rows)] for _ in range(2)]
        bits = np.concatenate([totals._bitmaps(np.zeros(sum(m), int), np.flatnonzero(m), 1, words) for m in marks])
        got = totals._Weights(np.array(weights), words).sums(bits, np.bitwise_count(bits), np.empty_like(bits))
        assert got.tolist() == [sum(w for w, m in zip(weights, mark, strict=True) if m) for mark in marks]


def test_unions_of_bitmaps():
    """Tables of eight bitmaps each, for rows that mark many of them, few or none."""
    draw = random.Random(11)
    bitmaps = np.array([[draw.getrandbits(64) for _ in range(3)] for _ in range(19)], np.uint64)
    masks = np.array([[draw.random() < p for _ in range(19)] for p in (0, 0, 0.05, 0.5, 1, 0.05, 0)])
    rows = np.array([4, 0, 2, 3, 5, 6])
    union = totals._unions(masks, bitmaps)
    for some in (rows, rows[:1], rows[1:2]):
        assert union(some).tolist() == [np.bitwise_or.reduce(bitmaps[masks[r]], initial=np.uint64(0)).tolist() for r in some]
