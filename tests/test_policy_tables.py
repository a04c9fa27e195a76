"""Policies as tables against the same things made on the driver: graph, summaries, lines, sketches, neighbourhoods, top texts."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests import observatory
from verdikt.functions.text import token_set
from verdikt.model import Attribute, Policy, Predicate, all_of
from verdikt.operators.graph import bounded_neighbourhood, graph_tables, policy_graph, rule_summaries, summary
from verdikt.operators.retrieve import sketch_requests, top_texts
from verdikt.sources.literals import split_outside
from verdikt.sources.policies import entities, parse_policy, tables
from verdikt.sources.policy_lines import declared_attributes, entity_attributes, read_policy_lines, rule_tables, split_outside_column, typed_entities


@pytest.fixture(scope="module")
def policies():
    odd = Policy("odd", (
        all_of("R1", "Deny", ("go",), [Predicate("P1", "EQ", "subject", "name", right_value="it's"), Predicate("P2", "IN", "subject", "n", right_value={3, 1}), Predicate("P3", "EQ", "subject", "flag", right_value=True), Predicate("P4", "EQ", "environment", "x", right_value=None)]),
        all_of("R2", "Permit", ("go", "stay"), [Predicate("P1", "EQ", "subject", "name", right_value='say "it\'s"'), Predicate("P2", "EQ", "subject", "names", right_value=["b", "a"]), Predicate("P3", "LT", "subject", "n", "resource", "n"), Predicate("P4", "GE", "subject", "x", right_value=2.5)]),
        all_of("R3", "Permit", ("wait",), []),
    ), {("subject", "n"): Attribute("subject", "n", "int")})
    return [parse_policy(observatory.text(), "observatory"), odd]


def rows(df):
    return Counter(tuple(str(sorted(v.items())) if isinstance(v, dict) else str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("nth", [0, 1])
def test_graph(spark, policies, nth):
    nodes, edges = policy_graph(spark, policies[nth])
    made_nodes, made_edges = graph_tables(tables(spark, policies[nth]))
    assert rows(made_nodes) == rows(nodes)
    assert rows(made_edges) == rows(edges)
    made = tables(spark, policies[nth])
    assert {r.rule_id: r.summary for r in rule_summaries(made["rules"], made["predicates"]).collect()} == {r.rule_id: summary(r) for r in policies[nth].rules}


def test_split(spark):
    draw = random.Random(1)
    texts = ["", ",", "a,b", "a={1,2},b", "x(1,2),y", "),a,(b,c),d", "{a,{b,c},d},e", "{a,b", "} {,}"] + ["".join(draw.choices("ab,{}() ", k=draw.randint(0, 25))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_outside_column(F.col("t"), ",").alias("parts")).collect()
    for r in got:
        assert r.parts == split_outside(r.t, ","), r.t


def test_lines(spark, tmp_path, policies):
    (tmp_path / "policy.txt").write_text(observatory.text() + "\nuserAttrib(lyra, role=guest, hostOf={mira}) # again\nrule(odd ? condition; ; {view}; )\n")
    want = parse_policy(observatory.text() + "\nuserAttrib(lyra, role=guest, hostOf={mira})", "observatory")
    made = read_policy_lines(spark, str(tmp_path / "policy.txt"))
    assert {(r.scope, r.name): (r.datatype, r.multivalue) for r in made["attributes"].collect()} == {k: (a.datatype, a.multivalue) for k, a in want.attributes.items()}
    for scope, key in (("subject", "uid"), ("resource", "rid")):
        own = entities(spark, want, scope).drop("pos")
        names = sorted(own.columns)
        assert rows(typed_entities(made["entities"], made["attributes"], scope).select(*names)) == rows(own.select(*names)), key
    expected = tables(spark, want)
    assert rows(made["rules"].filter("rule_id <> 'R6'").select("rule_id", "pos", F.array_join("actions", "+"), "effect")) == rows(expected["rules"].select("rule_id", "pos", F.array_join("actions", "+"), "effect"))
    same = ["rule_id", "predicate_id", "pos", "op", "left_scope", "left_attr", "right_scope", "right_attr", "right_kind", "right_type"]
    assert rows(made["predicates"].filter("op IS NOT NULL").select(*same, F.array_join("right_values", "+"))) == rows(expected["predicates"].select(*same, F.array_join("right_values", "+")))
    assert [r.said for r in made["predicates"].filter("op IS NULL").collect()] == ["odd ? condition"]


def test_no_lines(spark):
    nothing = spark.createDataFrame([("# only this",), (None,)], "value string")
    attributes = entity_attributes(nothing)
    assert attributes.collect() == declared_attributes(attributes).collect() == []
    assert typed_entities(attributes, declared_attributes(attributes), "subject").collect() == []
    assert all(df.collect() == [] for df in rule_tables(nothing).values())


def test_numbers_over_parts(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"part{n}.txt").write_text("".join(f"rule(; ; {{a{n}}}; k={n * 7 + i})\n" for i in range(7)))
    made = read_policy_lines(spark, str(tmp_path))
    assert sorted(r.pos for r in made["rules"].collect()) == list(range(35))
    assert sorted(int(r.right_values[0]) for r in made["predicates"].collect()) == list(range(35))


def test_bounded_neighbourhood(spark):
    draw = random.Random(2)
    edges = [(f"n{draw.randint(0, 12)}", draw.choice("xy"), f"n{draw.randint(0, 12)}") for _ in range(60)] + [("hub", "x", f"leaf{n:03}") for n in range(300)] + [("n1", "z", "hub"), ("n1", "z", "hub")]
    df = spark.createDataFrame(edges, "src string, label string, dst string")
    seeds = ["n1", "hub", "leaf007", "alone", "n5"]
    for limit, hops in ((10, 2), (500, 2), (3, 1), (20, 3)):
        got = {r.seed: [tuple(e) for e in r.edges] for r in bounded_neighbourhood(df, spark.createDataFrame([(s,) for s in seeds], "seed string"), hops, limit).collect()}
        for seed in seeds:
            near = {seed}
            for _ in range(hops - 1):
                near |= {x for s, _, d in edges if s in near or d in near for x in (s, d)}
            want = sorted({e for e in edges if e[0] in near or e[2] in near})[:limit]
            assert got.get(seed, []) == want, (seed, limit, hops)


def test_sketches(spark):
    people = spark.createDataFrame([(2, "Ann", {"role": "x"}), (1, "bob", {"role": "y", "n": "1"}), (3, "ANN", {"role": "z"}), (4, "two words", {})], "pos int, name string, attributes map<string,string>")
    things = spark.createDataFrame([], "pos int, name string, attributes map<string,string>")
    texts = [(1, "may ann READ it"), (2, "Ann or Bob, read"), (3, None), (4, "two words subject.role=k, action=write subject.role=w"), (5, "bob subject.N=5 resource.a=b=c")]
    got = {r.i: r for r in sketch_requests(spark.createDataFrame(texts, "i int, t string"), people, things, ["read", "write"], "i", "t").collect()}
    assert [(got[i].subject_id, got[i].action) for i in range(1, 6)] == [("Ann", "read"), ("bob", "read"), (None, None), (None, "write"), ("bob", None)]
    assert got[2].subject == {"role": "y", "n": "1"} and got[3].subject == {} and got[4].subject == {"role": "w"}
    assert got[5].subject == {"role": "y", "n": "5"} and got[5].resource == {"a": "b=c"} and got[5].resource_id is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_texts(spark, seed):
    """Common and rare words, ties, texts and queries without words, repeated texts."""
    draw = random.Random(seed)
    words = [f"w{n}" for n in range(60)]
    some = lambda k: " ".join(words[min(59, int(draw.paretovariate(0.6)) - 1)] for _ in range(draw.randint(0, k)))
    texts = [(n, some(25)) for n in range(150)] + [(150, None), (151, "of its own"), (152, "w0"), (153, "w0")]
    queries = [(n, some(12)) for n in range(25)] + [(30, ""), (31, None), (32, "unseen words"), (33, texts[7][1])]
    tokens = lambda t: set((t or "").split())
    for k in (1, 5, 200):
        found = top_texts(spark.createDataFrame(queries, "q int, t string"), spark.createDataFrame(texts, "d int, t string"), k, "q", "t", "d", "t")
        got = defaultdict(list)
        for r in found.orderBy("q", "rank").collect():
            got[r.q].append((r.d, r.score))
        for q, t in queries:
            own = tokens(t)
            want = sorted(((len(own & tokens(x)) / max(1, len(own)), d) for d, x in texts), reverse=True)[:k]
            assert got[q] == [(d, s) for s, d in want], (q, k)
    assert spark.range(1).select(F.size(token_set(F.lit("A a b")))).first()[0] == 2


def test_counterfactuals_by_classes(spark):
    """Values in classes against trying every one: literals, equality with another attribute, order and membership between attributes, sets."""
    from verdikt.operators.decide import decide
    from verdikt.operators.workload import counterfactual

    kinds = (("n", "int"), ("m", "int"), ("s", "string"), ("many", "set[string]"))
    declared = {(scope, n): Attribute(scope, n, kind) for scope in ("subject", "resource") for n, kind in kinds}
    literal = lambda op, a, v, scope="subject", name="P1": Predicate(name, op, scope, a, right_value=v)
    between = lambda op, a, b, name="P2": Predicate(name, op, "subject", a, "resource", b)
    rules = {
        "classes": [all_of("R1", "Permit", ("go",), [literal("GE", "n", 4), literal("NEQ", "s", "b", name="P2")]), all_of("R2", "Deny", ("go",), [literal("GT", "n", 7)])],
        "equal": [all_of("R1", "Permit", ("go",), [literal("GE", "n", 2), between("EQ", "n", "m")]), all_of("R2", "Permit", ("go",), [between("NEQ", "s", "s", "P1"), literal("EQ", "m", 3, "resource", "P2")])],
        "order": [all_of("R1", "Permit", ("go",), [between("LT", "n", "n", "P1")]), all_of("R2", "Deny", ("go",), [between("CONTAINS", "many", "s", "P1")])],
    }
    draw = random.Random(6)
    row = lambda: (draw.randint(0, 9), draw.randint(0, 9), draw.choice("abc"), sorted(draw.sample("abcd", draw.randint(0, 2))))
    people, things = [row() for _ in range(14)], [row() for _ in range(9)]
    schema = "struct<n:bigint,m:bigint,s:string,many:array<string>>"
    asked = [(i, u, t, "go", "t", "qa", "q") for i, (u, t) in enumerate((u, t) for u in people for t in things)]
    requests = spark.createDataFrame(asked, f"pos int, subject {schema}, resource {schema}, action string, task_id string, task_type string, query string")
    names = [n for n, _ in kinds]
    domains = {(scope, n): spark.createDataFrame([(r[at],) for r in own] + [(None,)], f"candidate {dict(zip(names, ('bigint', 'bigint', 'string', 'array<string>'), strict=True))[n]}") for scope, own in (("subject", people), ("resource", things)) for at, n in enumerate(names)}
    shown = lambda v: " ".join(v) if isinstance(v, list) else str(v)
    for made in rules.values():
        policy = Policy("p", tuple(made), declared)
        changes = []
        for i, u, t, *_ in asked:
            for rank, scope, own, everyone in ((0, "subject", u, people), (1, "resource", t, things)):
                for at, name in enumerate(names):
                    for v in {str(e[at]): e[at] for e in everyone if e[at] != own[at]}.values():
                        new = tuple(v if j == at else own[j] for j in range(4))
                        changes.append((i, new if rank == 0 else u, new if rank else t, "go", rank, name, shown(v), scope))
        tried = decide(spark.createDataFrame(changes, f"pos int, subject {schema}, resource {schema}, action string, rank int, attr string, value string, scope string"), policy).collect()
        now = {r.pos: r.decision for r in decide(requests, policy).collect()}
        want = {}
        for r in tried:
            target = "Deny" if now[r.pos] == "Permit" else "Permit"
            if r.decision == target:
                want[r.pos] = min(want.get(r.pos, (9,)), (r["rank"], r.attr, r.value, r.scope, target))
        got = {r.pos: (0 if r.cf_scope == "subject" else 1, r.cf_attr, r.cf_value, r.cf_scope, r.cf_target) for r in counterfactual(spark, policy, requests, F.lit(1), "pos", domains).collect() if r.cf_attr}
        assert got == want and want


@pytest.mark.parametrize(("n", "k"), [(0, 3), (1, 1), (2, 5), (5, 5), (37, 20), (1000, 1000), (4097, 100)])
def test_drawn(spark, n, k):
    from verdikt.operators.workload import drawn

    rows = drawn(spark, n, k, 5).collect()
    assert sorted(r.nth for r in rows) == list(range(min(n, k)))
    assert len({r.pos for r in rows}) == len(rows) and all(0 <= r.pos < n for r in rows)
    again = drawn(spark, n, k, 5).repartition(7).orderBy("nth").collect()
    assert [(r.nth, r.pos) for r in again] == sorted((r.nth, r.pos) for r in rows)
    if n > 30:
        assert [r.pos for r in again] != sorted(r.pos for r in rows)
        assert [r.pos for r in drawn(spark, n, k, 6).orderBy("nth").collect()] != [r.pos for r in again]


def test_summaries_shuffle_rules_alone(spark):
    """Only nodes of rules reach the aggregation that the summaries are read from."""
    from verdikt.plans.data_catalog import part_graph_summaries

    plan = part_graph_summaries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Aggregate [node_id") < plan.find("StartsWith(")
