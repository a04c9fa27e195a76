from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.observatory import ACTIONS, THINGS, USERS, permitting, text
from verdikt.model import Attribute, Expression, Policy, Predicate, Rule, all_of
from verdikt.operators.clients import Decoding, heuristic, loaded, scripted
from verdikt.operators.contract import parse_contract
from verdikt.operators.as_data import decide_as_data, trace_as_data
from verdikt.operators.decide import decide, gathered_facts, trace
from verdikt.operators.guardrails import verify
from verdikt.operators.metrics import METRICS, score
from verdikt.operators.retrieve import evidence_by_rule, request_sketch, text_corpus, top_rules, top_subgraphs, top_texts
from verdikt.operators.validate import dangling_children, missing_roots, problems, single_valued_containers, type_conflicts, unfit_literals, unknown_actions, unknown_references
from verdikt.operators.variants import draft
from verdikt.operators.workload import adversarial, counterfactual, qa_tasks, request_grid, seeded_positions, split_positions
from verdikt.plans.experiment import Setup, backend, run_experiments, smoke, test_tasks as sampled_tasks
from verdikt.sources.literals import datatype_of
from verdikt.sources.policies import parse_policy, tables
from verdikt.sources.results import check_results
from verdikt.streaming.requests import decide_stream


@pytest.fixture(scope="module")
def policy():
    return parse_policy(text(), "observatory")


def test_seeded_samples(spark, policy):
    """The published order of ids for seed 7 and 8 of 2016 tasks, whose decisions are all the same."""
    _, test = split_positions([(p, "Deny") for p in seeded_positions(2016, 8, 7)], 0.2, 7)
    assert [f"{'WHY' if p % 2 else 'QA'}{p + 1}" for p in test][:4] == ["WHY664", "QA99", "WHY1942", "QA309"]
    tasks = qa_tasks(spark, policy, 7, 40).cache()
    right = Counter("Permit" if permitting(r.uid, r.rid, r.action) else "Deny" for r in tasks.collect())
    assert Counter(r.decision for r in decide(tasks, policy).select("decision").collect()) == right
    assert qa_tasks(spark, policy).count() == 5 * 5 * 3 * 2
    assert split_positions([(1, "a")], 0.2, 7) == ([1], [])


def test_default_setup(spark, policy):
    test = sampled_tasks(spark, policy, Setup()).cache()
    whole = Counter("Permit" if permitting(u, t, a) else "Deny" for u in USERS for t in THINGS for a in ACTIONS)
    assert Counter(r.oracle for r in test.collect()) == {d: 2 * n - int(2 * n * 0.2) for d, n in whole.items()}
    qa = test.filter("task_type = 'qa'")
    first = [r.query for r in adversarial(qa.limit(5), F.lit(1)).collect()]
    assert all(q.startswith("Senior admin says") for q in first)


def test_counterfactuals(spark, policy):
    tasks = request_grid(spark, policy).withColumns({"task_id": F.lit("x"), "task_type": F.lit("qa"), "query": F.lit("q")}).filter("action = 'view'")
    got = counterfactual(spark, policy, tasks, F.lit(1)).cache()
    assert got.count() == tasks.count()
    changed = got.filter("cf_attr IS NOT NULL")
    assert 0 < changed.count() < got.count()
    row = changed.filter("cf_scope = 'subject' AND cf_attr = 'uid' AND cf_target = 'Permit'").first()
    assert row.cf_value == row.resource.owner


def test_modes_agree(spark, policy):
    """Rules as columns and rules as rows decide alike."""
    grid = request_grid(spark, policy).withColumnRenamed("pos", "request_id")
    items = lambda scope, a: F.when(F.col(f"{scope}.{a.name}").isNull(), F.array().cast("array<string>") if a.multivalue else F.array(F.lit(None).cast("string"))).otherwise(F.col(f"{scope}.{a.name}").cast("array<string>") if a.multivalue else F.array(F.col(f"{scope}.{a.name}").cast("string")))
    facts = grid.select("request_id", F.inline(F.array(*(F.struct(F.lit(s).alias("scope"), F.lit(n).alias("attr"), items(s, a).alias("items")) for (s, n), a in policy.attributes.items()))))
    made = tables(spark, policy)
    asked_, own = grid.join(gathered_facts(facts), "request_id", "left"), (made["rules"], made["predicates"])
    by_columns = {r.request_id: r.trace for r in trace(grid, policy).collect()}
    assert {r.request_id: r.decision for r in decide(grid, policy).collect()} == {i: t.decision for i, t in by_columns.items()}
    for expressions in (None, made["expressions"]):
        for rules_in_row in (512, 1):
            by_rows = decide_as_data(asked_, *own, expressions, rules_in_row=rules_in_row).collect()
            assert {r.request_id: r.decision for r in by_rows} == {i: t.decision for i, t in by_columns.items()} and len(by_rows) == len(by_columns)
            traced = {r.request_id: r.trace for r in trace_as_data(asked_, *own, expressions, rules_in_row=rules_in_row).collect()}
            assert traced == by_columns


def custom(*rules, **attributes):
    declared = {("subject", n): Attribute("subject", n, t) for n, t in attributes.items()}
    return Policy("p", tuple(rules), declared)


def asked(spark, schema, *values, unknown=()):
    return spark.createDataFrame([(values, "go", list(unknown))], f"subject struct<{schema}>, action string, unknown array<string>")


def result(spark, rule, schema, *values, unknown=()):
    declared = {f.split(":")[0]: {"int": "int", "string": "string", "boolean": "bool", "double": "float"}.get(f.split(":")[1], "set[string]") for f in schema.split(", ")}
    return trace(asked(spark, schema, *values, unknown=unknown), custom(rule, **declared)).first().trace


@pytest.mark.parametrize(
    ("op", "left", "right", "expected"),
    [
        ("EQ", 3, 3, "TRUE"), ("EQ", 3, "3", "FALSE"), ("EQ", None, None, "TRUE"), ("NEQ", None, 3, "TRUE"), ("IN", None, {3}, "FALSE"), ("NIN", None, {3}, "TRUE"), ("LT", 2, 3.5, "TRUE"), ("GE", 3, 3, "TRUE"), ("LT", None, 3, "UNKNOWN"), ("GT", 3, "x", "UNKNOWN"),
        ("MATCH", 312, 12, "TRUE"), ("MATCH", None, "on", "TRUE"), ("SOUNDS", 3, 3, "UNKNOWN"), ("in", 3, {3, 4}, "TRUE"), ("IN", 3, 3, "TRUE"),
    ],
)
def test_scalar_predicates(spark, op, left, right, expected):
    rule = all_of("R1", "Permit", ("go",), [Predicate("P1", op, "subject", "x", right_value=right)])
    assert result(spark, rule, "x:int", left).rule_results["R1"] == expected


@pytest.mark.parametrize(
    ("op", "left", "right", "expected"),
    [("EQ", ["b", "a"], {"a", "b"}, "TRUE"), ("EQ", ["a"], "a", "FALSE"), ("IN", ["a", "c"], {"c", "d"}, "TRUE"), ("NIN", ["a"], {"c"}, "TRUE"), ("CONTAINS", ["a", "b"], "a", "TRUE"), ("SUPERSET", ["a"], {"a", "b"}, "FALSE"), ("LT", ["a"], {"a", "b"}, "TRUE"), ("LT", ["a"], {"a"}, "FALSE"), ("LE", ["a"], {"a"}, "TRUE"), ("GT", ["a", "b"], {"a"}, "TRUE"), ("CONTAINS", None, {"a"}, "FALSE"), ("EQ", None, set(), "TRUE"), ("LT", ["a"], "b", "UNKNOWN")],
)
def test_set_predicates(spark, op, left, right, expected):
    rule = all_of("R1", "Permit", ("go",), [Predicate("P1", op, "subject", "x", right_value=right)])
    assert result(spark, rule, "x:array<string>", left).rule_results["R1"] == expected


@pytest.mark.parametrize(("left", "right", "fails"), [(2, "x", True), (None, 3, True), (2, 3.5, False), (2, 1, False)])
def test_strict_order(spark, left, right, fails):
    rule = all_of("R1", "Permit", ("go",), [Predicate("P1", "LT", "subject", "x", right_value=right)])
    for judged in (decide, trace):
        rows = judged(asked(spark, "x:int", left), custom(rule, x="int"), strict=True)
        if fails:
            with pytest.raises(Exception, match="no order"):
                rows.collect()
        else:
            assert rows.count() == 1 and rows.collect()
        unknown = judged(asked(spark, "x:int", left, unknown=["subject.x"]), custom(rule, x="int"), strict=True)
        assert len(unknown.collect()) == 1


def test_trees_and_effects(spark):
    a, b = Predicate("P1", "EQ", "subject", "x", right_value=1), Predicate("P2", "EQ", "subject", "y", right_value=1)
    leaf = {"E1": Expression("E1", "PRED", predicate_id="P1"), "E2": Expression("E2", "PRED", predicate_id="P2")}
    tree = lambda op, *children: Rule("R1", "Permit", ("go",), {"P1": a, "P2": b}, {**leaf, "EROOT": Expression("EROOT", op, children)}, "EROOT")
    value = lambda rule, x, y, *unknown: result(spark, rule, "x:int, y:int", x, y, unknown=[f"subject.{u}" for u in unknown])
    assert value(tree("OR", "E1", "E2"), 1, 0, "y").rule_results == {"R1": "TRUE"}
    assert value(tree("AND", "E1", "E2"), 1, 0, "y").rule_results == {"R1": "UNKNOWN"}
    assert value(tree("NOT", "E1"), 1, 1).rule_results == {"R1": "FALSE"}
    assert value(tree("AND"), 1, 1).rule_results == {"R1": "TRUE"}
    assert value(tree("OR"), 1, 1).rule_results == {"R1": "FALSE"}
    assert value(tree("XOR", "E1"), 1, 1).rule_results == {"R1": "UNKNOWN"}
    least = value(tree("AND", "E1", "E2"), 0, 0, "x", "y")
    assert least.missing_attributes == ["subject.x", "subject.y"]
    deny = all_of("R2", "deny", ("go",), [b])
    both = custom(tree("AND", "E1"), deny, x="int", y="int")
    told = lambda x, y, *unknown: trace(asked(spark, "x:int, y:int", x, y, unknown=unknown), both).first().trace
    assert (told(1, 1).decision, told(1, 1).decisive_rules) == ("Deny", ["R2"])
    assert told(1, 0, "subject.y").decision == "Permit"
    assert (told(0, 0, "subject.y").decision, told(0, 0, "subject.y").decisive_rules) == ("InsufficientPolicyEvidence", ["R2"])
    undeclared = custom(all_of("R1", "Permit", ("go",), [Predicate("P1", "EQ", "subject", "zzz", right_value=1)]), x="int")
    assert trace(asked(spark, "x:int", 1), undeclared).first().trace.missing_attributes == ["subject.zzz"]


def test_constraints_as_queries(spark, policy):
    made = tables(spark, policy)
    checks = [unknown_actions(made["rules"], made["actions"]), missing_roots(made["rules"], made["expressions"]), dangling_children(made["expressions"]), unknown_references(made["predicates"], made["attributes"]), type_conflicts(made["predicates"], made["attributes"]), unfit_literals(made["predicates"], made["attributes"]), single_valued_containers(made["predicates"], made["attributes"])]
    assert [c.count() for c in checks] == [0] * 7
    broken = custom(all_of("R1", "Permit", ("go",), [Predicate("P1", "EQ", "subject", "n", right_value="x"), Predicate("P2", "CONTAINS", "subject", "n", right_value=1), Predicate("P3", "EQ", "subject", "n", "subject", "s"), Predicate("P4", "EQ", "subject", "gone", right_value=1)]), n="int", s="string")
    made = tables(spark, broken)
    names = lambda df: sorted(r.predicate_id for r in df.collect())
    assert names(unfit_literals(made["predicates"], made["attributes"])) == ["P1"]
    assert names(single_valued_containers(made["predicates"], made["attributes"])) == ["P2"]
    assert names(type_conflicts(made["predicates"], made["attributes"])) == ["P3"]
    assert names(unknown_references(made["predicates"], made["attributes"])) == ["P4"]
    assert len(problems(broken)) == 4
    circle = Rule("R1", "Permit", ("go",), {}, {"A": Expression("A", "AND", ("B",)), "B": Expression("B", "OR", ("A", "C"))}, "A")
    assert "circle" in problems(custom(circle))[0]
    assert unknown_actions(made["rules"], made["actions"].limit(0)).count() == 1


def test_retrieval(spark, policy):
    queries = spark.createDataFrame([(1, "Should user mira be permitted to view resource plate1 and its owner?"), (2, "zzz"), (3, None)], "query_id long, query string")
    corpus = text_corpus(spark, policy)
    assert corpus.count() == 5 + 6 + 6
    tokens = lambda t: {x.lower() for x in __import__("re").findall("[A-Za-z0-9_]+", t or "")}
    held = [(r.evidence_id, tokens(r.text)) for r in corpus.collect()]
    got = top_texts(queries, corpus, 8).collect()
    for q in queries.collect():
        own = tokens(q.query)
        ranked = sorted(((len(own & t) / max(1, len(own)), i) for i, t in held), reverse=True)[:8]
        assert [(r.score, r.evidence_id) for r in sorted((r for r in got if r.query_id == q.query_id), key=lambda r: r["rank"])] == ranked
    rules = top_rules(queries, policy).filter("query_id = 1").collect()
    assert [(r.evidence_id, r.rule_id) for r in rules[:2]] == [("SG1", "R3"), ("SG2", "R4")]
    assert rules[1].score > 0.35 > rules[2].score
    found = top_subgraphs(spark, queries, policy, 2).filter("query_id = 1").collect()
    assert all(r.edges and f"Rule:{r.rule_ids[0]}" in r.node_ids for r in found)
    assert evidence_by_rule(top_subgraphs(spark, queries, policy, 2)).count() == 6


def test_sketch(spark, policy):
    rows = spark.createDataFrame([(1, "may MIRA View plate2?"), (2, "subject.Dome=x, action=fly mira subject.dome=y"), (3, "nothing")], "i long, query string")
    got = {r.i: r for r in request_sketch(rows, policy).collect()}
    assert (got[1].action, got[1].subject_id, got[1].resource_id, got[1].subject["crews"]) == ("view", "mira", "plate2", "dawn dusk")
    assert (got[2].action, got[2].subject["dome"], got[2].subject["uid"]) == ("fly", "y", "mira")
    assert (got[3].action, got[3].subject) == (None, {})


ANSWER = "decision = Deny\nconfidence = High\ndecisive_rules = [R1]\n{ rule = R1, predicate_ids = [P1] }\n1 Because supports = SG1 R1 P1\ncitations = [SG1, 'SG7']\n"


def drafts(spark, *texts):
    return parse_contract(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, answer string"), action=F.lit("read"))


def test_contract(spark):
    json_text = '{"decision": "permit", "claims": [{"text": "x", "supports": ["SG1"]}], "citations": ["SG1"], "decisive_predicates": {"R1": ["P1"]}}'
    got = {r.i: r.draft for r in drafts(spark, ANSWER, json_text, "{broken", None, "DECISION = insufficient\n1 x supports =\nrule = R2, predicate_ids = [P1, P2]", "decisive_predicates = [{ rule = R1, predicate_ids = [P1] }]").collect()}
    assert (got[0].decision, got[0].decisive_predicates, got[0].citations, got[0].claims[0].supports) == ("Deny", {"R1": ["P1"]}, ["SG1", "SG7"], ["SG1", "R1", "P1"])
    assert (got[1].decision, got[1].confidence, got[1].claims[0]["index"], got[1].decisive_predicates, got[1].request_action) == ("Permit", "Medium", 1, {"R1": ["P1"]}, "read")
    assert [got[i].decision for i in (2, 3, 4)] == ["InsufficientPolicyEvidence"] * 3
    assert (got[4].claims, got[4].decisive_predicates, got[5].decisive_predicates) == ([], {"R2": ["P1", "P2"]}, {})


def guarded(spark, answer, decision, model=None, **options):
    rules = F.array(F.lit("R1"))
    traced = F.struct(F.lit(decision).alias("decision"), rules.alias("decisive_rules"), F.create_map(F.lit("R1"), F.create_map(F.lit("P1"), F.lit("TRUE"))).alias("decisive_predicates"), F.array().cast("array<string>").alias("missing_attributes"), F.array().cast("array<string>").alias("notes"))
    rows = drafts(spark, answer).withColumns({"trace": traced, "evidence_ids": F.array(F.lit("SG1"))})
    return verify(rows, model, **options).first().response


def test_guardrails(spark):
    wrong = "decision = Permit\n1 No supports = SG9 R9 P9\ncitations = [SG9]\n"
    r = guarded(spark, wrong, "Deny", lambda prompt: F.lit(ANSWER))
    assert (r.decision, r.was_overridden, r.revised, r.unsupported_claim_count, len(r.claims), r.citations) == ("Deny", True, True, 0, 1, ["SG1"])
    r = guarded(spark, "decision = Deny\n1 No supports = SG2 R2 P2\ncitations = [SG2]\n", "Deny", revise=False)
    assert (r.decision, r.claims, r.unsupported_claim_count, r.citations) == ("Deny", [], 1, [])
    # a revision that turns from a decision that was right stands, unless it is checked again
    right = wrong.replace("Permit", "Deny")
    flip = lambda prompt: F.lit("decision = Permit\n")
    assert guarded(spark, right, "Deny", flip).decision == "Permit"
    assert guarded(spark, right, "Deny", flip, recheck_after_revision=True).decision == "Deny"


def test_clients(spark, policy):
    prompts = spark.createDataFrame([(0, "same"), (1, "other"), (2, "x")], "call long, p string")
    assert [r[0].split("\n")[1] for r in prompts.select(heuristic(F.col("p"))).collect()] == ["decision = Permit", "decision = Deny", "decision = Deny"]
    assert [r.answer for r in scripted(prompts, ["a", "b"], fallback="c").orderBy("call").collect()] == ["a", "b", "c"]
    assert [r[0] for r in prompts.select(loaded(lambda: lambda ps, system, **how: [f"{system} {p.upper()} {sorted(how.values())}" for p in ps])(F.col("p"), "Sir", Decoding(0.0, 0.5, 7))).collect()] == [f"Sir {p} [0.0, 0.5, 7]" for p in ("SAME", "OTHER", "X")]
    assert smoke(spark, heuristic, Decoding()).startswith("Decision")
    assert backend("heuristic") is heuristic and callable(backend("tests.test_evidence:nothing", "m"))
    with pytest.raises(ValueError, match="Unknown variant"):
        draft(spark, prompts, policy, "other", heuristic)


def test_metrics_of_nothing(spark):
    rows = drafts(spark, ANSWER).withColumns({"oracle": F.lit("Deny"), "evidence_ids": F.array(F.lit("SG1"))})
    from verdikt.operators.guardrails import unverified

    whole = score(unverified(rows)).first()
    assert (whole.accuracy, whole.rule_precision, whole.graph_faithfulness, whole.unsupported_claim_rate) == (100.0, 100.0, 0.0, 100.0)
    assert [score(unverified(rows).limit(0)).first()[m] for m in METRICS] == [0.0] * 14


def test_experiment(spark, tmp_path, policy):
    (tmp_path / "observatory.abac").write_text(text())
    out, names = str(tmp_path / "out"), ("vanilla", "text-rag", "kg-rag", "guardrails")
    got = run_experiments(spark, str(tmp_path / "observatory.abac"), None, out, setup=Setup(seed=7, max_phase1_samples=8, max_phase2_samples=12))
    first, size = got["phase1_metrics"], got["test_size"]
    oracle = [r.oracle for r in spark.read.json(f"{out}/predictions_vanilla.jsonl").collect()]
    assert len(oracle) == size
    said = [r.prediction for r in spark.read.json(f"{out}/predictions_vanilla.jsonl").orderBy("task_id").collect()]
    right = [r.oracle for r in spark.read.json(f"{out}/predictions_vanilla.jsonl").orderBy("task_id").collect()]
    assert first["vanilla"].accuracy == pytest.approx(100 * sum(a == b for a, b in zip(said, right, strict=True)) / size)
    assert first["guardrails"].accuracy == 100.0
    assert all(-1e-9 <= m[name] <= 100 + 1e-9 for m in first.values() for name in METRICS)
    assert check_results(spark, out, names, size) == []
    assert check_results(spark, out, ("vanilla",), size + 1) == [f"predictions_vanilla.jsonl has {size} rows"]
    assert check_results(spark, str(tmp_path / "none"), ()) != []
    assert "| guardrails | 100.00 | 0.00 |" in "\n".join(r.value for r in spark.read.text(f"{out}/tables.md").collect())


def test_stream(spark, policy, tmp_path):
    grid = request_grid(spark, policy)
    grid.write.parquet(str(tmp_path / "requests"))
    stream = decide_stream(spark.readStream.schema(grid.schema).parquet(str(tmp_path / "requests")), policy)
    running = stream.groupBy("decision").count().writeStream.format("memory").queryName("decided").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert {r.decision: r["count"] for r in spark.table("decided").collect()} == Counter("Permit" if permitting(u, t, a) else "Deny" for u in USERS for t in THINGS for a in ACTIONS)


def test_inference():
    assert datatype_of([1, "x"]) == "string"


def test_decisions_alone_need_no_whole_trace(spark):
    """Of traces only what a query asks for is made: no notes, maps of tests or claims' alignment for decisions."""
    from verdikt.operators.decide import NEEDS_MORE
    from verdikt.plans.data_catalog import guarded_requests

    plan = guarded_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "decision" in plan and NEEDS_MORE not in plan and "unsupported-tokens" not in plan
