"""Steps whose rows multiply within a task deal them first, to places that aren't put together by their bytes."""

from verdikt.operators.graph import graph_tables
from verdikt.operators.retrieve import shared_tokens
from verdikt.plans.data_catalog import part_rules


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_are_dealt(spark):
    nodes, edges = graph_tables(part_rules(spark, "/root/testdata/sf0.001"))
    for df in (nodes, edges):
        assert plan(df).count("REPARTITION_BY_NUM") >= 3 and "rule_id" in plan(df)


def test_rules_are_not_broadcast(spark):
    """Tables of a row or more for each rule are joined where they were dealt, though a small file makes them."""
    for df in graph_tables(part_rules(spark, "/root/testdata/sf0.001")):
        df.write.format("noop").mode("overwrite").save()
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)


def test_texts_are_dealt(spark):
    texts = spark.createDataFrame([(n, f"a b{n % 3} c") for n in range(20)], "id long, text string")
    _, shared = shared_tokens(texts.limit(3), texts, "id", "text", "id", "text")
    assert "REPARTITION_BY_NUM" in plan(shared)
    assert {(r.q, r.d): r.shared for r in shared.filter("q = 0 AND d IN (1, 3)").collect()} == {(0, 1): 2, (0, 3): 3}
