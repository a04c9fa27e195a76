"""Sets as bits of whole numbers against collect_set, and what the query that uses them reads and shuffles."""

import pytest
from pyspark.sql import functions as F

from verdikt.operators import sets
from verdikt.plans.data_catalog import permitted_sales

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("kind", "values"), [("string", 7), ("string", 200), ("string", 300), ("bigint", 64), ("int", 65), ("double", 5), ("string", 0)])
def test_sets(spark, kind, values):
    """Also more than a word of values, more than are bits, none at all, and nulls, which are left out."""
    rows = spark.range(2000).select((F.col("id") % 97).alias("key"), F.when((F.col("id") % 11 > 0) & (F.lit(values) > 0), F.pmod(F.xxhash64("id"), F.lit(max(values, 1))) - 3).cast(kind).alias("v"), (F.col("id") % 3 == 0).alias("kept"))
    made = sets.Values(rows, "v")
    assert (made.values is None) == (values > sets.MOST or kind == "double")
    marked = rows.select("key", "kept", *made.marks(F.col("v")))
    got = marked.groupBy("key").agg(*made.together(lambda mark: F.when(F.col("kept"), mark))).select("key", F.sort_array(made.members()).alias("s"))
    want = rows.groupBy("key").agg(F.sort_array(F.collect_set(F.when(F.col("kept"), F.col("v")))).alias("s"))
    assert got.schema["s"].dataType.elementType == want.schema["s"].dataType.elementType
    assert {r.key: r.s for r in got.collect()} == {r.key: r.s for r in want.collect()}


def test_sales_collect_no_objects(spark):
    """Lines are aggregated as whole numbers, and those of suppliers only where they are large."""
    plan = permitted_sales(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("bit_or") and "GreaterThanOrEqual(l_quantity,50.0)" in plan


def test_sales_of_nothing(spark, tmp_path):
    """Without lines, orders and parts, whoever has nothing to include is included; without suppliers there is no row."""
    for table in ("customer", "supplier", "part", "orders", "lineitem"):
        read = spark.read.parquet(f"{FOLDER}/{table}.parquet")
        (read.limit(0) if table in ("part", "orders", "lineitem") else read).write.parquet(f"{tmp_path}/{table}.parquet")
    found = permitted_sales(spark, str(tmp_path))
    c, s = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("customer", "supplier"))
    want = c.crossJoin(s).filter("NOT (c_mktsegment = 'MACHINERY' AND s_acctbal < 0)").groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("suppliers"))
    assert sorted(found.select("c_custkey", "n", "suppliers").collect()) == sorted(want.collect())
    s.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    spark.catalog.clearCache()
    assert permitted_sales(spark, str(tmp_path)).collect() == []
