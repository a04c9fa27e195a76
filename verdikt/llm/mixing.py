"""Mixing sources to target weights by hierarchical budgeting.

Rows hang in a tree: domain, language, source. A token budget runs down it by weight. A node can't give more than its
tokens times the epochs allowed; what it lacks goes to its siblings by weight, and only when they are full does their
parent lack it. Every leaf then gives its first tokens in the order of seeded epochs: whole epochs, and of the last one
the rows with the least seeded hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdikt.llm.common import row_key, written

#: A leaf's rows fall into so many ranges of hashes, whose tokens are summed before any of its rows are put in order.
RANGES = 4096


def tokens_in(text: Column) -> Column:
    """Blank-separated tokens, one at least; a null text has one too."""
    return F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))), F.lit(0)).cast("long") + 1


def weigh(level: DataFrame, key: str, weights: Mapping[str | None, float], default: float) -> DataFrame:
    """level with a column weight: a node's own from the mapping, which is a setting and small, else default."""
    value = F.lit(float(default))
    for name, weight in weights.items():
        value = F.when(F.col(key).eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(value)
    return level.withColumn("weight", value)


def share_out(level: DataFrame, parent: Sequence[str]) -> DataFrame:
    """level with a column granted. level: parent columns, capacity, weight and the parent's budget, on every row.

    Within a parent every child gets the least of its capacity and t times its weight, t such that the budget is spent,
    or all children are full. In order of capacity per weight, the children before some place are full and those
    behind get their weights' share; the place is found by running sums. A weight of zero gets nothing.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc(), "capacity")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    able = level.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1e-300))
    placed = able.withColumn("filled", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("rest", F.sum("weight").over(onward))
    level_t = placed.withColumn("t", (F.col("budget") - F.col("filled")) / F.col("rest"))
    fits = F.when(F.col("t") * F.col("weight") < F.col("capacity"), F.col("t"))
    cut = level_t.withColumn("t", F.max(fits).over(whole))  # the first child that isn't full sets t; later ones have the same
    granted = F.when(F.col("t").isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity").cast("double"), F.greatest(F.lit(0.0), F.col("t") * F.col("weight"))))
    return cut.withColumn("granted", granted).drop("filled", "rest", "t")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str | None, float]], total: float, max_epochs: int) -> DataFrame:
    """The leaves with a column granted: tokens to take. leaves: levels and tokens, a row for each leaf. Weights of a
    level are by the node's own name; nodes that aren't named weigh 1."""
    nodes = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    parent: list[str] = []
    above = None
    for depth in range(1, len(levels) + 1):
        path = list(levels[:depth])
        level = weigh(nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity")), path[-1], weights.get(path[-1], {}), 1.0)
        if above is None:
            level, parent_key = level.withColumn("budget", F.lit(float(total))).withColumn("__root", F.lit(0)), ["__root"]
        else:
            up = above.select(*(F.col(c).alias(f"__p{i}") for i, c in enumerate(parent)), F.col("granted").alias("budget"))
            same = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(parent)]
            condition = same[0]
            for s in same[1:]:
                condition = condition & s
            level, parent_key = level.join(up, condition).drop(*(f"__p{i}" for i in range(len(parent)))), parent
        above = share_out(level, parent_key).select(*path, "granted")
        parent = path
    return above


def mix(documents: DataFrame, weights: Mapping[str, Mapping[str | None, float]], budget_share: float, levels: Mapping[str, Column], max_epochs: int = 1, seed: int = 0, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows chosen, in the columns of documents and epoch (from 0), which replaces a column of that name.

    levels: the tree's levels from the top, each an expression over documents; weights: for each level, its nodes'
    weights by name. budget_share: of all tokens, how many to take. A leaf takes rows while their tokens, in the order
    of an epoch's seeded hash, stay within its budget, so it never exceeds it; rows that tie (equal ones) go together.
    Null levels are nodes of their own. An empty table gives no rows.

    Leaves' sums are windows over a leaf's ranges of hashes; rows are put in order in the one range where a leaf's
    budget ends. The text is joined with a row per leaf, by Spark's choice of join.
    """
    names = list(levels)
    kept = [F.col(f"`{c}`") for c in documents.columns if c != "epoch"]
    tree = [expression.cast("string").alias(f"__{name}") for name, expression in levels.items()]
    own = [f"__{name}" for name in names]
    keys = [k.alias(name) for k, name in zip(row_key(f"`{id_column}`", f"`{text_column}`"), ("__k1", "__k2"), strict=True)]
    slim = documents.select(*tree, *keys, tokens_in(F.col(f"`{text_column}`")).alias("tokens"))
    slim = written(slim, "tokens")
    leaves = slim.groupBy(*own).agg(F.sum("tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    granted = written(budgets(leaves, own, {f"__{k}": v for k, v in weights.items()}, total * budget_share, max_epochs).join(leaves.withColumnsRenamed({c: f"{c}__" for c in own}), _all_same(own)).select(*own, "granted", "tokens"), "granted")
    epochs = granted.select(*own, F.inline(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.struct(e.alias("epoch"), F.greatest(F.lit(0.0), F.least(F.col("tokens").cast("double"), F.col("granted") - e * F.col("tokens"))).alias("part")))), F.col("tokens").alias("whole")).filter("part > 0").withColumnsRenamed({c: f"{c}__" for c in own})

    hashed = lambda epoch: F.xxhash64(F.lit(seed), epoch, "__k1", "__k2")
    in_range = lambda h: F.shiftright(h, 52) + RANGES // 2
    partial = epochs.filter("part < whole")
    drawn = slim.join(partial, _all_same(own)).drop(*(f"{c}__" for c in own)).withColumn("h", hashed(F.col("epoch"))).withColumn("range", in_range(F.col("h")))
    sums = drawn.groupBy(*own, "epoch", "range").agg(F.sum("tokens").alias("n"), F.first("part").alias("part"))
    running = Window.partitionBy(*own, "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    edge = placed.filter("before <= part AND upto > part").select(*(F.col(c).alias(f"{c}__") for c in own), F.col("epoch").alias("epoch__"), F.col("range").alias("edge"), "before")
    there = drawn.join(edge, _all_same(own) & (F.col("epoch") == F.col("epoch__")) & (F.col("range") == F.col("edge"))).select(*own, "epoch", "h", "tokens", "part", "before")
    upto = Window.partitionBy(*own, "epoch").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    inside = there.withColumn("upto", F.sum("tokens").over(upto) + F.col("before")).filter("upto <= part")
    last = inside.groupBy(*own, "epoch").agg(F.max("h").alias("last"))
    edges = edge.select(*(F.col(f"{c}__").alias(c) for c in own), F.col("epoch__").alias("epoch"), "edge")
    cuts = edges.join(last.withColumnsRenamed({c: f"{c}__" for c in own}).withColumnRenamed("epoch", "epoch__"), _all_same(own) & (F.col("epoch") == F.col("epoch__")), "left").select(*own, "epoch", F.coalesce("last", F.when(F.col("edge") == 0, F.lit(-(2**63))).otherwise(F.shiftleft((F.col("edge") - RANGES // 2).cast("long"), 52) - F.when(F.col("edge") == 0, 0).otherwise(1))).alias("cut"))
    whole = epochs.filter("part >= whole").select(*(F.col(f"{c}__").alias(c) for c in own), "epoch", F.lit(2**63 - 1).alias("cut"))
    chosen = written(cuts.unionByName(whole), "cuts").withColumnsRenamed({c: f"{c}__" for c in own}).withColumnRenamed("epoch", "__epoch")
    rows = documents.select(*kept, *tree, *keys).join(chosen, _all_same(own))
    return rows.filter(hashed(F.col("__epoch")) <= F.col("cut")).select(*kept, F.col("__epoch").alias("epoch"))


def _all_same(columns: Sequence[str]) -> Column:
    """c <=> c__ for all columns."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return condition


#: The query's and the pipeline's weights. Sources that aren't named weigh 1; src0 is held down.
WEIGHTS = {"domain": {"web": 3.0, "reference": 1.0}, "lang": {"en": 4.0, "de": 1.5, "fr": 1.5, "es": 1.5}, "source": {"src0": 4.0}}


def corpus_levels() -> dict[str, Column]:
    """domain (sources of two digits are reference works), language and source of documents."""
    return {"domain": F.when(F.col("source").rlike("^src1[0-9]$"), "reference").otherwise("web"), "lang": F.col("lang"), "source": F.col("source")}
