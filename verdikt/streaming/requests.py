"""Deciding a stream of requests, which needs no state: each request is decided by itself.

An extension: batches and streams share the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdikt.model import Policy
from verdikt.operators.decide import decide


def decide_stream(requests: DataFrame, policy: Policy, subjects: DataFrame | None = None, resources: DataFrame | None = None, subject_key: str = "uid", resource_key: str = "rid") -> DataFrame:
    """A stream of requests with decisions. requests has subject and resource structs, or keys of those names that are
    looked up in static tables of entities; what isn't found has no attributes."""
    found = requests
    for scope, table, key in (("subject", subjects, subject_key), ("resource", resources, resource_key)):
        if table is not None:
            entity = table.select(F.col(key).alias("__key"), F.struct(*table.columns).alias("__entity"))
            found = found.join(entity, F.col(scope) == F.col("__key"), "left").drop(scope, "__key").withColumnRenamed("__entity", scope)
    return decide(found, policy)


def decision_counts(decisions: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """How often each action was decided how, by tumbling windows of event time."""
    return decisions.withWatermark(time, late).groupBy(F.window(time, window), "action", "decision").agg(F.count("*").alias("n"))
