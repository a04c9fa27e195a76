"""Reliability and grounding of responses, as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.functions.text import mean, ratio
from verdikt.model import INSUFFICIENT, PERMIT

METRICS = (
    "accuracy", "false_permit_rate", "false_deny_rate", "abstain_rate", "graph_faithfulness", "rule_precision", "attr_precision", "kg_hallucination_rate",
    "citation_correctness", "citation_faithfulness", "unsupported_claim_rate", "counterfactual_validity", "counterfactual_minimality", "avg_attr_changes",
)


def decision_rates(oracle: Column, predicted: Column) -> dict[str, Column]:
    """The four rates of decisions, in per cent. Whatever isn't a permit counts as negative."""
    percent = lambda part, whole: ratio(F.count_if(part) * 100.0, F.count_if(whole))
    positive = oracle == PERMIT
    return {
        "accuracy": percent(predicted == oracle, F.lit(True)),
        "false_permit_rate": percent((predicted == PERMIT) & ~positive, ~positive),
        "false_deny_rate": percent((predicted != PERMIT) & positive, positive),
        "abstain_rate": percent(predicted == INSUFFICIENT, F.lit(True)),
    }


def score(predictions: DataFrame, *by: str) -> DataFrame:
    """The 14 metrics for each group, 0 for what has nothing to count. Means are of rows' ratios.

    predictions: oracle, response (of guardrails); and may have mentioned_attrs and supported_attrs (arrays), and
    counterfactual_valid, counterfactual_minimal (boolean) and counterfactual_attr_changes, null where they don't apply.
    """
    r, none = F.col("response"), F.array().cast("array<string>")
    optional = lambda name, kind: F.col(name) if name in predictions.columns else F.lit(None).cast(kind)
    claims = F.greatest(F.lit(1), F.size(r.claims))
    aligned = F.filter(r.claims, lambda c: c.aligned)
    said = F.filter(F.flatten(F.transform(r.claims, lambda c: c.supports)), lambda t: t.startswith("R"))
    cited = F.array_distinct(r.citations)
    grounded = F.filter(F.flatten(F.transform(aligned, lambda c: c.supports)), lambda t: t.startswith("SG"))
    mentioned = F.array_distinct(F.coalesce(optional("mentioned_attrs", "array<string>"), none))
    supported = F.coalesce(optional("supported_attrs", "array<string>"), none)
    hit = lambda xs, allowed: F.size(F.filter(xs, lambda x: F.array_contains(allowed, x)))
    rows = predictions.select(
        *by, "oracle", r.decision.alias("predicted"),
        (F.size(aligned) / claims).alias("gf"), ratio(hit(said, r.decisive_rules), F.size(said)).alias("rules"), ratio(F.size(F.array_intersect(mentioned, supported)), F.size(mentioned)).alias("attrs"),
        ratio(hit(r.citations, r.evidence_subgraphs), F.size(r.citations)).alias("correct"), ratio(F.size(F.array_intersect(cited, grounded)), F.size(cited)).alias("faithful"), (r.unsupported_claim_count / claims).alias("unsupported"),
        optional("counterfactual_valid", "boolean").alias("valid"), optional("counterfactual_minimal", "boolean").alias("minimal"), optional("counterfactual_attr_changes", "int").alias("changes"),
    )
    share = lambda c: mean(c) * 100.0
    applies = F.col("valid").isNotNull()
    values = decision_rates(F.col("oracle"), F.col("predicted")) | {
        "graph_faithfulness": share("gf"),
        "rule_precision": share("rules"),
        "attr_precision": share("attrs"),
        "kg_hallucination_rate": F.when(F.count("*") > 0, (F.lit(1.0) - mean("gf")) * 100.0).otherwise(0.0),
        "citation_correctness": share("correct"),
        "citation_faithfulness": share("faithful"),
        "unsupported_claim_rate": share("unsupported"),
        "counterfactual_validity": share(F.when(applies, F.col("valid").cast("double"))),
        "counterfactual_minimality": share(F.when(applies, F.coalesce("minimal", F.lit(False)).cast("double"))),
        "avg_attr_changes": mean(F.when(applies, F.coalesce("changes", F.lit(0)).cast("double"))),
    }
    return rows.groupBy(*by).agg(*(values[m].alias(m) for m in METRICS))
