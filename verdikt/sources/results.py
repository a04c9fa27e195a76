"""Sinks of experiments: prediction rows as JSON lines, metrics as Markdown tables, and a check of both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: The tables' titles and columns, the latter with their metrics.
TABLES = (
    ("Decision reliability", "phase1", (("Acc (%)", "accuracy"), ("FPR (%)", "false_permit_rate"), ("FNR (%)", "false_deny_rate"), ("Abstain (%)", "abstain_rate"))),
    ("Grounding and faithfulness", "phase1", (("GF (%)", "graph_faithfulness"), ("Rule Prec (%)", "rule_precision"), ("Attr Prec (%)", "attr_precision"), ("KGHallu (%)", "kg_hallucination_rate"))),
    ("Citation quality", "phase1", (("CiteCorr (%)", "citation_correctness"), ("CiteFaith (%)", "citation_faithfulness"), ("Unsupported Claims (%)", "unsupported_claim_rate"))),
    ("Adversarial robustness", "adversarial", (("Acc (%)", "accuracy"), ("FPR (%)", "false_permit_rate"), ("GF (%)", "graph_faithfulness"), ("Abstain (%)", "abstain_rate"))),
    ("Counterfactual quality", "counterfactual", (("CF Validity (%)", "counterfactual_validity"), ("CF Minimality (%)", "counterfactual_minimality"), ("Avg Attr Changes", "avg_attr_changes"))),
)
PREDICTION = ("task_id", "variant", "oracle", "prediction", "citations", "decisive_rules", "unsupported_claim_count")


def prediction_rows(predictions: DataFrame) -> DataFrame:
    """The columns that are kept of predictions (task_id, variant, oracle, response)."""
    r = F.col("response")
    return predictions.select("task_id", "variant", "oracle", r.decision.alias("prediction"), r.citations.alias("citations"), r.decisive_rules.alias("decisive_rules"), r.unsupported_claim_count.cast("long").alias("unsupported_claim_count"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, one part for each partition; nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(header: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join(map(line, (header, ["---"] * len(header), *rows)))


def tables_markdown(metrics: Mapping[str, Mapping[str, Row]]) -> str:
    """All tables, from phase to variant to metrics: a few rows that have been collected."""
    parts = ["# Experiment Tables", ""]
    for title, phase, columns in TABLES:
        rows = [[variant, *(f"{m[metric]:.2f}" for _, metric in columns)] for variant, m in metrics[phase].items()]
        parts += [f"## {title}", markdown(("Method", *(name for name, _ in columns)), rows), ""]
    return "\n".join(parts)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text as a folder of one part, in any store that Spark writes to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of a file or folder; none if it isn't there."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def check_results(spark: SparkSession, folder: str, variants: Sequence[str], least_rows: int = 1) -> list[str]:
    """What is missing in an experiment's folder, in any store: files, sections of the tables, or rows of predictions."""
    parts = {name: _lines(spark, f"{folder}/{name}") for name in ("tables.md", *(f"predictions_{v}.jsonl" for v in variants))}
    if found := [f"no {name}" for name, lines in parts.items() if lines is None]:
        return found
    titles = {r.value for r in parts.pop("tables.md").filter(F.col("value").startswith("## ")).collect()}
    found = [f"tables.md has no section {title}" for title, _, _ in TABLES if f"## {title}" not in titles]
    for name, lines in parts.items():
        n = lines.filter("trim(value) <> ''").count()
        if n < least_rows:
            found.append(f"{name} has {n} rows")
    return found
