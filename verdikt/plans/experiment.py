"""The whole evaluation of a policy: tasks, decisions, answers of all variants, metrics and files.

    spark-submit -m verdikt.plans.experiment --policy P --output-dir D
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.model import Policy
from verdikt.operators.clients import Client, Decoding, heuristic, loaded
from verdikt.operators.decide import decide
from verdikt.operators.metrics import score
from verdikt.operators.variants import SYSTEM_PROMPT, VARIANTS, respond
from verdikt.operators.workload import adversarial, counterfactual, numbered, qa_tasks, seeded_positions, split_positions
from verdikt.sources.policies import read_policy
from verdikt.sources.results import check_results, prediction_rows, tables_markdown, write_json_lines, write_text


@dataclass(frozen=True)
class Setup:
    seed: int = 7
    dev_ratio: float = 0.2
    max_phase1_samples: int = 400
    max_phase2_samples: int = 120


def test_tasks(spark: SparkSession, policy: Policy, setup: Setup) -> DataFrame:
    """The test part of the sampled tasks with nth (its order) and oracle. Positions and labels of the sample, which its
    size bounds, go through the driver for the seeded shuffle."""
    labelled = decide(qa_tasks(spark, policy, setup.seed, setup.max_phase1_samples), policy).withColumnRenamed("decision", "oracle").cache()
    labels = [(r.pos, r.oracle) for r in labelled.select("nth", "pos", "oracle").orderBy("nth").collect()]
    _, test = split_positions(labels, setup.dev_ratio, setup.seed)
    return labelled.drop("nth").join(F.broadcast(numbered(spark, test)), "pos")


def _second_phase(spark: SparkSession, tasks: DataFrame, setup: Setup) -> DataFrame:
    """The QA tasks of the test part, or a seeded sample of them, with nth anew."""
    qa = tasks.filter("task_type = 'qa'")
    positions = [r.pos for r in qa.select("nth", "pos").orderBy("nth").collect()]
    drawn = [positions[i] for i in seeded_positions(len(positions), setup.max_phase2_samples, setup.seed)]
    return qa.drop("nth").join(F.broadcast(numbered(spark, drawn)), "pos")


def predictions(spark: SparkSession, tasks: DataFrame, policy: Policy, client: Client, decoding: Decoding = Decoding()) -> dict[str, DataFrame]:  # noqa: B008
    """For each variant, tasks with variant and response."""
    return {v: respond(spark, tasks, policy, v, client, decoding).withColumn("variant", F.lit(v)) for v in VARIANTS}


def backend(name: str, model_id: str | None = None) -> Client:
    """The client of a name: heuristic, or package.module:function, which is called with the model's id in each worker and gives the model."""
    if name == "heuristic":
        return heuristic
    module, _, function = name.partition(":")
    return loaded(lambda: getattr(import_module(module), function)(model_id))


def smoke(spark: SparkSession, client: Client, decoding: Decoding) -> str:
    """The client's answer to one short question, before an experiment is begun."""
    asked = spark.createDataFrame([("May the owner read the file? Answer with decision = Permit or decision = Deny.",)], "prompt string")
    answer = asked.select(client(F.col("prompt"), SYSTEM_PROMPT, decoding).alias("answer")).first().answer
    if not (answer or "").strip():
        raise RuntimeError("the model says nothing")
    return answer


def run_experiments(spark: SparkSession, policy_path: str, readme: str | None = None, output_dir: str = "outputs", client: Client = heuristic, setup: Setup = Setup(), decoding: Decoding = Decoding()) -> dict[str, Any]:  # noqa: B008
    """Metrics by phase and variant, the sizes of the task sets, and in output_dir tables.md and the first phase's predictions."""
    policy = read_policy(policy_path, readme, spark)
    first = test_tasks(spark, policy, setup).cache()
    base = _second_phase(spark, first, setup).cache()
    nth = F.col("nth") + 1
    flipped = counterfactual(spark, policy, base, nth).withColumns({"counterfactual_valid": F.lit(False), "counterfactual_minimal": F.lit(False), "counterfactual_attr_changes": F.coalesce("cf_changes", F.lit(0))})
    sets = {"phase1": first, "adversarial": adversarial(base, nth).cache(), "counterfactual": flipped.cache()}
    metrics: dict[str, dict[str, Any]] = {}
    for phase, tasks in sets.items():
        made = predictions(spark, tasks, policy, client, decoding)
        if phase == "phase1":
            for variant, rows in made.items():
                write_json_lines(prediction_rows(rows.orderBy("nth")), f"{output_dir}/predictions_{variant}.jsonl")
        metrics[phase] = {v: score(rows, "variant").first() for v, rows in made.items()}
    write_text(spark, tables_markdown(metrics), f"{output_dir}/tables.md")
    sizes = {f"{name}_size": tasks.count() for name, tasks in (("test", first), ("adversarial", sets["adversarial"]), ("counterfactual", sets["counterfactual"]))}
    return {**{f"{p}_metrics": m for p, m in metrics.items()}, **sizes, "output_dir": output_dir}


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    for name, default in (("--policy", None), ("--readme", None), ("--output-dir", "outputs")):
        args.add_argument(name, default=default, required=name == "--policy")
    for name, default in (("--seed", 7), ("--max-phase1-samples", 400), ("--max-phase2-samples", 120), ("--min-lines", 1)):
        args.add_argument(name, type=int, default=default)
    for name, default in (("--temperature", Decoding.temperature), ("--top-p", Decoding.top_p)):
        args.add_argument(name, type=float, default=default)
    args.add_argument("--max-tokens", type=int, default=Decoding.max_tokens)
    args.add_argument("--backend", default="heuristic", help="heuristic, or package.module:function that loads a model by its id")
    args.add_argument("--model-id", default=None)
    args.add_argument("--run-smoke", action=argparse.BooleanOptionalAction, default=None, help="ask the model once before the experiment (unless said: if it isn't the heuristic one)")
    args.add_argument("--check-results", action=argparse.BooleanOptionalAction, default=True, help="check the output folder in the end")
    args.add_argument("--check-only", action="store_true", help="only check what is in the output folder")
    given = args.parse_args()
    spark = SparkSession.builder.getOrCreate()
    client, decoding = backend(given.backend, given.model_id), Decoding(given.temperature, given.top_p, given.max_tokens)
    if not given.check_only:
        if given.run_smoke if given.run_smoke is not None else given.backend != "heuristic":
            smoke(spark, client, decoding)
        run_experiments(spark, given.policy, given.readme, given.output_dir, client, Setup(given.seed, max_phase1_samples=given.max_phase1_samples, max_phase2_samples=given.max_phase2_samples), decoding)
    if (given.check_results or given.check_only) and (found := check_results(spark, given.output_dir, VARIANTS, given.min_lines)):
        raise SystemExit("\n".join(found))


if __name__ == "__main__":
    main()
