"""Text generators. A client is a function from a column of prompts, a system prompt and a way of decoding to a column of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Decoding:
    """How a model draws its answers; models without such settings pass them over."""

    temperature: float = 0.2
    top_p: float = 0.9
    max_tokens: int = 900


class Client(Protocol):
    def __call__(self, prompt: Column, system: str = "", decoding: Decoding = ...) -> Column: ...


#: What the heuristic client answers, around its decision.
HEURISTIC_ANSWER = (
    "Decision\ndecision = ",
    "\nconfidence = Medium\n\nPolicyContext\npolicy_id = heuristic\nrequest_subject = {}\nrequest_resource = {}\nrequest_action = read\nrequest_environment = {}\n\n"
    "Evidence\nevidence_subgraphs = [SG1]\ndecisive_rules = [R1]\ndecisive_predicates = [{ rule = R1, predicate_ids = [P1] }]\n\n"
    "Explanation\n1 Heuristic prediction supports = SG1 R1 P1\n\nCitations\ncitations = [SG1]\n",
)


def heuristic(prompt: Column, system: str = "", decoding: Decoding = Decoding(), permits: Sequence[str] = ("author", "same", "treating")) -> Column:  # noqa: B008
    """Permit if the prompt has one of some words, else Deny; always the same claim. No worker is needed."""
    said = F.lower(prompt)
    found = F.lit(False)
    for word in permits:
        found = found | F.contains(said, F.lit(word))
    return F.concat(F.lit(HEURISTIC_ANSWER[0]), F.when(found, "Permit").otherwise("Deny"), F.lit(HEURISTIC_ANSWER[1]))


def scripted(calls: DataFrame, answers: Sequence[str], call: str = "call", fallback: str = "decision = Deny\n") -> DataFrame:
    """calls with a column answer: the answer of that number (from 0), beyond them the fallback. The number is a column,
    so tasks may run in any order and again."""
    listed = F.array(*map(F.lit, answers)).cast("array<string>")
    return calls.withColumn("answer", F.coalesce(F.get(listed, F.col(call).cast("int")), F.lit(fallback)))


def loaded(load: Callable[[], Callable[..., list[str]]]) -> Client:
    """A client around a local model: load runs once in each worker, and the model gets batches of prompts, as keywords the
    system prompt (system) and the decoding's fields (temperature, top_p, max_tokens)."""

    def client(prompt: Column, system: str = "", decoding: Decoding = Decoding()) -> Column:  # noqa: B008
        settings: dict[str, Any] = {"system": system, **asdict(decoding)}

        @F.pandas_udf("string")
        def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for prompts in batches:
                yield pd.Series(model(prompts.tolist(), **settings), index=prompts.index)

        return generate(prompt)

    return client
