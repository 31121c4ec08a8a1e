"""Models behind a port: batching, a budget checked before each call, cached answers, and a second pass.

The default scorer answers from the cache alone; a model client is the caller's to give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Scorer(Protocol):
    def __call__(self, prompts: list[str]) -> list[str | None]: ...


class Overflow(RuntimeError):
    """An answer was cut off: the batch is too large."""


def no_model(prompts: list[str]) -> list[str | None]:
    return [None] * len(prompts)


def halving(score: Scorer, prompts: list[str]) -> list[str | None]:
    """Score a batch, in halves as long as answers are cut off."""
    try:
        return list(score(prompts))
    except Overflow:
        if len(prompts) == 1:
            return [None]
        mid = len(prompts) // 2
        return halving(score, prompts[:mid]) + halving(score, prompts[mid:])


def answers(questions: DataFrame, cache: DataFrame, score: Scorer = no_model, size: int = 20) -> DataFrame:
    """id, answer: cached answers, and new ones for what the cache lacks. Questions: id, prompt."""
    known = questions.select("id").join(cache.select("id", "answer"), "id")
    open_ = questions.join(cache.select("id"), "id", "left_anti").select("id", "prompt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.iloc[lo : lo + size]
                yield pd.DataFrame({"id": part.id, "answer": halving(score, part.prompt.tolist())})

    return known.unionByName(open_.mapInPandas(run, f"id {dict(questions.dtypes)['id']}, answer string"))


@dataclass
class Budget:
    """Stops before a call that could take what is spent beyond the limit."""

    limit: float
    spent: float = 0.0

    def admit(self, worst: float) -> bool:
        return self.spent + worst <= self.limit

    def charge(self, cost: float) -> None:
        self.spent += cost


def admitted(calls: DataFrame, budget: float, by: str, order: str, worst: str) -> DataFrame:
    """Calls whose worst cost still fits the budget after those before them, for each value of `by`."""
    back = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("_sum", F.sum(worst).over(back)).withColumn("admitted", F.col("_sum") <= budget).drop("_sum")


def chunks(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


def second_pass(events: DataFrame, again: DataFrame) -> DataFrame:
    """Events with those of a flagged sentence replaced by what a second reading of it gave (both: doc_id, sentence,
    status, ...); sentences that were not read again keep theirs."""
    read = again.select("doc_id", "sentence").distinct()
    flagged = events.filter("status = 'needs_review'").select("doc_id", "sentence").distinct().join(read, ["doc_id", "sentence"])
    return events.join(flagged, ["doc_id", "sentence"], "left_anti").unionByName(again.join(flagged, ["doc_id", "sentence"], "left_semi"), allowMissingColumns=True)


def retry(call: Callable[[], object], waits: tuple[float, ...], wait: Callable[[float], None]):
    for pause in (*waits, None):
        try:
            return call()
        except OSError:
            if pause is None:
                raise
            wait(pause)
    raise AssertionError
