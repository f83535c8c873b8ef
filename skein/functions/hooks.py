"""Injectable models: a prompt-to-text function run in batches on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Tries of one call, and the longest pause between two.
TRIES, LONGEST_PAUSE = 5, 60.0


def silent(prompt: str) -> str:
    """The offline default: the model has nothing to say."""
    return "NONE"


def with_retries(fn: Callable[[str], str], pause: float = 0.0, tries: int = TRIES) -> Callable[[str], str]:
    """``fn`` tried again on errors, with a pause that doubles up to a minute."""

    def call(prompt: str) -> str:
        wait = pause
        for k in range(tries):
            try:
                return fn(prompt)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait)
                wait = min(LONGEST_PAUSE, wait * 2)
        return ""

    return call


def ask(prompts: DataFrame, fn: Callable[[str], str] = silent, pause: float = 0.0) -> DataFrame:
    """(id, response): a model's answer to each prompt (id, prompt).

    A call that fails for good gives a null response instead of failing the job.
    """
    kind = dict(prompts.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(fn, pause)
        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append(call(p))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"id": b["id"], "response": out})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {kind}, response string")
