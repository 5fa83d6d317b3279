"""Models stay outside: recognisers, diarizers and language models plug in as adapters, called in batches on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Recogniser(Protocol):
    def __call__(self, audio: bytes) -> list[dict]: ...


class Diarizer(Protocol):
    def __call__(self, audio: bytes) -> list[tuple[str, float, float]]: ...


class LanguageModel(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Judge(Protocol):
    """Whether two texts mean the same; None if it can't say."""

    def __call__(self, a: str, b: str) -> bool | None: ...


class Echo:
    """A language model for tests: gives the prompt back."""

    def __call__(self, prompt: str) -> str:
        return prompt


def with_retries(call: Callable, args: tuple, waits: tuple[float, ...]):
    """call(*args), again after each of the waits while it fails; the last failure is raised."""
    for wait in waits:
        try:
            return call(*args)
        except Exception:  # noqa: BLE001
            time.sleep(wait)
    return call(*args)


def apply_adapter(df: DataFrame, keep: list[str], inputs: list[str], kind: str, make: Callable[[], Callable], at_once: int = 3, waits: tuple[float, ...] = (1, 3, 8)) -> DataFrame:
    """keep, answer (of type ``kind``) and error of calling an adapter with each row's inputs.

    ``make`` builds the adapter once per task. ``at_once`` calls run side by side; a call that still fails after its waits gives a null answer and
    its error. Null inputs are handed over as they are. Repeated rows are called repeatedly: drop them first."""
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = make()

        def one(args: tuple):
            try:
                return with_retries(adapter, args, waits), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                got = list(pool.map(one, b[inputs].itertuples(index=False, name=None)))
                yield b[keep].assign(answer=pd.Series([a for a, _ in got], index=b.index, dtype=object), error=pd.Series([e for _, e in got], index=b.index, dtype=object))

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInPandas(run, f"{ddl}, answer {kind}, error string")
