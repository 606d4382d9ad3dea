"""Running something for each row that may be slow or fail: timed samples, and errors as values."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def attempted(df: DataFrame, key: str, run: Callable[[object], float]) -> DataFrame:
    """(key, result, error): run on each row; one that raises gets its message, and the others aren't touched."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    out.append((float(run(row)), None))
                except Exception as e:  # noqa: BLE001  whatever a row does, the others go on
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({key: pdf[key], "result": pd.array([r for r, _ in out], "Float64"), "error": [e for _, e in out]})

    kind = dict(df.dtypes)[key]
    return df.mapInPandas(step, f"`{key}` {kind}, result double, error string")


def timed(df: DataFrame, key: str, run: Callable[[object], object], warmup: int = 5, runs: int = 30, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """(key, run, ms): `runs` timed calls for each row after `warmup` that aren't counted; one row for each sample, for latency_stats."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                for k in range(-warmup, runs):
                    began = clock()
                    run(row)
                    if k >= 0:
                        out.append((getattr(row, key), k, (clock() - began) * 1000))
            yield pd.DataFrame(out, columns=[key, "run", "ms"])

    kind = dict(df.dtypes)[key]
    return df.mapInPandas(step, f"`{key}` {kind}, run int, ms double")
