"""An extension: watching training scalars as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def early_stop_stream(scalars: DataFrame, patience: int) -> DataFrame:
    """(run, epoch, best, since, stop) for each arriving (run, epoch, loss): the fold of the batch operator, kept as state for each run.

    State is three numbers a run. Epochs that arrive late, at or below one already seen, are passed over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, since, last = state.get if state.exists else (float("inf"), 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("epoch").itertuples():
            if r.epoch <= last:
                continue
            since = 0 if r.loss < best else since + 1
            best, last = min(best, r.loss), int(r.epoch)
            out.append((key[0], last, best, since, since >= patience))
        state.update((best, since, last))
        yield pd.DataFrame(out, columns=["run", "epoch", "best", "since", "stop"])

    rows = scalars.select("run", "epoch", "loss").groupBy("run")
    return rows.applyInPandasWithState(step, "run string, epoch long, best double, since long, stop boolean", "best double, since long, last long", "append", GroupStateTimeout.NoTimeout)
