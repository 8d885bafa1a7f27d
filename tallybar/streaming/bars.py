"""Bars over a stream of trades: the open bar of each instrument is the state, closed bars are the output.

Within a micro-batch trades are taken in order of seq. The last bar of a stream stays open: an unbounded stream has no end
at which to give it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallybar.functions.interval import parse_interval
from tallybar.operators.bars import FIELDS, Fold
from tallybar.schema import BAR

STATE = "timestamp long, open double, high double, low double, close double, volume double, dollar_volume double, trade_count long, counted double"

def _stream(trades: DataFrame, by: str, step) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(frames)).sort_values("seq")
        held = list(state.get) if state.exists else None
        bars, held = step(held, batch)
        if held is not None:
            state.update(tuple(held))
        elif state.exists:
            state.remove()
        if bars:
            yield pd.DataFrame([(key[0], *b) for b in bars], columns=[by, *FIELDS])

    kind = trades.schema[by].dataType.simpleString()
    return trades.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {BAR}", STATE, "append", GroupStateTimeout.NoTimeout)


def _threshold(trades: DataFrame, threshold: float, counted: str, by: str) -> DataFrame:
    if not threshold > 0:
        raise ValueError("the threshold must be above zero")

    def step(held: list | None, batch: pd.DataFrame) -> tuple[list, list | None]:
        fold = Fold(threshold)
        fold.open = held
        bars = list(fold.feed(*(batch[c].to_numpy() for c in ("time", "price", "qty", counted, "quote"))))
        return bars, fold.open

    return _stream(trades, by, step)


def volume_bars(trades: DataFrame, threshold: float, by: str) -> DataFrame:
    return _threshold(trades, threshold, "qty", by)


def dollar_bars(trades: DataFrame, threshold: float, by: str) -> DataFrame:
    return _threshold(trades, threshold, "quote", by)


def time_bars(trades: DataFrame, interval: str, by: str) -> DataFrame:
    """Late trades join the open bar, as in the batch form; `counted` of the state holds the open window's number."""
    length = parse_interval(interval)

    def step(held: list | None, batch: pd.DataFrame) -> tuple[list, list | None]:
        window = batch["time"].to_numpy() // length
        window = np.maximum.accumulate(window if held is None else np.maximum(window, int(held[8])))
        fold, bars = Fold(float("inf")), []
        fold.open = held
        edge = [0, *np.flatnonzero(np.diff(window) > 0) + 1, len(batch)]
        for a, b in zip(edge, edge[1:], strict=False):
            if fold.open and int(fold.open[8]) < window[a]:
                bars.append(fold.close())
            part = batch.iloc[a:b]
            list(fold.feed(*(part[c].to_numpy() for c in ("time", "price", "qty", "qty", "quote"))))
            fold.open[8] = float(window[a])
        return bars, fold.open

    return _stream(trades.withColumn("time", F.col("time")), by, step)
