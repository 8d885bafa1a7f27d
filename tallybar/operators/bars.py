"""OHLCV bars from trades: by time, by volume, by traded value.

Trades are (by..., seq, time, price, qty, quote); seq is their order and is never inferred from a DataFrame's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybar.functions.interval import parse_interval
from tallybar.schema import BAR, names

#: Trades of one instrument are cut by seq into chunks of about this many, so that no instrument is one task.
CHUNK = 1_000_000
FIELDS = names(BAR)


def extremes() -> list[Column]:
    """high and low without regard to NaN prices; of nothing but those they are infinite."""
    real = F.nanvl("price", F.lit(None).cast("double"))
    return [F.coalesce(F.max(real), F.lit(-math.inf)).alias("high"), F.coalesce(F.min(real), F.lit(math.inf)).alias("low")]


def time_bars(trades: DataFrame, interval: str, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Bars of epoch-aligned windows; empty windows give none, the last open bar is given.

    A late trade joins the open bar: a trade's window is the largest floor(time / length) so far. Within a chunk of an
    instrument this is a running maximum, by which the chunk's trades become parts of bars where they are; only these
    meet over the chunks, where the running maximum goes on and parts of one bar become one. Trades of one seq follow
    each other by time, price, qty and quote, so that bars do not depend on how rows are dealt.
    """
    own = F.floor(F.col("time") / F.lit(parse_interval(interval)))
    ordered = W.partitionBy(*by, "tb_chunk").orderBy("seq", "time", "price", "qty", "quote")
    running = F.max(own).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    cut = trades.withColumn("tb_chunk", F.floor(F.col("seq") / F.lit(chunk))).withColumns({"tb_run": running, "tb_place": F.row_number().over(ordered)})
    parts = cut.groupBy(*by, "tb_chunk", "tb_run").agg(
        F.min_by("time", "tb_place").alias("timestamp"), F.min_by("price", "tb_place").alias("open"), *extremes(),
        F.max_by("price", "tb_place").alias("close"), F.sum("qty").alias("volume"), F.sum("quote").alias("dollar_volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    following = W.partitionBy(*by).orderBy("tb_chunk", "tb_run")
    window = F.max("tb_run").over(following.rowsBetween(W.unboundedPreceding, 0))
    whole = parts.withColumns({"tb_window": window, "tb_part": F.row_number().over(following)}).groupBy(*by, "tb_window").agg(
        F.min_by("timestamp", "tb_part").alias("timestamp"), F.min_by("open", "tb_part").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "tb_part").alias("close"), F.sum("volume").alias("volume"), F.sum("dollar_volume").alias("dollar_volume"), F.sum("trade_count").alias("trade_count"),
    )
    return whole.select(*by, *FIELDS)


class Fold:
    """The open bar of one instrument; it closes once what it counts reaches the threshold and then starts from zero."""

    def __init__(self, threshold: float):
        self.threshold, self.open = threshold, None

    def feed(self, time: np.ndarray, price: np.ndarray, qty: np.ndarray, counted: np.ndarray, quote: np.ndarray) -> Iterator[tuple]:
        at, n, ahead = 0, len(time), 64
        while at < n:
            held = self.open[8] if self.open else 0.0
            sums = np.cumsum(np.concatenate([[held], counted[at : at + ahead]]))[1:]  # one addition after another
            reached = sums >= self.threshold
            full = bool(reached.any())
            size = int(reached.argmax()) + 1 if full else len(sums)
            part = slice(at, at + size)
            self._add(time[part], price[part], qty[part], quote[part], float(sums[size - 1]))
            at += size
            if full:
                yield self.close()
            ahead = min(max(64, 2 * size if full else 4 * ahead), 1 << 20)

    def _add(self, time: np.ndarray, price: np.ndarray, qty: np.ndarray, quote: np.ndarray, counted: float) -> None:
        seen = self.open or [int(time[0]), float(price[0]), -math.inf, math.inf, 0.0, 0.0, 0.0, 0, 0.0]
        sum_of = lambda start, x: float(np.cumsum(np.concatenate([[start], x]))[-1])
        self.open = [
            seen[0], seen[1], max(seen[2], float(np.fmax.reduce(price, initial=-math.inf))), min(seen[3], float(np.fmin.reduce(price, initial=math.inf))), float(price[-1]), sum_of(seen[5], qty), sum_of(seen[6], quote),
            seen[7] + len(time), counted,
        ]

    def close(self) -> tuple | None:
        bar, self.open = self.open, None
        return tuple(bar[:8]) if bar else None


def _threshold_bars(trades: DataFrame, threshold: float, counted: str, by: tuple[str, ...]) -> DataFrame:
    """A bar ends with the trade that fills it; no trade is split, nothing is carried over, the last open bar is given.

    Where a bar ends depends on where the one before ended, so an instrument is one sequence; it streams through its task
    in order with one open bar as state, and different instruments run side by side.
    """
    if not threshold > 0:
        raise ValueError("the threshold must be above zero")
    kinds = trades.schema
    keys = [f"{b} {kinds[b].dataType.simpleString()}" for b in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, now, out = Fold(threshold), None, []
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.groupby(list(by), sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(batch), np.int64)
            edge = [*np.flatnonzero(np.diff(codes, prepend=codes[0] - 1)).tolist(), len(batch)]
            for a, b in zip(edge, edge[1:], strict=False):
                part = batch.iloc[a:b]
                key = tuple(None if pd.isna(x) else x for x in part.iloc[0][list(by)]) if by else ()
                if key != now and now is not None and fold.open:
                    out.append((*now, *fold.close()))
                now = key
                out += [(*key, *bar) for bar in fold.feed(*(part[c].to_numpy() for c in ("time", "price", "qty", counted, "quote")))]
            if out:
                yield pd.DataFrame(out, columns=[*by, *FIELDS])
                out = []
        if fold.open:
            yield pd.DataFrame([(*now, *fold.close())], columns=[*by, *FIELDS])

    cut = trades.select(*by, "seq", "time", "price", "qty", "quote")
    dealt = cut.repartition(*by).sortWithinPartitions(*by, "seq") if by else cut.repartition(1).sortWithinPartitions("seq")
    return dealt.mapInPandas(run, ", ".join([*keys, BAR]))


def volume_bars(trades: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    return _threshold_bars(trades, threshold, "qty", by)


def dollar_bars(trades: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    return _threshold_bars(trades, threshold, "quote", by)


def calculate_thresholds(trades: DataFrame, target: int, by: tuple[str, ...] = ()) -> DataFrame:
    """interval, volume_threshold and dollar_threshold that make about `target` bars of each kind."""
    if target <= 0:
        raise ValueError("target must be above zero")
    sums = trades.groupBy(*by).agg(F.min("time").alias("low"), F.max("time").alias("high"), F.sum("qty").alias("q"), F.sum("quote").alias("d"))
    each = F.expr(f"(high - low) div {int(target)}")
    whole = lambda ms, unit: F.concat(F.floor(each / ms).cast("long").cast("string"), F.lit(unit))
    text = F.when(each >= 86_400_000, whole(86_400_000, "d")).when(each >= 3_600_000, whole(3_600_000, "h")).otherwise(
        F.concat(F.greatest(F.floor(each / 60_000), F.lit(1)).cast("long").cast("string"), F.lit("m"))
    )
    checked = F.when(F.coalesce(F.col("low") >= F.col("high"), F.lit(True)), F.raise_error(F.lit("trades span no time"))).otherwise(text)
    return sums.select(*by, checked.alias("interval"), (F.col("q") / target).alias("volume_threshold"), (F.col("d") / target).alias("dollar_threshold"))
