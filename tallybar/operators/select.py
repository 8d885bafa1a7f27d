"""Which assets and which sets of assets are tested."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybar.operators.panel import pct_returns

#: Rows of a panel whose products are taken at once.
ROWS = 512


def _products(panel: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, i, n, s, g): each asset's sum of returns over n rows and its row of the matrix of products, in order of assets.

    Blocks of rows give partial matrices, which are added up row by row; nothing is emitted for a pair and a time.
    """
    kinds = panel.schema
    keys = [f"{b} {kinds[b].dataType.simpleString()}" for b in by]

    def partial(block: pd.DataFrame) -> pd.DataFrame:
        assets, column = np.unique(block["asset_idx"].to_numpy(), return_inverse=True)
        times, row = np.unique(block["t"].to_numpy(), return_inverse=True)
        returns = np.zeros((len(times), len(assets)))
        returns[row, column] = block["ret"].to_numpy()
        out = pd.DataFrame({"i": assets, "n": len(times), "s": returns.sum(0), "g": list(returns.T @ returns)})
        for k in reversed(by):
            out.insert(0, k, block[k].iloc[0])
        return out

    returns = pct_returns(panel, by).select(*by, "t", "asset_idx", "ret", F.floor(F.col("t") / ROWS).alias("tb_block"))
    parts = returns.groupBy(*by, "tb_block").applyInPandas(partial, ", ".join([*keys, "i int", "n long", "s double", "g array<double>"]))
    added = F.reduce(F.collect_list("g"), F.transform(F.first("g"), lambda _: F.lit(0.0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return parts.groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), added.alias("g"))


def _counted(panel: DataFrame, min_corr: float, by: tuple[str, ...]) -> DataFrame:
    """correlation_counts, with the number of returns."""
    own = W.partitionBy(*by)
    sums = _products(panel, by).withColumn("tb_at", (F.row_number().over(own.orderBy("i")) - 1).cast("int"))
    scaled = sums.withColumn("norm", F.greatest(F.sqrt(F.greatest(F.get("g", "tb_at") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))), F.lit(1e-15)))
    every = scaled.withColumn("all", F.sort_array(F.collect_list(F.struct("i", "s", "norm")).over(own)))
    near = F.transform("all", lambda x, j: (x["i"] != F.col("i")) & F.coalesce(F.nanvl(F.abs((F.get("g", j) - F.col("s") * x["s"] / F.col("n")) / F.col("norm") / x["norm"]), F.lit(0.0)) >= min_corr, F.lit(False)))
    found = every.select(*by, F.col("i").alias("asset_idx"), F.size(F.filter(near, lambda x: x)).cast("long").alias("cnt"), "n")
    return panel.select(*by, "asset_idx").distinct().join(found, [*by, "asset_idx"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def correlation_counts(panel: DataFrame, min_corr: float, by: tuple[str, ...] = ()) -> DataFrame:
    """For each asset, with how many others its returns correlate at |r| >= min_corr. The panel must be dense."""
    return _counted(panel, min_corr, by).drop("n")


def correlation_prefilter(panel: DataFrame, min_corr: float, top_n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The top_n assets by count, ties by lower index. The bound only ranks: assets without any such correlation stay in.

    Where there are fewer than three rows, nothing can be ranked and all assets stay.
    """
    ranked = _counted(panel, min_corr, by).withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("cnt").desc(), "asset_idx")))
    return ranked.where((F.col("rank") <= top_n) | (F.coalesce("n", F.lit(0)) < 2)).drop("rank", "n")


def combinations(selected: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """All sets of k assets in each group, as sorted arrays, with their lexicographic number."""
    start = selected.select(*by, F.col("asset_idx").alias("last"), F.array("asset_idx").alias("combo"))
    for _ in range(k - 1):
        more = selected.select(*[F.col(b).alias(f"m_{b}") for b in by], F.col("asset_idx").alias("nxt"))
        on = F.col("nxt") > F.col("last")
        for b in by:
            on = on & (F.col(b) == F.col(f"m_{b}"))
        start = start.join(more, on).select(*by, F.col("nxt").alias("last"), F.concat("combo", F.array("nxt")).alias("combo"))
    return start.select(*by, "combo", (F.row_number().over(W.partitionBy(*by).orderBy("combo")) - 1).cast("long").alias("combo_id"))


def n_combinations(counts: list[int], low: int, high: int) -> int:
    """Over all folds, how many sets of low..high of the assets left there are."""
    return sum(comb(n, k) for n in counts for k in range(low, min(high, n) + 1))
