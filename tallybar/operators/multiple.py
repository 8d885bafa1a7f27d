"""Corrections for many tests, as window expressions over a column of p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def benjamini_hochberg(tests: DataFrame, alpha: float, by: tuple[str, ...] = (), p: str = "p_valor", order: tuple[str, ...] = ("combo_id",)) -> DataFrame:
    """Adds accepted: rank k by (p, order) is within the largest k with p_k <= k / m * alpha."""
    group = W.partitionBy(*by)
    ranked = tests.withColumn("tb_k", F.row_number().over(group.orderBy(p, *order))).withColumn("tb_m", F.count(F.lit(1)).over(group))
    last = F.max(F.when(F.col(p) <= F.col("tb_k") / F.col("tb_m") * alpha, F.col("tb_k"))).over(group)
    return ranked.withColumn("accepted", F.coalesce(F.col("tb_k") <= last, F.lit(False))).drop("tb_k", "tb_m")


def bonferroni(tests: DataFrame, alpha: float, by: tuple[str, ...] = (), p: str = "p_valor") -> DataFrame:
    """Adds accepted: p <= alpha / m."""
    bound: Column = F.lit(alpha) / F.count(F.lit(1)).over(W.partitionBy(*by))
    return tests.withColumn("accepted", F.col(p) <= bound)


def corrected(tests: DataFrame, method: str, alpha: float, by: tuple[str, ...] = ()) -> DataFrame:
    """"bh" is Benjamini and Hochberg's; any other name is Bonferroni's."""
    return benjamini_hochberg(tests, alpha, by) if method == "bh" else bonferroni(tests, alpha, by)
