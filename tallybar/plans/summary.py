"""Summaries of a walk-forward detail table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(detail: DataFrame) -> DataFrame:
    """One row for each set of assets over its folds, the most frequent first; a deviation of one fold is 0."""
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return (
        detail.groupBy("ativos")
        .agg(
            F.count("n_ativos").alias("n_folds_apareceu"), F.first("n_ativos").alias("n_ativos"),
            F.avg("half_life").alias("half_life_media"), std("half_life").alias("half_life_std"), F.min("half_life").alias("half_life_min"), F.max("half_life").alias("half_life_max"),
            F.avg("adf_pvalor").alias("adf_pvalor_media"), F.max("adf_pvalor").alias("adf_pvalor_max"),
            F.avg("hurst").alias("hurst_media"), std("hurst").alias("hurst_std"), F.max("hurst").alias("hurst_max"),
            F.avg("variance_ratio").alias("vr_media"), std("variance_ratio").alias("vr_std"),
            F.avg("estabilidade").alias("estabilidade_media"), F.min("estabilidade").alias("estabilidade_min"),
            F.avg("score_johansen").alias("score_johansen_media"), F.min("score_johansen").alias("score_johansen_min"),
        )
        .orderBy(F.col("n_folds_apareceu").desc(), "ativos")
    )


def top(summary: DataFrame, n: int = 20) -> DataFrame:
    return summary.orderBy(F.col("n_folds_apareceu").desc(), "ativos").limit(n)
