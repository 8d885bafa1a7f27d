"""Price panels in long form (t, asset_idx, asset, px) and what is done to them column by column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def by_asset():
    return W.partitionBy("asset_idx").orderBy("t")


def to_panel(wide: DataFrame, order_by: str = "t", exclude: tuple[str, ...] = ()) -> DataFrame:
    """A wide table as a panel. Rows are numbered 0, 1, ... by order_by, which may be a row number with gaps."""
    names = [c for c in wide.columns if c != order_by and c not in exclude]
    cells = F.array(*[F.struct(F.lit(i).alias("asset_idx"), F.lit(n).alias("asset"), F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double")).alias("px")) for i, n in enumerate(names)])
    return with_row_numbers(wide.select(F.col(f"`{order_by}`").alias("at"), F.explode(cells).alias("c")).select("at", "c.*"))


def with_row_numbers(cells: DataFrame) -> DataFrame:
    """(at, asset_idx, asset, px) with t instead of at: the rank of at among the distinct ones.

    Only the distinct values of `at`, one for each row of the matrix, are numbered in one window.
    """
    times = cells.select("at").distinct().select("at", (F.row_number().over(W.orderBy("at")) - 1).cast("long").alias("t"))
    return cells.join(times, "at").select("t", "asset_idx", "asset", "px")


def to_wide(panel: DataFrame) -> DataFrame:
    names = [r["asset"] for r in panel.select("asset_idx", "asset").distinct().orderBy("asset_idx").collect()]  # columns of the result
    return panel.groupBy("t").pivot("asset", names).agg(F.first("px")).orderBy("t")


def dense(panel: DataFrame) -> DataFrame:
    """A row for each asset and each t from 0 to the last; what is missing is null."""
    last = panel.agg(F.max("t").alias("last"))
    grid = panel.select("asset_idx", "asset").distinct().join(F.broadcast(last)).select("asset_idx", "asset", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t"))
    return grid.join(panel.select("t", "asset_idx", "px"), ["t", "asset_idx"], "left").select("t", "asset_idx", "asset", F.nanvl("px", F.lit(None).cast("double")).alias("px"))


def null_rule(panel: DataFrame, max_null_fraction: float = 0.5) -> DataFrame:
    """Assets whose share of nulls is below the bound; panel must be dense."""
    kept = panel.groupBy("asset_idx").agg(F.avg(F.col("px").isNull().cast("int")).alias("share")).where(F.col("share") < max_null_fraction)
    return panel.join(kept.select("asset_idx"), "asset_idx", "left_semi")


def clean(panel: DataFrame, max_null_fraction: float | None = None) -> DataFrame:
    """Gaps take the last price before them, leading gaps the first price; assets without any price are dropped.

    Infinite prices stay. panel must be dense.
    """
    kept = panel if max_null_fraction is None else null_rule(panel, max_null_fraction)
    before = F.last("px", ignorenulls=True).over(by_asset().rowsBetween(W.unboundedPreceding, 0))
    first = F.first("px", ignorenulls=True).over(by_asset().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return kept.select("t", "asset_idx", "asset", F.coalesce(before, first).alias("px")).where(F.col("px").isNotNull())


def select_columns(panel: DataFrame, indices: list[int]) -> DataFrame:
    return panel.where(F.col("asset_idx").isin(indices))


def first_diff(panel: DataFrame) -> DataFrame:
    return panel.withColumn("diff", F.col("px") - F.lag("px").over(by_asset())).where("diff is not null")


def demean(panel: DataFrame) -> DataFrame:
    return panel.withColumn("centred", F.col("px") - F.avg("px").over(W.partitionBy("asset_idx")))


def pct_returns(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(p1 - p0) / p0, and 0 where p0 is all but zero; rows with a price before them."""
    last = F.lag("px").over(W.partitionBy(*by, "asset_idx").orderBy("t"))
    moved = panel.withColumn("p0", last).where("p0 is not null")
    return moved.withColumn("ret", F.when(F.abs("p0") > 1e-15, (F.col("px") - F.col("p0")) / F.col("p0")).otherwise(0.0)).drop("p0")


def fold_table(panel: DataFrame, train: int, step: int, embargo: int) -> DataFrame:
    """(fold, start): windows of `train` rows, as long as train + embargo + step rows are left."""
    if step <= 0 or train <= 0 or embargo < 0:
        raise ValueError("train and step must be above zero, embargo not below")
    rows = panel.agg((F.max("t") + 1).alias("rows"))
    last = F.col("rows") - (train + embargo + step)
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    return rows.select(F.posexplode(starts).alias("fold", "start")).select(F.col("fold").cast("long").alias("fold"), "start")


def fold_rows(panel: DataFrame, train: int, step: int, embargo: int) -> DataFrame:
    """The panel once for each fold that holds the row: fold, rel (row within the fold) and the panel's columns.

    The folds that hold row t are found by arithmetic, so neither a range join nor a list of folds is needed.
    """
    rows = panel.agg((F.max("t") + 1).alias("rows"))
    placed = panel.join(F.broadcast(rows))
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - train + 1) / F.lit(step)))
    high = F.least(F.floor(F.col("t") / F.lit(step)), F.floor((F.col("rows") - (train + embargo + step)) / F.lit(step)))
    folds = F.when(high >= low, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>"))
    return placed.select(F.explode(folds).alias("fold"), "t", "asset_idx", "asset", "px").withColumn("rel", F.col("t") - F.col("fold") * step)


def sub_windows(rows: DataFrame, train: int, n_sub: int) -> DataFrame:
    """fold rows with sub, the number of the equal part of the window they lie in; the remainder is dropped."""
    size = train // n_sub
    return rows.withColumn("sub", F.floor(F.col("rel") / F.lit(size)).cast("int")).where(F.col("sub") < n_sub)


def append(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
