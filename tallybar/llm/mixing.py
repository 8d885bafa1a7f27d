"""Mixing sources to target weights: a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule, a straight line over the training time 0..1. Its integral is the source's share of
the demand; targets stop at a multiple of the source's size, and what is over goes to the others by weight. Within a
source the documents lie one after another on its token axis, in the order of the MD5 of their id, again and again; a
copy is taken if its middle lies before the target, and its training position is the time at which the source's
integrated weight has asked for the tokens before it. ``training_order`` sorts the copies by position over ranges.

Running sums use two levels: per (source, first three digits of the hash), then within each of these cells, so that a
source of any size is spread over 4096 cells.

Defined results: a null text has size 0; sizes of 0 are never taken; a null source is a source of its own, the last;
an empty table gives no rows; repeated rows are documents of their own, ordered by (hash, id, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybar.llm.common import columns, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at the start and at the end of training, by rank of the source; the integral of each is 1.
TILTS = ((1.4, 0.6), (1.0, 1.0), (0.6, 1.4))
#: Sources beyond this number are joined by a shuffle and not broadcast.
BROADCAST_SOURCES = 10_000


def _pick(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """rank, source, source_size, weight, target and the schedule's ends of each source.

    Targets are min(cap x size, level x weight). With the sources in order of cap x size / weight the first i of them
    are full, for the smallest i at which the level of the rest fills none of the rest.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sums.select("source", "source_size", rank.alias("rank")).withColumn("weight", _pick(weights, F.col("rank")))
    ranked = ranked.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    order = W.orderBy("ratio", "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)
    filled = leveled.withColumn("first", first)
    return filled.select(
        "rank", "source", "source_size", "weight",
        F.when(F.col("first").isNull(), cap * F.col("source_size")).otherwise(F.least(cap * F.col("source_size"), F.col("first.level") * F.col("weight"))).alias("target"),
        _pick(tuple(t[0] for t in tilts), F.col("rank")).alias("start_weight"), _pick(tuple(t[1] for t in tilts), F.col("rank")).alias("end_weight"),
    )


def when_asked(part: Column, start: Column, end: Column) -> Column:
    """The time at which a schedule from start to end has asked for this part of its whole demand."""
    whole = (start + end) / 2
    slope = end - start
    curved = (-start + F.sqrt(F.greatest(start * start + 2 * slope * part * whole, F.lit(0.0)))) / F.when(F.abs(slope) < 1e-12, F.lit(1.0)).otherwise(slope)
    return F.when(F.abs(slope) < 1e-12, part).otherwise(curved)


def laid_out(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """What mix gives, and tb_row, a number of each row."""
    rows = columns(docs, doc_id="long", source="string", text="string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(spark, rows.select(F.monotonically_increasing_id().alias("tb_row"), "doc_id", "source", size.alias("size"), key.alias("key")), "mix-sizes")
    targets = materialize(spark, source_targets(sized, weights, tilts, share, cap), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    known = sized.withColumn("cell", F.substring("key", 1, 3)).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    cells = known.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = F.sum("cell_size").over(W.partitionBy("rank").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select(F.col("rank").alias("c_rank"), F.col("cell").alias("c_cell"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum("size").over(W.partitionBy("rank", "cell").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    laid = known.withColumn("within", F.coalesce(within, F.lit(0))).join(cells, (F.col("rank") == F.col("c_rank")) & (F.col("cell") == F.col("c_cell")))
    offset = F.col("ahead") + F.col("within")
    room = F.col("target") - offset - F.col("size") / 2
    copies = F.when((F.col("size") > 0) & (room > 0), F.ceil(room / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    part = F.least(offset / F.greatest("target", F.lit(1e-9)), F.lit(1.0))
    return laid.withColumn("offset", offset).select(
        "tb_row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "offset", "start_weight", "end_weight",
        F.when(copies > 0, when_asked(part, F.col("start_weight"), F.col("end_weight"))).alias("position"),
    )


def mix(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and first position (null if not taken) of every row."""
    return laid_out(spark, docs, weights, tilts, share, cap).drop("tb_row")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, sorted by training position: doc_id, copy, position."""
    copies = mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    part = F.least((F.col("offset") + F.col("copy") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    placed = copies.withColumn("position", when_asked(part, F.col("start_weight"), F.col("end_weight")))
    own = [c for c in mixed.columns if c == "tb_row"]
    return placed.select("doc_id", "source", "size", "copy", "position", *own).orderBy("position", "source", "doc_id", "copy")


def mix_in_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What mix gives of every row, counted in the training order: all copies are dealt, sorted over ranges and written first."""
    laid = materialize(spark, laid_out(spark, docs), "mix")
    order = materialize(spark, training_order(laid), "training-order")
    seen = order.groupBy("tb_row").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("taken"), F.min("position").alias("position"))
    zero = F.lit(0).cast("long")
    return laid.drop("copies", "taken", "position").join(seen, "tb_row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("copies", zero).alias("copies"), F.coalesce("taken", zero).alias("taken"), "position"
    )
