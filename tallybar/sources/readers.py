"""Readers of trades and of price series, and a Parquet footer report."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REAL = (T.DoubleType, T.FloatType)
_SERIES = (T.DoubleType, T.FloatType, T.LongType)
#: What counts as a number in a text cell: no blanks around, no type suffix.
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"


def millis(df: DataFrame, name: str) -> Column:
    """A time column as milliseconds: longs are taken as such, timestamps with or without zone are converted; nulls are errors."""
    kind = df.schema[name].dataType
    held = F.when(F.col(name).isNull(), F.raise_error(F.lit(f"null in {name}"))).otherwise(F.col(name))
    if isinstance(kind, T.LongType):
        return held
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        return F.unix_millis(held.cast("timestamp"))
    raise TypeError(f"time column {name} has type {kind.simpleString()}; a long or a timestamp is needed")


def as_trades(df: DataFrame, seq: str, time: str = "DateTime", price: str = "Price", qty: str = "Qty", by: tuple[str, ...] = ()) -> DataFrame:
    """by columns, seq, time (ms), price, qty and quote from columns of any names; only these columns are read."""
    for name in (price, qty):
        if name not in df.columns:
            raise ValueError(f"missing column {name}")
        if not isinstance(df.schema[name].dataType, _REAL):
            raise TypeError(f"{name} has type {df.schema[name].dataType.simpleString()}; float or double is needed")
    held = lambda name: F.when(F.col(name).isNull(), F.raise_error(F.lit(f"null in {name}"))).otherwise(F.col(name).cast("double"))
    p, q = held(price), held(qty)
    return df.select(*by, F.col(seq).cast("long").alias("seq"), millis(df, time).alias("time"), p.alias("price"), q.alias("qty"), (p * q).alias("quote"))


NANOS = "spark.sql.legacy.parquet.nanosAsLong"


def read_trades(spark: SparkSession, path: str, by: tuple[str, ...] = (), time: str = "DateTime") -> DataFrame:
    """Trades of a Parquet file or folder in file order: (file, row) is the order, packed into one long.

    Spark reads times in nanoseconds only as longs, in sessions with spark.sql.legacy.parquet.nanosAsLong, as `build`
    makes them; the footer of a file tells them from longs that are milliseconds.
    """
    df = spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias("tb_row"), F.col("_metadata.file_path").alias("tb_file"))
    files = sorted(df.inputFiles())
    if time in df.columns and isinstance(df.schema[time].dataType, T.LongType) and spark.conf.get(NANOS) == "true" and files:
        if column_type(spark, files[0], time).startswith("timestamp[ns"):
            df = df.withColumn(time, F.expr(f"`{time}` div 1000000"))
    if len(files) <= 1:
        return as_trades(df, "tb_row", time, by=by)
    number = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f, i)]), F.col("tb_file"))
    return as_trades(df.withColumn("tb_seq", F.shiftleft(number.cast("long"), 40) + F.col("tb_row")), "tb_seq", time, by=by)


def footers(spark: SparkSession, files: list[str], read: Callable, schema: str) -> DataFrame:
    """A row of what `read` takes from each file's footer, where the tasks run and through the paths that Spark lists."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            out = []
            for uri in batch["uri"]:
                system, at = pafs.FileSystem.from_uri(uri)
                with system.open_input_file(at) as f:
                    out.append(read(pq.ParquetFile(f)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return spark.createDataFrame([(f,) for f in files], "uri string").mapInPandas(run, schema)


def column_type(spark: SparkSession, file: str, name: str) -> str:
    """The Arrow type of a column, by the footer of one file."""
    return footers(spark, [file], lambda f: (str(f.schema_arrow.field(name).type),), "kind string").first()["kind"]


def number(cell: Column) -> Column:
    return F.when(F.lower(cell).rlike(NUMBER), cell.try_cast("double"))


def read_series(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A wide table: t (row number) and one double column for each numeric column of a .parquet, .pq, .csv or .tsv file.

    Text files: a column is numeric if its first non-empty cell is a number; other cells that are none become null.
    Tabs separate the cells of .tsv.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".parquet", ".pq"):
        df = spark.read.parquet(path)
        names = [f.name for f in df.schema if isinstance(f.dataType, _SERIES) and f.name not in exclude]
        if not names:
            raise ValueError(f"no numeric column in {path}")
        row = F.col("_metadata.row_index").alias("t")
        return df.select(row, *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    if kind not in (".csv", ".tsv"):
        raise ValueError(f"unknown kind of file: {path}")
    df = spark.read.option("header", True).option("sep", "\t" if kind == ".tsv" else ",").option("mode", "PERMISSIVE").csv(path)
    if not df.columns:
        raise ValueError(f"empty file: {path}")
    rows = df.withColumn("t", F.monotonically_increasing_id())
    firsts = rows.agg(*[F.min_by(F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")), F.when(F.col(f"`{n}`") != "", F.col("t"))).alias(str(i)) for i, n in enumerate(df.columns)])
    numeric = firsts.select(*[F.lower(F.col(str(i))).rlike(NUMBER).alias(str(i)) for i in range(len(df.columns))]).first()
    names = [n for i, n in enumerate(df.columns) if numeric[str(i)] and n not in exclude]
    if not names:
        raise ValueError(f"no numeric column in {path}")
    return rows.select("t", *[number(F.col(f"`{n}`")).alias(n) for n in names])


def parquet_info(spark: SparkSession, path: str) -> DataFrame:
    """num_rows, num_row_groups, column_names (joined by commas) and columns of a Parquet file or folder, from the footers alone."""
    df = spark.read.parquet(path)
    found = footers(spark, list(df.inputFiles()), lambda f: (f.metadata.num_rows, f.metadata.num_row_groups), "r long, g long")
    sums = found.agg(F.sum("r").alias("num_rows"), F.sum("g").alias("num_row_groups"))
    return sums.withColumn("column_names", F.lit(",".join(df.columns))).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))
