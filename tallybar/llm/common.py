"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_DIR = "/tmp/tallybar-checkpoint"
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: Bytes of text that an operator works on at a time, about; Spark bounds what it sends at once by 64 MB.
PART_BYTES = 1 << 22


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of this machine serves only where all runs in one process."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    return LOCAL_DIR


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, texts go to Python in batches of at most 2,000 rows; afterwards the session has its own setting again."""
    own = spark.conf.get(BATCH_KEY)
    if 0 < int(own) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH_KEY, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, own)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.tb_path = path
    return back


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that materialize wrote; only for those that no frame still in use reads."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.tb_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types; a column that is absent is null throughout.

    Names are matched exactly first, so that extra columns differing in case do not clash.
    """
    return df.select(*[
        (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()
    ])


def parts_of(batch: pa.RecordBatch, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of strings, of a row at least."""
    held = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    if not held or sum(c.nbytes for c in held) <= limit:
        yield batch
        return
    sizes = [sum(x or 0 for x in row) for row in zip(*[pc.binary_length(c).to_pylist() for c in held], strict=True)]
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    yield batch.slice(begin)


def by_row(rows: DataFrame, make: Callable[..., dict], schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row: the columns in `keep` as they are, and what `make` gives for lists of the values of the others.

    Kept columns never leave Arrow: pandas would hold a long beside a null as a double, which cannot tell large ids apart.
    """
    target = to_arrow_schema(T.StructType.fromDDL(schema))
    taken = [c for c in rows.columns if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                made = make(*[part.column(c).to_pylist() for c in taken])
                yield pa.RecordBatch.from_arrays([part.column(f.name) if f.name in keep else pa.array(made[f.name], f.type) for f in target], schema=target)

    return rows.mapInArrow(run, schema)
