"""Document fingerprints: canonical exact digests.

A text is made canonical (Unicode normalisation NFKC, case folding, NFKC again, white space to one space) and hashed to
128 bits by xxHash3. Texts with equal hashes are compared byte by byte: the smallest and the largest canonical text of a
bucket are gathered by a pre-aggregated minimum and maximum, and a bucket in which they differ is told apart by a second
hash. Only documents whose hash may be in a bucket of two or more are compared; a bitmap of fixed size names them.

Defined results: a null text is empty and has the digest of the empty text; a null doc_id comes after all others;
rows with one doc_id are ordered by text; the only document is its own next one; an empty table gives no rows. Likenesses
compare bytes; the fingerprint of an edited text is told apart from another document's where two documents differ.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybar.llm.common import by_row, columns, materialize, parts_of

#: Bits of the map of buckets; it goes to every task, so its size is fixed.
MAP_BITS = 1 << 23


def canonical(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "replace")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def second(canon: bytes) -> str:
    return xxhash.xxh64_hexdigest(canon, 1)


def likeness(a: bytes, b: bytes) -> float:
    """Of two exact fingerprints: 1 if the canonical texts are the same bytes, else 0."""
    return 1.0 if a == b else 0.0


def clashes(spark: SparkSession, docs: DataFrame, digests: DataFrame, name_of=digest) -> DataFrame:
    """Fingerprints whose documents differ in canonical bytes; digests: a column `fingerprint` for each document."""
    buckets = digests.groupBy("fingerprint").count().where("count > 1")
    slot = F.pmod(F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long"), F.lit(MAP_BITS))
    words = buckets.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("b"))
    bits = np.zeros(MAP_BITS // 64, np.int64)
    for row in words.collect():  # at most MAP_BITS / 64 rows, whatever the table's size
        bits[row["w"]] = row["b"]
    held = np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool) if bits.any() else None
    packed = None if held is None else np.packbits(held)

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                canon = canonical(text)
                name = name_of(canon)
                at = int(name[:15], 16) % MAP_BITS
                if packed is not None and packed[at >> 3] >> (7 - (at & 7)) & 1:
                    out.append((name, canon))
            yield pd.DataFrame(out, columns=["fingerprint", "canon"])

    rows = columns(docs, text="string").mapInPandas(suspects, "fingerprint string, canon binary")
    ends = rows.groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return ends.where("low != high").select("fingerprint")


def _told_apart(frame: DataFrame, clash: DataFrame, name: str, other: str) -> DataFrame:
    joined = frame.join(clash.select(F.col("fingerprint").alias("clash")), F.col(name) == F.col("clash"), "left")
    return joined.withColumn(name, F.when(F.col("clash").isNull(), F.col(name)).otherwise(F.concat_ws("-", name, other))).drop("clash")


def fingerprint(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document; equal fingerprints mean equal canonical bytes."""

    def make(texts: list) -> dict:
        canon = [canonical(t) for t in texts]
        return {"fingerprint": [digest(c) for c in canon], "other": [second(c) for c in canon]}

    found = materialize(spark, by_row(columns(docs, doc_id="long", text="string"), make, "doc_id long, fingerprint string, other string"), "fingerprints")
    clash = materialize(spark, clashes(spark, docs, found), "clashes")
    return _told_apart(found, clash, "fingerprint", "other").drop("other")


def in_order_with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, last, doc_id, text) dealt and sorted so that each document stands before the next one by doc_id.

    Bounds between buckets are ids that occur. The first document of a bucket is dealt to the bucket before it too, behind
    all others (last = 1), and the first of all to the last bucket; a bucket thus holds the next of each of its own.
    """
    rows = columns(docs, doc_id="long", text="string")
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares or [0.5], 100 * max(buckets, 100)).alias("at")).first()
    low = found["low"]
    bounds = sorted({*(found["at"] or ())} - {low}) if low is not None and shares else []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.fillna(2**63 - 1).to_numpy(np.int64), side="right").astype(np.int32))

    own = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(bucket_of(F.coalesce("doc_id", F.lit(0))))
    placed = rows.withColumn("bucket", own)
    first_of_own = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    if bounds:
        copy = F.when(first_of_own, F.col("bucket") - 1).when(F.col("doc_id") == low, F.lit(len(bounds)))
    else:
        copy = F.lit(None).cast("int")
    places = F.filter(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("last")), F.struct(copy.alias("bucket"), F.lit(1).alias("last"))), lambda p: p["bucket"].isNotNull())
    dealt = placed.select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "p.last", "doc_id", "text")
    return dealt.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "last", F.col("doc_id").asc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_edited(spark: SparkSession, docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likenesses."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, other string, edited_other string"
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = None  # (bucket, doc_id, text, canonical, last) waiting for its next; the first of the bucket

        def pair(own: tuple, after: tuple) -> tuple:
            text = edited(own[2], after[2])
            canon = canonical(text)
            return (
                own[1], len(own[2]), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), digest(own[3]), digest(canon),
                likeness(own[3], canon), likeness(own[3], after[3]), second(own[3]), second(canon),
            )

        def frame(out: list) -> pa.RecordBatch:
            held = zip(*out, strict=True) if out else [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, target, strict=True)], schema=target)

        for batch in batches:
            for part in parts_of(batch):
                out = []
                for bucket, last, doc, text in zip(*[part.column(c).to_pylist() for c in ("bucket", "last", "doc_id", "text")], strict=True):
                    row = (bucket, doc, text or "", canonical(text), last)
                    if now is not None and now[0] != bucket:
                        out.append(pair(now, first)) if not now[4] else None
                        now = first = None
                    if now is not None and not now[4]:
                        out.append(pair(now, row))
                    first = first or row
                    now = row
                yield frame(out)
        if now is not None and not now[4]:
            yield frame([pair(now, first)])

    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(spark, in_order_with_next(docs, n).mapInArrow(run, schema), "edited")
    clash = materialize(spark, clashes(spark, docs, found.select("fingerprint")), "clashes")
    told = _told_apart(_told_apart(found, clash, "fingerprint", "other"), clash, "edited_fingerprint", "edited_other")
    return told.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
