"""Benchmark decontamination, in DataFrame functions only.

The windows of ten words of the benchmark items (an item of fewer words is one window) form a hash set that travels with
the plan. Each document's windows are looked up in it by their 64-bit hash, and a hit is verified on the words
themselves. The set holds at most ``max_set`` windows. Of a larger one a bitmap travels instead, of at most 2^27 bits; only windows
that it holds are shuffled to meet the set. Documents with hits are dropped, or the hit words are cut out of them.

Defined results: null texts have no words and are clean; items without words match nothing; repeated items count once
by item_id, and items without an item_id count as one whose name is empty; repeated documents are judged one by one; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybar.llm.common import columns, materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text that is not lower-cased yet, and its words.
RAW_SEPARATORS, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
MAX_SET = 50_000
#: Bits of the bitmap of a larger set.
MAP_BITS = (1 << 16, 1 << 27)
#: Words of a window that the first look-up hashes.
PREFIX = 3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _starts(size: Column, n: int) -> Column:
    return F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (words of the window), gram (words joined by a space), its hash and that of its first words, each once."""
    items = columns(bench, item_id="string", text="string").select(F.coalesce("item_id", F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = items.select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("g"))
    return grams.select("item_id", "n", F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("hash"), F.xxhash64(F.slice("g", 1, PREFIX)).alias("prefix")).distinct()


def _words_at(i: Column, n: int) -> list[Column]:
    return [F.get("w", i + (k - 1)) for k in range(n)]


def _verified(n: int, grams: list) -> Column:
    """The windows of n words that are in the set: by a hash of the first words, by that of all, then by the words.

    Words are fetched one by one; taking a slice would walk the whole array for every window.
    """
    text = lambda i: F.concat_ws(" ", *_words_at(i, n))
    first = min(n, PREFIX)
    in_set = lambda i: F.xxhash64(*_words_at(i, n)).isin(sorted({g["hash"] for g in grams})) & text(i).isin(sorted({g["gram"] for g in grams}))
    found = F.filter(_starts(F.size("w"), n), lambda i: F.xxhash64(*_words_at(i, first)).isin(sorted({g["prefix"] for g in grams})) & in_set(i))
    return F.transform(found, lambda i: F.struct(i.alias("start"), (i + n).alias("end"), text(i).alias("gram")))


def _hits(sized: DataFrame, grams: list) -> DataFrame:
    """Adds hits: array of (start, end, gram) of the verified windows in order of their start."""
    arrays = [_verified(n, [g for g in grams if g["n"] == n]) for n in sorted({g["n"] for g in grams})]
    kind = "array<struct<start:int,end:int,gram:string>>"
    return sized.withColumn("hits", F.sort_array(F.concat(*arrays)) if arrays else F.array().cast(kind))


def _bitmap(grams: DataFrame) -> tuple[DataFrame, int]:
    """(one row with the bits of all windows' hashes as an array of longs, how many bits): 16 or more for each, 2^27 at most."""
    count = grams.select("hash").distinct().count()
    bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (16 * count - 1).bit_length()))
    slot = F.pmod("hash", F.lit(bits))
    words_ = grams.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("b"))
    every = grams.sparkSession.range(bits // 64).join(words_, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    blocks = every.groupBy(F.shiftright("id", 12).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bs"))
    return blocks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "bs"))), lambda x: x["bs"])).alias("bits")), bits


def _hits_by_join(spark: SparkSession, sized: DataFrame, grams: DataFrame) -> DataFrame:
    """The same for a set too large to travel: the windows that its bitmap holds meet it in a shuffled join."""
    base = materialize(spark, sized, "decontaminate-words")
    one, bits = _bitmap(grams)
    lit_up = base.select("row", "w").join(F.broadcast(materialize(spark, one, "decontaminate-bitmap")))  # one row of bits / 8 bytes

    def held(i: Column, n: int) -> Column:
        slot = F.pmod(F.xxhash64(*_words_at(i, n)), F.lit(bits))
        return F.getbit(F.get("bits", F.shiftright(slot, 6).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1

    distinct = grams.select("n", "gram", "hash").distinct()
    lengths = [r["n"] for r in distinct.select("n").distinct().collect()]  # at most `window` values
    parts = []
    for n in lengths:  # a lambda is used before the next n
        window = lambda i: F.struct(i.alias("start"), F.concat_ws(" ", *_words_at(i, n)).alias("gram"), F.xxhash64(*_words_at(i, n)).alias("hash"))
        some = F.filter(_starts(F.size("w"), n), lambda i: held(i, n))
        keyed = lit_up.select("row", F.explode(F.transform(some, window)).alias("x")).select("row", "x.*")
        met = keyed.join(distinct.where(F.col("n") == n).select("hash", "gram"), ["hash", "gram"])
        parts.append(met.select("row", F.struct("start", (F.col("start") + n).alias("end"), "gram").alias("hit")))
    if not parts:
        return base.withColumn("hits", F.array().cast("array<struct<start:int,end:int,gram:string>>"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    gathered = union.groupBy("row").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    return base.join(gathered, "row", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<start:int,end:int,gram:string>>")))


def _covered(hits: Column) -> Column:
    """How many words lie in a hit."""
    step = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], a["to"]))).alias("n"), F.greatest(a["to"], h["end"]).alias("to"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"]).cast("long")


def scan(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(documents with row, n_words, hits and n_hit, benchmark windows). `keep` names columns of docs to carry along."""
    grams = materialize(spark, benchmark_windows(bench, window), "decontaminate-grams")
    held = lambda c, kind: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kind)
    # a projection with a row number is never merged into the next one, which would split the text again for every window
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)], held("doc_id", "long").alias("doc_id"), words(held("text", "string")).alias("w")
    )
    few = grams.select("n", "gram", "hash", "prefix").distinct().limit(max_set + 1).collect()
    found = _hits(sized, few) if len(few) <= max_set else _hits_by_join(spark, sized, grams)
    out = found.withColumn("n_words", F.size("w").cast("long")).withColumn("n_hit", _covered(F.col("hits"))).drop("w")
    return out, grams


def report(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found, grams = scan(spark, docs, bench, window, max_set)
    each = found.select("row", "doc_id", "n_words", "n_hit", F.explode_outer(F.array_distinct(F.transform("hits", lambda h: h["gram"]))).alias("gram"))
    names = grams.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    named = each.join(F.broadcast(names) if names.limit(max_set + 1).count() <= max_set else names, "gram", "left")
    grouped = named.groupBy("row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return grouped.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """The clean documents with all their columns, without a shuffle for a set that travels."""
    found, _ = scan(spark, docs, bench, window, max_set, keep=tuple(docs.columns))
    kept: list[T.StructField] = docs.schema.fields
    return found.where("n_hit = 0 and row >= 0").select(*[F.col(f"kept_{i}").alias(f.name) for i, f in enumerate(kept)])


def cut_contaminated(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """docs with all columns and rows; hit words go out of text, each with the separators before it, and n_chars counts what is left."""
    found, _ = scan(spark, docs, bench, window, max_set, keep=tuple(docs.columns))
    name = {f.name: F.col(f"kept_{i}") for i, f in enumerate(docs.schema.fields)}
    pieces = F.regexp_extract_all(name["text"], F.lit(RAW_SEPARATORS + RAW_WORD), F.lit(0))
    free = F.filter(pieces, lambda _, i: ~F.exists("hits", lambda h: (h["start"] <= i + 1) & (i + 1 < h["end"])))
    text = F.concat(F.array_join(free, ""), F.regexp_extract(name["text"], RAW_SEPARATORS + r"\z", 0))
    hit = F.col("n_hit") > 0
    name["text"] = F.when(hit, text).otherwise(name["text"])
    if "n_chars" in name:
        name["n_chars"] = F.when(hit, F.length(text)).otherwise(name["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.where("row >= 0").select(*[name[f.name].alias(f.name) for f in docs.schema.fields])
