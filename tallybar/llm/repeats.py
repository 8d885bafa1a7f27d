"""Where windows of tokens repeat in a corpus: what the two substring operators share.

Of the k-grams in a window the one with the smallest hash (the leftmost of equals) is its anchor, so equal windows have
equal anchors at equal places. A text is thereby cut into contexts: an anchor with the windows that it stands for.

1. Keys (hashes of the anchors' k-grams) are counted over all documents, pre-aggregated by Spark.
2. Keys that occur twice or more go into a bitmap of bounded size; all others stand for unique windows.
3. A second pass takes, once in some documents for each distinct context in the bitmap, its content with count and
   smallest document; copies are thus merged before the shuffle. Contexts are dealt by key, and a resolver (a radix sort
   or an FM-index) decides every window of them exactly.
4. A third pass gives a member row for each distinct context in the bitmap of each document, with all its places there, so
   that a line that a document repeats is shuffled once. Verdicts are joined to the members and gathered by document, and
   the documents concerned meet their intervals.

A key with more than HOT occurrences does not gather in one task: its contexts are cut into slices of a few windows, dealt
by the hash of what these windows have in common. Slices within a common passage are alike and merge; one that reaches
over its end differs from text to text, and where a slice's key has more than HOT distinct contexts, its windows go alone,
under two hashes of their own, with counts and the smallest document only. So what a task holds of one key is bounded: up to
HOT contexts, or one window, whose rows are merged as they stream in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybar.llm.common import by_row, discard, materialize

SEGMENT = 1 << 18
#: Bits of a bitmap: 16 or more for each entry, within these bounds (128 MB at most). A fuller one holds more than it should,
#: which costs shuffles and changes no result.
MAP_BITS = (1 << 16, 1 << 30)
#: A key is hot beyond this many occurrences.
HOT = 20_000
#: Contexts that a resolver works on at a time, about.
BATCH = 1_024
LAST = 2**63 - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of a rolling hash's base and of its inverse, as far as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(n, self.base), _powers(n, pow(self.base, -1, 1 << 64))
        return self.up, self.down


#: The second base is for windows that go alone.
POWERS, OTHER = Powers(0xD1342543DE82EF95), Powers(0x9FB21C651E98DF25)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(codes: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    up, _ = powers.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of the spans [start, end) of the codes behind the sums; equal spans have equal hashes wherever they lie."""
    return mixed(((sums[end] - sums[start]) * powers.upto(len(sums))[1][start]) ^ ((end - start).astype(np.uint64) * _ODD))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size, m = len(x) - width + 1, 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[width - size : width - size + n])


@dataclass
class Anchors:
    """Columns by anchor: its key, the hash of its context, first and last window start, and its own place."""

    key: np.ndarray
    ctx: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray

    def part(self, at: np.ndarray) -> Anchors:
        return Anchors(*[getattr(self, f.name)[at] for f in fields(self)])


def anchors_of(codes: np.ndarray, window: int, gram: int) -> Iterator[tuple[Anchors, np.ndarray, int]]:
    """Anchors of a text of 64-bit codes with the codes and the offset of their segment; places count from there."""
    for at in range(0, len(codes) - window + 1, SEGMENT):
        part = codes[at : at + SEGMENT + window - 1]
        sums = prefix_sums(part)
        _, down = POWERS.upto(len(sums))
        keys = mixed((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
        bits = np.uint64(20)
        packed = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
        least = sliding_min(packed, window - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        place = (least[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
        ctx = mixed(span_hash(sums, first, last + window) ^ ((place - first).astype(np.uint64) * _ODD))
        yield Anchors(keys[place], ctx, first, last, place), part, at


class Bitmap:
    """A set of longs that may hold more than it was given; its size is bounded whatever their number."""

    def __init__(self, entries: DataFrame, name: str, bounds: tuple[int, int] = MAP_BITS):
        self.entries = count = entries.count()
        self.bits = min(bounds[1], max(bounds[0], 1 << (16 * count - 1).bit_length() if count else 0))
        slot = F.pmod(F.col(name), F.lit(self.bits))
        words = entries.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("b"))

        def block(rows: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(1024, np.int64)
            out[rows["w"].to_numpy(np.int64) & 1023] = rows["b"].to_numpy(np.int64)
            return pd.DataFrame({"at": [int(rows["w"].iat[0]) >> 10], "words": [out.tobytes()]})

        packed = np.zeros(max(self.bits // 64, 1024), np.int64)
        for row in words.groupBy(F.shiftright("w", 10)).applyInPandas(block, "at int, words binary").collect():  # blocks of 8 KB, bits / 8 bytes in all
            packed[row["at"] << 10 : (row["at"] + 1) << 10] = np.frombuffer(row["words"], np.int64)
        self.words = packed.view(np.uint64)

    def holds(self, values: np.ndarray) -> np.ndarray:
        slot = values.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


@dataclass(frozen=True)
class Tokens:
    """How a text becomes codes, and the content of a span of them; content of adjacent tokens is what a resolver reads."""

    codes: Callable[[str | None], tuple[np.ndarray, object]]
    content: Callable[[object, int, int], bytes]
    window: int
    gram: int
    #: Windows of a slice; with one, all windows of hot keys go alone.
    slice: int
    #: How many times BATCH contexts a resolver takes at a time.
    batches: int = 1
    #: Documents whose contexts are merged before they are written.
    documents: int = 4_000


@dataclass(frozen=True)
class Hot:
    """Keys whose contexts are cut into slices, and keys of slices whose windows go alone."""

    keys: Bitmap
    slices: Bitmap


MEMBER = "key long, ctx long, doc long, thash long, firsts array<long>"
CONTEXT = "key long, ctx long, n long, doc long, off int, m int, content binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null ids last), thash and text: what names a row; equal rows are treated alike."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("thash"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_keys(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """Keys that occur at least twice, with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [a.key for text in batch["text"] for a, _, _ in anchors_of(tokens.codes(text)[0], tokens.window, tokens.gram)]
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"key": key.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _sliced(a: Anchors, codes: np.ndarray, tokens: Tokens) -> Anchors:
    """Anchors cut by blocks of offsets; a slice's key is the hash of what all windows of its block share."""
    window, width = tokens.window, tokens.slice
    least, most = (a.place - a.last) // width, (a.place - a.first) // width
    count = most - least + 1
    owner = np.repeat(np.arange(len(a.key)), count)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + least[owner]
    place = a.place[owner]
    first, last = np.maximum(a.first[owner], place - (block + 1) * width + 1), np.minimum(a.last[owner], place - block * width)
    sums = prefix_sums(codes)
    core = span_hash(sums, place - block * width, place - (block + 1) * width + 1 + window)
    key = mixed(core ^ mixed(a.key[owner] ^ (block.astype(np.uint64) * _ODD)))
    return Anchors(key, mixed(span_hash(sums, first, last + window) ^ ((place - first).astype(np.uint64) * _ODD)), first, last, place)


def _alone(a: Anchors, codes: np.ndarray, window: int) -> Anchors:
    """Anchors as single windows, each under two hashes of its own."""
    count = a.last - a.first + 1
    owner = np.repeat(np.arange(len(a.key)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + a.first[owner]
    key = mixed(span_hash(prefix_sums(codes), start, start + window) ^ _ODD)
    return Anchors(key, span_hash(prefix_sums(codes, OTHER), start, start + window, OTHER), start, start, a.place[owner])


def _dealt(a: Anchors, codes: np.ndarray, tokens: Tokens, hot: Hot) -> tuple[Anchors, np.ndarray]:
    """Anchors, those of hot keys cut up, and which of them are windows that go alone."""
    held = hot.keys.holds(a.key)
    if not held.any():
        return a, np.zeros(len(a.key), bool)
    cut = _sliced(a.part(held), codes, tokens) if tokens.slice > 1 else a.part(held)
    apart = hot.slices.holds(cut.key) if tokens.slice > 1 else np.ones(len(cut.key), bool)
    single = _alone(cut.part(apart), codes, tokens.window)
    every = [a.part(~held), cut.part(~apart), single]
    return Anchors(*[np.concatenate([getattr(x, f.name) for x in every]) for f in fields(Anchors)]), np.repeat([False, False, True], [len(x.key) for x in every])


def _gathered(batches: Iterator[pd.DataFrame], documents: int) -> Iterator[pd.DataFrame]:
    """Small batches put together."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= documents:
            yield pd.concat(held)
            held, rows = [], 0
    if rows:
        yield pd.concat(held)


def _batches(batches: Iterator[pd.DataFrame], tokens: Tokens, bitmap: Bitmap, hot: Hot) -> Iterator[tuple[pd.DataFrame, list, np.ndarray, Anchors, np.ndarray]]:
    """(documents, sources of their content, document by anchor, anchors in the bitmap, which are alone), some documents at a time."""
    for whole in _gathered(batches, tokens.documents):
        for i in range(0, len(whole), tokens.documents):
            batch = whole.iloc[i : i + tokens.documents]
            parts, owner, sources = [], [], []
            for text in batch["text"]:
                codes, source = tokens.codes(text)
                for a, part, at in anchors_of(codes, tokens.window, tokens.gram):
                    held = bitmap.holds(a.key)
                    if held.any():
                        a, alone = _dealt(a.part(held), part, tokens, hot)
                        parts.append((a.key, a.ctx, a.first + at, a.last + at, a.place + at, alone))
                        owner.append(len(sources))
                sources.append(source)
            if parts:
                *own, alone = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield batch, sources, np.repeat(owner, [len(p[0]) for p in parts]), Anchors(*own), alone


def hot_slices(docs: DataFrame, tokens: Tokens, hot_keys: Bitmap, hot: int) -> DataFrame:
    """Keys of slices of hot keys that have more than `hot` distinct contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                for a, part, _ in anchors_of(tokens.codes(text)[0], tokens.window, tokens.gram):
                    held = hot_keys.holds(a.key)
                    if held.any():
                        cut = _sliced(a.part(held), part, tokens)
                        found.append(np.stack([cut.key, cut.ctx], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
                yield pd.DataFrame({"key": pairs[:, 0], "ctx": pairs[:, 1]})

    return docs.select("text").mapInPandas(run, "key long, ctx long").distinct().groupBy("key").count().where(F.col("count") > hot).select("key")


def members(docs: DataFrame, tokens: Tokens, bitmap: Bitmap, hot: Hot) -> DataFrame:
    """A row for each distinct context in the bitmap of each document: the first window starts of all its occurrences there."""
    target = to_arrow_schema(T.StructType.fromDDL(MEMBER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, owner, a, _ in _batches((b.to_pandas() for b in batches), tokens, bitmap, hot):
            order = np.lexsort((a.ctx, owner))
            key, ctx, own = a.key[order], a.ctx[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (ctx[1:] != ctx[:-1]) | (key[1:] != key[:-1])]))
            firsts = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array(a.first[order].astype(np.int64)))
            doc, thash = (batch[c].to_numpy(np.int64)[own[new]] for c in ("doc", "thash"))
            numbers = [pa.array(x) for x in (key[new].view(np.int64), ctx[new].view(np.int64), doc, thash)]
            yield pa.RecordBatch.from_arrays([*numbers, firsts.cast(target.field("firsts").type)], schema=target)

    return _keyed(docs).mapInArrow(run, MEMBER)


def contexts(docs: DataFrame, tokens: Tokens, bitmap: Bitmap, hot: Hot) -> DataFrame:
    """Once in some documents, each distinct context with its occurrences in them, smallest document and content.

    A window that is alone has no content: its two hashes name it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, sources, owner, a, alone in _batches(batches, tokens, bitmap, hot):
            doc = batch["doc"].to_numpy(np.int64)[owner]
            order = np.lexsort((doc, a.ctx, a.key))  # of equal contexts the one of the smallest document comes first
            new = np.ones(len(order), bool)
            new[1:] = (a.key[order][1:] != a.key[order][:-1]) | (a.ctx[order][1:] != a.ctx[order][:-1])
            one = order[new]
            first, last = a.first[one], a.last[one]
            yield pd.DataFrame({
                "key": a.key[one].view(np.int64), "ctx": a.ctx[one].view(np.int64), "n": np.diff(np.append(np.flatnonzero(new), len(order))), "doc": doc[one],
                "off": (a.place[one] - first).astype(np.int32), "m": (last - first + 1).astype(np.int32),
                "content": [b"" if x else tokens.content(sources[o], f, e) for o, f, e, x in zip(owner[one].tolist(), first.tolist(), (last + tokens.window).tolist(), alone[one].tolist(), strict=True)],
            })

    return _keyed(docs).mapInPandas(run, CONTEXT)


@dataclass
class Contexts:
    """Distinct contexts, a column each: occurrences, smallest document, place of the anchor, windows, content."""

    key: np.ndarray
    ctx: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    off: np.ndarray
    m: np.ndarray
    content: np.ndarray

    def __len__(self) -> int:
        return len(self.key)

    def part(self, at) -> Contexts:
        return Contexts(*[x[at] for x in (self.key, self.ctx, self.n, self.doc, self.off, self.m, self.content)])

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Contexts:
        """Rows in order of (key, ctx) as contexts, equal ones merged."""
        numbers = [rows[c].to_numpy(np.int64) for c in ("key", "ctx", "n", "doc", "off", "m")]
        return cls(*numbers, rows["content"].to_numpy()).merged()

    def merged(self) -> Contexts:
        new = np.flatnonzero(np.concatenate([[True], (self.key[1:] != self.key[:-1]) | (self.ctx[1:] != self.ctx[:-1])]))
        once = self.part(new)
        once.n, once.doc = np.add.reduceat(self.n, new), np.minimum.reduceat(self.doc, new)
        return once

    def with_more(self, more: Contexts) -> Contexts:
        """These and those that come after them in order."""
        return Contexts(*[np.concatenate([getattr(self, c.name), getattr(more, c.name)]) for c in fields(Contexts)]).merged()


def resolved(rows: DataFrame, resolve: Callable[[Contexts], tuple[np.ndarray, list]], partitions: int, width: int, batch_size: int) -> DataFrame:
    """(key, ctx, runs) of the contexts for which `resolve`, given whole groups of equal keys, returns runs of `width` numbers.

    A window that is alone needs no resolver: its run is its only window, with the smallest document, if it occurs again.
    """

    def verdicts(work: Contexts) -> Iterator[pd.DataFrame]:
        alone = np.fromiter((not c for c in work.content), bool, len(work))
        if alone.any():
            again = work.part(alone & (work.n > 1))
            if len(again):
                runs = np.stack([0 * again.n, 0 * again.n, again.doc], axis=1)[:, :width]
                yield pd.DataFrame({"key": again.key, "ctx": again.ctx, "runs": list(runs)})
            work = work.part(~alone)
        if not len(work):
            return
        edge = np.flatnonzero(np.concatenate([[True], work.key[1:] != work.key[:-1]]))
        twice = np.add.reduceat(work.n, edge) > 1  # a key that the bitmap held by chance has one occurrence
        work = work.part(np.repeat(twice, np.diff(np.append(edge, len(work)))))
        if not len(work):
            return
        edge = np.flatnonzero(np.concatenate([[True], work.key[1:] != work.key[:-1]]))
        begin = 0
        while begin < len(edge):  # groups of about batch_size contexts together
            end = max(int(np.searchsorted(edge, edge[begin] + batch_size, side="right")) - 1, begin + 1)
            low, high = edge[begin], edge[end] if end < len(edge) else len(work)
            some = work.part(slice(low, high))
            told, runs = resolve(some)
            if len(told):
                yield pd.DataFrame({"key": some.key[told], "ctx": some.ctx[told], "runs": runs})
            begin = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Contexts | None = None  # of the last keys, which are resolved once there are enough and the next key begins
        for batch in batches:
            if not len(batch):
                continue
            held = Contexts.of(batch) if held is None else held.with_more(Contexts.of(batch))
            cut = int(np.searchsorted(held.key, held.key[-1]))
            if cut >= batch_size:
                yield from verdicts(held.part(slice(0, cut)))
                held = held.part(slice(cut, None))
        if held is not None:
            yield from verdicts(held)

    dealt = rows.repartition(partitions, "key").sortWithinPartitions("key", "ctx")
    return dealt.mapInPandas(run, "key long, ctx long, runs array<long>")


def unflatten(runs: Column, names: tuple[str, ...]) -> Column:
    """An array of structs from a flat array of numbers."""
    width = len(names)
    at = F.sequence(F.lit(0), F.floor(F.size(runs) / width).cast("int") - 1)
    return F.transform(at, lambda i: F.struct(*[F.get(runs, i * width + k).alias(name) for k, name in enumerate(names)]))


def covered(spark: SparkSession, docs: DataFrame, tokens: Tokens, resolve: Callable, names: tuple[str, ...], spans: Callable, hot: int = HOT) -> tuple[DataFrame, Bitmap]:
    """(doc, thash, spans) of the documents with covered tokens, and a bitmap of their thash.

    names: of the numbers of a run; spans: makes an array of (start, end) from runs, doc and first.
    """
    keys = materialize(spark, repeated_keys(docs, tokens), "repeated-keys")
    bitmap, hot_keys = Bitmap(keys, "key"), Bitmap(keys.where(F.col("n") > hot), "key")
    slices = Bitmap(materialize(spark, hot_slices(docs, tokens, hot_keys, hot), "hot-slices"), "key") if hot_keys.entries and tokens.slice > 1 else hot_keys
    discard(spark, keys)
    cut = Hot(hot_keys, slices)
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    verdicts = resolved(contexts(docs, tokens, bitmap, cut), resolve, partitions, len(names), tokens.batches * BATCH)
    found = members(docs, tokens, bitmap, cut).join(verdicts, ["key", "ctx"])
    everywhere = F.flatten(F.transform("firsts", lambda first: spans(unflatten(F.col("runs"), names), F.col("doc"), first)))
    each = found.select("doc", "thash", everywhere.alias("spans")).where(F.size("spans") > 0)
    # a set, so that equal rows, of which there may be any number, have their spans once
    gathered = each.groupBy("doc", "thash").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    gathered = materialize(spark, gathered, "covered")
    return gathered, Bitmap(gathered.select("thash"), "thash")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer where docs have such columns."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def split_by_spans(docs: DataFrame, gathered: DataFrame, bitmap: Bitmap) -> tuple[DataFrame, DataFrame, str]:
    """(docs that have no spans, the others with theirs, the name of that column). Only texts that the bitmap holds are moved to meet theirs."""

    @F.pandas_udf("boolean")
    def held(thash: pd.Series) -> pd.Series:
        return pd.Series(bitmap.holds(thash.to_numpy(np.int64)))

    doc, text, spans = free_names(docs, "tb_doc", "tb_thash", "tb_spans")
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(*own, F.coalesce(F.col("doc_id"), F.lit(LAST)).alias(doc), F.xxhash64(F.coalesce("text", F.lit(""))).alias(text))
    found = gathered.select(F.col("doc").alias(doc), F.col("thash").alias(text), F.col("spans").alias(spans))
    met = named.where(held(text)).join(found, [doc, text], "left").select(*own, spans)
    return named.where(~held(text)).select(*own), met, spans


def finished(docs: DataFrame, gathered: DataFrame, bitmap: Bitmap, finish: Callable[[list, list], dict], schema: str) -> DataFrame:
    """`finish` of the texts and spans of all rows of docs (doc_id, text); rows without spans are done where they are read."""
    free, met, spans = split_by_spans(docs, gathered, bitmap)  # what is returned is written first, in small batches of texts
    done = by_row(free.select("doc_id", "text"), lambda texts: finish(texts, [None] * len(texts)), schema)
    return materialize(docs.sparkSession, done.unionByName(by_row(met.select("doc_id", "text", spans), finish, schema)), "finished")


def merged(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of (start, end)."""
    out: list[list[int]] = []
    for start, end in sorted((int(s["start"]), int(s["end"])) for s in spans if s is not None):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, min(b, size)) for a, b in out]



_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def byte_codes(text: str | None) -> tuple[np.ndarray, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return _BYTE_CODES[np.frombuffer(raw, np.uint8)], raw


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of a text that are cut into words at a time, about.
PIECE = 1 << 20


def _pieces(raw: bytes) -> Iterator[bytes]:
    """The text in pieces that end where a word does."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def word_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each word, and its lower half for contents."""
    out = [np.empty(0, np.uint64)]
    for raw in _pieces((text or "").encode("utf-8", "replace")):
        octets = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[octets], prepend=True, append=True))
        out.append(span_hash(prefix_sums(_BYTE_CODES[octets]), edge[::2], edge[1::2]))
    codes = np.concatenate(out)
    return codes, codes.astype(np.uint32)
