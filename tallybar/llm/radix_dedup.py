"""Suffix-array dedup by a depth-limited radix sort over bytes.

A window repeats only where its anchor does, the k-gram in it with the smallest hash; anchors deal the suffixes to tasks.
There the suffixes that begin at anchors are ordered through `window` bytes by passes from the most significant digit on,
a digit being eight bytes of the text; after each pass those that are alone in their group leave. What lies before the
anchors is ordered in the same way, read backwards. Two windows with one offset from their anchor are equal if they are
in one group of both orders, that of the bytes behind the anchor and that of the bytes before it, each at its depth; groups of
two or more are the repeated windows, and every byte in one of them is removed, judged on the input. So all bytes of a
window are compared as such; only contexts that are alike as a whole, and windows that go alone, are told
by two hashes of 64 bits.

Defined results: a null or empty text has no bytes and keeps none; texts shorter than the window stay as they are;
repeated rows are copies of each other and lose all their windows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybar.llm import repeats
from tallybar.llm.common import columns

WINDOW, GRAM, SLICE = 400, 64, 32
#: Bytes of a digit.
DIGIT = 8
#: Windows that are grouped at a time, about, and how many times the usual number of contexts are ordered at a time.
WINDOWS, BATCHES = 300_000, 4
#: Documents whose contexts are merged at a time: a context has several hundred bytes.
DOCUMENTS = 2_000


def _content(raw: bytes, start: int, end: int) -> bytes:
    return raw[start:end]


def tokens(window: int = WINDOW) -> repeats.Tokens:
    return repeats.Tokens(repeats.byte_codes, _content, window, min(GRAM, window), SLICE, BATCHES, DOCUMENTS)


def digits(raw: np.ndarray, place: np.ndarray, left: np.ndarray, forward: bool) -> np.ndarray:
    """Eight bytes from each place on, or those before it read backwards, as numbers that are ordered like them.

    left: how many bytes there are; what lies beyond counts as zero. raw has eight bytes more at both ends.
    """
    views = np.lib.stride_tricks.sliding_window_view(raw, DIGIT)
    read = views[np.clip(place + DIGIT if forward else place, 0, len(views) - 1)]
    number = read.view(">u8" if forward else "<u8").ravel().astype(np.uint64)
    beyond = np.clip(DIGIT - left, 0, DIGIT).astype(np.uint64) * np.uint64(8)
    return np.where(beyond >= 64, np.uint64(0), number >> np.minimum(beyond, np.uint64(63)) << np.minimum(beyond, np.uint64(63)))


def ordered(group: np.ndarray, raw: np.ndarray, place: np.ndarray, length: np.ndarray, depth: int, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): strings in order within their group, and how many bytes each shares with the one before it, -1 at a group's start.

    The strings begin at their places, or end there and are read backwards, and count through `depth` bytes.
    """
    order = np.argsort(group, kind="stable")
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    shared = np.where(first, -1, depth)
    slot, at = np.arange(len(order)), 0  # where in the order those stand that are not alone yet
    while at < depth:
        start = first[slot]
        together = ~(start & np.concatenate([start[1:], [True]]))
        slot = slot[together]
        if not len(slot):
            break
        own = order[slot]
        digit = digits(raw, place[own] + at if forward else place[own] - at, length[own] - at, forward)
        ranked = np.lexsort((digit, np.cumsum(first[slot])))
        order[slot], digit = own[ranked], digit[ranked]
        differs = np.concatenate([[np.uint64(0)], digit[1:] ^ digit[:-1]])
        split = ~first[slot] & (differs > 0)
        same = sum((differs[split] < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
        shared[slot[split]] = np.minimum(at + same, depth)
        first[slot[split]] = True
        at += DIGIT
    return order, shared


def nearest(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """How many bytes each shares with any other of its group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], -1))
    return out


def repeated_windows(work: repeats.Contexts, window: int) -> tuple[np.ndarray, list]:
    """(contexts, their runs of windows that occur elsewhere: first, last, ...), by passes over digits.

    An offset is the number of bytes from a window's start to its anchor.
    """
    m, off, size = work.m, work.off, np.array([len(c) for c in work.content])
    raw = np.frombuffer(b"\0" * DIGIT + b"".join(work.content) + b"\0" * DIGIT, np.uint8)
    anchor = np.cumsum(size) - size + off
    least, most = int((off - m).min()) + 1, int(off.max())
    behind, shared_behind = ordered(work.key, raw, anchor, size - off, window - least, True)
    before, shared_before = ordered(work.key, raw, anchor, off, max(most, 0), False)
    reach_behind, reach_before = nearest(behind, shared_behind), nearest(before, shared_before)
    marked = np.zeros(m.sum() + 1, bool)
    begin = np.cumsum(m) - m
    copied = work.n > 1
    marked[:-1] = np.repeat(copied, m)  # a context that occurs again does so with all its windows
    low, high = np.maximum(off - m + 1, window - reach_behind), np.minimum(off, np.where(reach_before < 0, least - 1, np.maximum(reach_before, 0)))
    some = np.flatnonzero(low <= high)
    if len(some):
        width = max(1, WINDOWS // len(work))
        for o in range(int(low[some].min()), int(high[some].max()) + 1, width):
            offsets = np.arange(o, min(o + width, int(high[some].max()) + 1))
            classes = []
            for order, shared, depths in ((behind, shared_behind, window - offsets), (before, shared_before, np.maximum(offsets, 0))):
                own = np.empty((len(offsets), len(work)), np.int64)
                own[:, order] = np.cumsum(shared[None, :] < depths[:, None], axis=1)
                classes.append(own)
            row, which = np.nonzero((low[None, :] <= offsets[:, None]) & (offsets[:, None] <= high[None, :]))
            code = (row * (len(work) + 1) + classes[0][row, which]) * (len(work) + 1) + classes[1][row, which]
            _, number = np.unique(code, return_inverse=True)
            again = np.bincount(number, weights=work.n[which])[number] > 1
            marked[begin[which[again]] + off[which[again]] - offsets[row[again]]] = True
    owner = np.repeat(np.arange(len(work)), m)
    starts = np.concatenate([[True], owner[1:] != owner[:-1]])  # a run ends with its context
    on = marked[:-1]
    first = np.flatnonzero(on & (starts | ~np.concatenate([[False], on[:-1]])))
    last = np.flatnonzero(on & (np.concatenate([starts[1:], [True]]) | ~marked[1:]))
    runs = np.stack([first, last], axis=1) - begin[owner[first]][:, None]
    told, at = np.unique(owner[first], return_index=True)
    return told, [r.ravel() for r in np.split(runs, at[1:])]


def covered(spark: SparkSession, docs: DataFrame, window: int = WINDOW, hot: int = repeats.HOT) -> tuple[DataFrame, repeats.Bitmap]:
    def spans(runs: Column, doc: Column, first: Column) -> Column:
        return F.transform(runs, lambda r: F.struct((first + r["a"]).alias("start"), (first + r["b"] + window).alias("end")))

    return repeats.covered(spark, docs, tokens(window), partial(repeated_windows, window=window), ("a", "b"), spans, hot)


def kept_bytes(text: str | None, spans: list | None) -> tuple[bytes, int, int]:
    """What is left of the text's bytes, with how many bytes and runs are gone."""
    raw = (text or "").encode("utf-8", "replace")
    if spans is None or len(spans) == 0:
        return raw, 0, 0
    runs = repeats.merged(spans, len(raw))
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts), sum(b - a for a, b in runs), len(runs)


def report(spark: SparkSession, docs: DataFrame, window: int = WINDOW, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rows = columns(docs, doc_id="long", text="string")

    def finish(texts: list, spans: list) -> dict:
        made = [kept_bytes(t, s) for t, s in zip(texts, spans, strict=True)]
        return {"n_bytes": [len(k) + r for k, r, _ in made], "n_removed": [r for _, r, _ in made], "n_spans": [n for _, _, n in made], "kept_sha256": [hashlib.sha256(k).hexdigest() for k, _, _ in made]}

    return repeats.finished(rows, *covered(spark, rows, window, hot), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with all columns; repeated windows are cut out of text, and n_chars, if there, counts what is left.

    A character of which a part is cut goes as a whole; null texts stay null.
    """
    free, met, name = repeats.split_by_spans(docs, *covered(spark, columns(docs, doc_id="long", text="string"), window))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else kept_bytes(t, s)[0].decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)

    whole = F.col(name).isNull()
    done = met.withColumn("text", F.when(whole, F.col("text")).otherwise(cut("text", name)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return free.unionByName(done.select(*docs.columns))
