"""Substring dedup with one compressed FM-index per shard.

A shard is an FM-index over the words (32 bits of their hash) of about a thousand contexts: a suffix array by prefix doubling, its Burrows-Wheeler
transform, and a wavelet matrix over it whose levels are packed bits with counted blocks. The contexts' windows are
streamed through it by backward search, all of a shard in step. This gives the matching statistics through the threshold: how
long a match ends at each place, and the interval of its occurrences. Windows whose statistic reaches the threshold are
the repeated ones, and the smallest document in the interval decides. A word is removed if a window over it starts in a
document with a smaller doc_id, judged on the input. Shards are dealt by anchors of windows, so a document's windows are
streamed through the shards that can hold them and through no others.

Defined results: a null text has no words; texts with fewer words than the window stay as they are; a null doc_id comes
after all others; rows with one doc_id are no smaller than each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybar.llm import repeats
from tallybar.llm.common import columns

WINDOW, GRAM, SLICE = 13, 4, 1


def _content(words: np.ndarray, start: int, end: int) -> bytes:
    return words[start:end].tobytes()


def tokens(window: int = WINDOW) -> repeats.Tokens:
    return repeats.Tokens(repeats.word_codes, _content, window, min(GRAM, window), SLICE)


class WaveletMatrix:
    """rank of a symbol before places, with a bit for each symbol and level, in words of 64 with a count for each."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.bits.append(words)
            self.ranks.append(counts)
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.starts = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[i][word] + np.bitwise_count(self.bits[i][word] & below)
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.starts[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text whose symbols of rank below the others (separators) are all different."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair)
        sorted_pairs = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_pairs[1:] != sorted_pairs[:-1]]))
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Over texts of symbols 1..sigma - 1, each ended by the separator 0."""

    def __init__(self, texts: np.ndarray, sigma: int):
        ends = texts == 0
        distinct = texts + ends.sum()
        distinct[ends] = np.arange(ends.sum())  # each end is a symbol of its own, in order
        self.order = suffix_array(distinct)
        bwt = texts[self.order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=sigma))])
        self.wavelet = WaveletMatrix(bwt, sigma)

    def matching_statistics(self, texts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end, the length, through `depth`, of the longest string before it that occurs twice or more, and its interval.

        All are streamed in step by backward search; one leaves when its interval holds nothing but itself.
        """
        symbol = texts[ends - 1]
        low, high = self.before[symbol], self.before[symbol + 1]
        length, alive = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for back in range(1, depth + 1):
            more = high[alive] - low[alive] > 1 if back == 1 else after[1] - after[0] > 1
            alive = alive[more]
            if back > 1:
                low[alive], high[alive] = after[0][more], after[1][more]
            length[alive] = back
            if back == depth or not len(alive):
                break
            symbol = texts[ends[alive] - 1 - back]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]])) + np.tile(self.before[symbol], 2)
            after = both[: len(alive)], both[len(alive) :]
        return length, low, high

    def intervals(self, texts: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows at these starts whose matching statistic reaches the window's length, and their intervals."""
        length, low, high = self.matching_statistics(texts, starts + window, window)
        found = np.flatnonzero(length >= window)
        return found, low[found], high[found]


def earliest_documents(work: repeats.Contexts, window: int) -> tuple[np.ndarray, list]:
    """(contexts, their runs of windows: first, last, smallest document that has them, ...)."""
    vocabulary, symbols = np.unique(np.frombuffer(b"".join(work.content), np.uint32), return_inverse=True)
    ends = np.cumsum(np.array([len(c) // 4 + 1 for c in work.content], np.int64)) - 1
    texts = np.zeros(ends[-1] + 1, np.int64)
    inside = np.ones(len(texts), bool)
    inside[ends] = False
    texts[inside] = symbols + 1
    base = np.concatenate([[0], ends[:-1] + 1])
    begin = np.cumsum(work.m) - work.m
    owner = np.repeat(np.arange(len(work)), work.m)
    place = np.arange(len(owner)) - begin[owner]
    index = FMIndex(texts, len(vocabulary) + 1)
    earliest = work.doc[owner]
    found, low, high = index.intervals(texts, base[owner] + place, window)
    if len(found):
        document = np.append(work.doc[np.searchsorted(ends, index.order)], repeats.LAST)
        bounds, which = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        least = np.minimum.reduceat(document, bounds.T.ravel())[::2]
        earliest[found] = least[which.ravel()]
    at = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (earliest[1:] != earliest[:-1])]))
    last = np.concatenate([at[1:], [len(owner)]]) - 1
    runs = np.stack([place[at], place[last], earliest[at]], axis=1)
    each = np.split(runs, np.searchsorted(owner[at], np.arange(1, len(work))))
    told = np.flatnonzero((work.n > 1) | (np.minimum.reduceat(earliest, begin) < work.doc))
    return told, [each[i].ravel() for i in told]


def covered(spark: SparkSession, docs: DataFrame, window: int = WINDOW, hot: int = repeats.HOT) -> tuple[DataFrame, repeats.Bitmap]:
    def spans(runs: Column, doc: Column, first: Column) -> Column:
        earlier = F.filter(runs, lambda r: r["e"] < doc)
        return F.transform(earlier, lambda r: F.struct((first + r["a"]).alias("start"), (first + r["b"] + window).alias("end")))

    return repeats.covered(spark, docs, tokens(window), partial(earliest_documents, window=window), ("a", "b", "e"), spans, hot)


def kept_words(text: str | None, spans: list | None) -> tuple[bytes, int, int]:
    """What is left of the words, joined by a space, with how many there were and how many are gone."""
    words = (text or "").encode("utf-8", "replace").split()
    runs = repeats.merged(spans, len(words)) if spans is not None and len(spans) else []
    kept, at = [], 0
    for a, b in runs:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return b" ".join(kept), len(words), len(words) - len(kept)


def report(spark: SparkSession, docs: DataFrame, window: int = WINDOW, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    rows = columns(docs, doc_id="long", text="string")

    def finish(texts: list, spans: list) -> dict:
        made = [kept_words(t, s) for t, s in zip(texts, spans, strict=True)]
        return {"n_words": [n for _, n, _ in made], "n_removed": [r for _, _, r in made], "kept_sha256": [hashlib.sha256(k).hexdigest() for k, _, _ in made]}

    return repeats.finished(rows, *covered(spark, rows, window, hot), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
