"""The two substring operators and their parts against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybar.llm import fm_dedup, radix_dedup, repeats
from tests.llm.helpers import ODD, corpus, table


def bytes_by_loop(texts, window):
    seen = defaultdict(int)
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] += 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[1 + i : 1 + i + window] = True
        kept = bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def words_by_loop(texts, ids, window):
    first = {}
    words = [(t or "").encode().split() for t in texts]
    for d, w in zip(ids, words, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in zip(ids, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


TEXTS = [*ODD[:6], "word " * 3_000, "word " * 2_000, "ab" * 600, "ab" * 500 + "c", *corpus(11, 90, vocabulary=80)]


@pytest.mark.parametrize(("window", "hot"), [(400, 20_000), (60, 20_000), (100, 3), (400, 2)])
def test_radix_dedup_against_brute_force(spark, window, hot):
    got = {r["doc_id"]: tuple(r)[1:] for r in radix_dedup.report(spark, table(spark, TEXTS), window, hot).collect()}
    assert [got[i] for i in range(len(TEXTS))] == bytes_by_loop(TEXTS, window)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_fm_dedup_against_brute_force(spark, hot):
    ids = [(7 * i) % len(TEXTS) for i in range(len(TEXTS))]
    got = {r["doc_id"]: tuple(r)[1:] for r in fm_dedup.report(spark, table(spark, TEXTS, ids=ids), hot=hot).collect()}
    assert [got[i] for i in ids] == words_by_loop(TEXTS, ids, 13)


def test_radix_passes_by_blocks(monkeypatch):
    raw = [b"abcabcabcabcabc", b"xabcabcabcabc", b"abcabcabd", b"abcabcabd"]
    column = lambda *x: np.array(x, np.int64)
    work = repeats.Contexts(column(1, 1, 1, 1), column(0, 1, 2, 3), column(1, 1, 1, 1), column(0, 1, 2, 3), column(2, 2, 2, 2), column(*[len(r) - 5 for r in raw]), np.array(raw, object))
    as_lists = lambda found: (found[0].tolist(), [r.tolist() for r in found[1]])
    whole = as_lists(radix_dedup.repeated_windows(work, 6))
    monkeypatch.setattr(radix_dedup, "WINDOWS", 3)
    assert as_lists(radix_dedup.repeated_windows(work, 6)) == whole
    assert whole[0] and all(len(r) % 2 == 0 for r in whole[1])


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_groups_over_many_batches(spark, monkeypatch, batch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    texts = corpus(13, 60, vocabulary=30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = fm_dedup.report(spark, table(spark, texts)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r)[1:] for r in sorted(rows)] == words_by_loop(texts, range(len(texts)), 13)


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    codes, _ = repeats.byte_codes("abcdefgh" * 40)
    starts = [(at + f, at + e) for a, _, at in repeats.anchors_of(codes, 20, 5) for f, e in zip(a.first, a.last, strict=True)]
    assert [s for f, e in starts for s in range(f, e + 1)] == list(range(len(codes) - 19))


def test_repeated_rows_null_ids_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(150))
    docs = table(spark, [text, text, text, None, "x"], ids=[1, 1, None, None, 2])
    assert sorted(r["n_removed"] for r in radix_dedup.report(spark, docs).collect()) == [0, 0, *[len(text)] * 3]
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in fm_dedup.report(spark, docs).collect()) == [(-1, 0), (-1, 150), (1, 0), (1, 0), (2, 0)]
    for op in (radix_dedup, fm_dedup):
        assert op.report(spark, docs.limit(0)).count() == 0


def test_without_repeats_keeps_columns(spark):
    shared = "é" * 250
    docs = table(spark, [f"one {shared} tail", f"two {shared}", None, "short"])
    cut = {r["doc_id"]: r for r in radix_dedup.without_repeats(spark, docs).collect()}
    # the blanks beside the shared part repeat as well: one before it, and none behind it in the second text
    assert [cut[i]["text"] for i in range(4)] == ["one tail", "two", None, "short"]
    assert radix_dedup.without_repeats(spark, docs).columns == docs.columns
    assert cut[1]["n_chars"] == len(cut[1]["text"]) and cut[3]["keep"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=12), st.integers(2, 4))
def test_fm_index_counts(texts, window):
    flat = np.array([x for t in texts for x in [*t, 0]], np.int64)
    index = fm_dedup.FMIndex(flat, 5)
    starts = [i for i in range(len(flat) - window + 1) if 0 not in flat[i : i + window]]
    grams = [tuple(flat[i : i + window]) for i in starts]
    found, low, high = index.intervals(flat, np.array(starts, np.int64), window)
    assert sorted(found.tolist()) == [i for i, g in enumerate(grams) if grams.count(g) > 1]
    for i, a, b in zip(found, low, high, strict=True):
        assert {tuple(flat[s : s + window]) for s in index.order[a:b]} == {grams[i]} and b - a == grams.count(grams[i])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(max_size=30)), min_size=1, max_size=25), st.integers(1, 24), st.booleans())
def test_radix_order(strings, depth, forward):
    """Order and shared bytes of strings within their group, against sorting them."""
    alphabet = [(g, bytes(b % 3 + 97 for b in s)) for g, s in strings]
    raw = np.frombuffer(b"\0" * 8 + b"".join(s if forward else s[::-1] for _, s in alphabet) + b"\0" * 8, np.uint8)
    size = np.array([len(s) for _, s in alphabet])
    place = np.cumsum(size) - size if forward else np.cumsum(size)
    order, shared = radix_dedup.ordered(np.array([g for g, _ in alphabet]), raw, place, size, depth, forward)
    cut = [(g, s[:depth].ljust(depth, b"\0")) for g, s in alphabet]
    assert [cut[i] for i in order] == sorted(cut)
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        same = next((i for i in range(depth) if cut[a][1][i] != cut[b][1][i]), depth) if cut[a][0] == cut[b][0] else -1
        assert n == same


def test_hot_slices_go_alone(spark):
    """A passage of many texts: its slices merge, and the one over its end is cut into windows."""
    passage = " ".join(f"p{i}" for i in range(160))
    texts = [f"{chr(97 + i) * 9} lead {i * 7919} {passage} tail {i * 104729} {chr(97 + i) * 5}" for i in range(24)]
    got = {r["doc_id"]: tuple(r)[1:] for r in radix_dedup.report(spark, table(spark, texts), 400, 5).collect()}
    assert [got[i] for i in range(len(texts))] == bytes_by_loop(texts, 400)
    got = {r["doc_id"]: tuple(r)[1:] for r in fm_dedup.report(spark, table(spark, texts), hot=5).collect()}
    assert [got[i] for i in range(len(texts))] == words_by_loop(texts, range(len(texts)), 13)


def test_clashing_names_of_helper_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 250 + " a", 7), (2, "é" * 250 + " b", 8)], "doc_id long, text string, tb_spans int")
    assert sorted((r["tb_spans"], r["text"]) for r in radix_dedup.without_repeats(spark, docs).collect()) == [(7, "a"), (8, "b")]
