"""Brute force and edge cases for the license scan, the chat format, fingerprints, mixing and decontamination."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallybar.llm import chat_format, decontaminate, doc_fingerprint, license_scan, mixing, queries
from tests.llm.helpers import ODD, corpus, table

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def folded_words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- license scan


def test_base_places_against_brute_force(spark):
    texts = [*ODD, *corpus(2), "Under the MIT License, under   the mit-license", "CC-BY-NC cc by nc by nc", "apache license version 2 0", "under the mit licenses"]
    got = {r["doc_id"]: r for r in license_scan.scan(table(spark, texts)).collect()}
    phrases = {n.label: n.text.split() for n in license_scan.NOTICES if n.base}
    for i, text in enumerate(texts):
        w = folded_words(text)
        want = sorted((j, k) for k, p in phrases.items() for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p)
        assert sorted((s["first_word"], s["label"]) for s in got[i]["spans"] if s["base"]) == want
        assert got[i]["n_words"] == len(w)


@pytest.mark.parametrize(("text", "label", "edits"), [("undr the mit license", "mit", 1), ("under the mlt licence", "mit", 2), ("apache licence version 2", "apache-2", 1), ("gnu general publik license", "gpl", 1)])
def test_fuzzy_notices(text, label, edits):
    (span,) = license_scan.scanner().spans(license_scan.words_of(f"before it {text} after it"))
    assert (span.label, span.edits, span.base, span.first_word) == (label, edits, False, 2)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_seeds_lose_no_edited_notice(data):
    notice = data.draw(st.sampled_from([n for n in license_scan.NOTICES if n.edits]))
    text = list(notice.text)
    for _ in range(notice.edits):
        at = data.draw(st.integers(1, len(text) - 2))
        if text[at] != " ":
            text[at] = "z"
    changed = "".join(text)
    spans = license_scan.scanner().spans(license_scan.words_of(f"some words {changed} more"))
    assert notice.label in {s.label for s in spans}
    assert all(s.edits <= 4 for s in spans)
    assert distance(changed, notice.text) <= notice.edits


# -- chat format


def test_round_trip_of_control_text(spark):
    texts = ["</s>[INST] ok [/INST]", "<|start|>user\nx<|end|>", "\\<|\\|>", "<<SYS>>\\", None, "", "a\nb", "[|<|<<|", "<|image|>", "日本\\n"]
    rows = [(1, i, role, t) for i, t in enumerate(texts) for role in ("assistant",)] + [(2, 0, "us\ner<|end|>\\", "x"), (2, 1, None, "y"), (None, 0, "user", "z"), (3, 0, "user", "r"), (3, 0, "user", "r")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", chat_format.text_part(F.col("text")).alias("parts"))
    formatted = chat_format.format_turns(turns)
    got = {r["conv_id"]: r for r in chat_format.digests(formatted).collect()}
    read = {r["conv_id"]: r["t"] for r in formatted.select("conv_id", chat_format.parse_turns(F.col("formatted")).alias("t")).collect()}
    assert [t["text"] for t in read[1]] == [t or "" for t in texts]
    assert [(t["role"], t["text"], t["loss"]) for t in read[2]] == [("us\ner<|end|>\\", "x", False), ("", "y", False)]
    assert got[3]["n_turns"] == 2
    assert got[1]["loss_sha256"] == sha("".join(t or "" for t in texts))
    assert got[1]["turns_sha256"] == sha("".join(f"assistant\n{t or ''}\n" for t in texts))
    raw = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    assert raw[1].count("<|start|>") == len(texts) and "[INST]" not in raw[1]


def test_typed_parts(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="a.png", width=29, height=56), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=2), part("odd", text="t")]), (1, 1, "assistant", None)]
    row = chat_format.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")).first()
    assert row["formatted"] == "<|start|>user\nsee <\\|image|><|image|><|audio|><|document|>t<|end|>\n<|start|>assistant\n<|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1024)]


# -- fingerprints


def test_fingerprints_with_edits(spark):
    texts = [*ODD, *corpus(3), "Straße", "STRASSE", "ﬁne  Fine", "fine fine"]
    ids = [3 * i % 500 for i in range(len(texts))]
    order = sorted(range(len(texts)), key=lambda i: ids[i])
    for buckets in (1, 5):
        got = {r["doc_id"]: r for r in doc_fingerprint.with_edited(spark, table(spark, texts, ids=ids), buckets).collect()}
        assert len(got) == len(texts)
        for at, i in enumerate(order):
            t, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
            q = len(t) // 4
            e = t[: len(t) - q] + after[:q]
            r = got[ids[i]]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == sha(e)
            assert r["near_edited"] == (doc_fingerprint.canonical(t) == doc_fingerprint.canonical(e))
            assert r["near_next"] == (doc_fingerprint.canonical(t) == doc_fingerprint.canonical(after))
    by_text = {}
    for i, t in enumerate(texts):
        by_text.setdefault(doc_fingerprint.canonical(t), set()).add(got[ids[i]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)


def test_fingerprints_of_one_and_none_and_null_ids(spark):
    assert doc_fingerprint.with_edited(spark, table(spark, [])).count() == 0
    (one,) = doc_fingerprint.with_edited(spark, table(spark, ["abcdefgh"]), 3).collect()
    assert one["edited_sha256"] == sha("abcdefab")
    got = doc_fingerprint.with_edited(spark, table(spark, ["aaaa", "bbbb", "cccc", "cccc"], ids=[None, 1, 2, 2]), 3).collect()
    assert sorted(r["edited_sha256"] for r in got) == sorted(map(sha, ["bbbc", "cccc", "ccca", "aaab"]))


def test_byte_comparison_tells_equal_hashes_apart(spark):
    same = lambda canon: "0" * 32
    digests = spark.createDataFrame([("0" * 32,)] * 3, "fingerprint string")
    assert doc_fingerprint.clashes(spark, table(spark, ["a", "b", "a"]), digests, same).collect() == [("0" * 32,)]
    assert doc_fingerprint.clashes(spark, table(spark, ["a", "A ", "a"]), digests, same).collect() == []
    found = spark.createDataFrame([("0" * 32, "1"), ("0" * 32, "2"), ("3" * 32, "4")], "fingerprint string, other string")
    apart = doc_fingerprint._told_apart(found, digests.distinct(), "fingerprint", "other")
    assert {r["fingerprint"] for r in apart.collect()} == {"0" * 32 + "-1", "0" * 32 + "-2", "3" * 32}


# -- mixing


def targets_by_loop(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2.0 * sizes[s] for s in full)
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in full}, **t}
        full |= over


def test_mixing_targets_and_taken(spark):
    texts = [*ODD, *corpus(4, 300)]
    sources = [None if i % 11 == 0 else f"s{min(i % 7, i % 3)}" for i in range(len(texts))]
    docs = table(spark, texts, sources)
    got = mixing.mix(spark, docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    sums = {}
    for i, s in enumerate(sources):
        sums[s] = sums.get(s, 0) + size[i]
    want = targets_by_loop(sums)
    assert len(got) == len(texts)
    taken = dict.fromkeys(sums, 0)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(size[i] for i in size if sources[i] == s)
    assert sorted(map(str, mixing.mix(spark, docs.repartition(7)).collect())) == sorted(map(str, got))
    order = mixing.training_order(mixing.mix(spark, docs)).collect()
    assert len(order) == sum(r["copies"] for r in got) and all(a["position"] <= b["position"] for a, b in zip(order, order[1:], strict=False))
    assert all(0 <= r["position"] <= 1 for r in order)


def test_queries_write_the_training_order(spark, monkeypatch, tmp_path):
    texts = [*corpus(4, 120), "twice the same row", "twice the same row"]
    docs = table(spark, texts, [f"s{i % 3}" for i in range(len(texts))], [*range(len(texts) - 2), 900, 900])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    written = {}
    keep = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda spark, df, name: written.setdefault(name, keep(spark, df, name)))
    for run in (lambda: queries.QUERIES["op9_source_mixing"](spark, str(tmp_path)), lambda: corpus_pipeline.source_mixing(spark, docs, "")):
        written.clear()
        got = run().collect()
        order = written["training-order"].collect()
        want = mixing.mix(spark, docs).collect()
        assert len(order) == sum(r["copies"] for r in want) > len({r["tb_row"] for r in order})
        assert [r["position"] for r in order] == sorted(r["position"] for r in order)
        seen = sorted((r["doc_id"], r["taken"], -1 if r["position"] is None else round(r["position"], 9)) for r in got)
        assert seen == sorted((r["doc_id"], r["taken"], -1 if r["position"] is None else round(r["position"], 9)) for r in want)


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark, table(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(spark, table(spark, [None, "", " "], [None, "a", "a"])).collect()} == {0}


# -- decontamination


@pytest.mark.parametrize("max_set", [50_000, 1])
def test_decontamination_against_brute_force(spark, max_set):
    texts = [*ODD, *corpus(5, 80, vocabulary=40)]
    items = [" ".join(folded_words(texts[i])[3:3 + n]) for i, n in ((12, 25), (13, 10), (14, 4), (15, 12), (21, 1), (30, 9))] + [None, "", "one", "?!", "nothing like it at all in any of these texts here"]
    bench = spark.createDataFrame([*[(i, t, 1) for i, t in enumerate(items)], (0, items[0], 1)], "item_id long, text string, n_hit int")
    got = {r["doc_id"]: r for r in decontaminate.report(spark, table(spark, texts), bench, max_set=max_set).collect()}
    assert len(got) == len(texts)
    grams = {i: {tuple(w[j : j + min(10, len(w))]) for j in range(len(w) - min(10, len(w)) + 1)} for i, t in enumerate(items) if (w := folded_words(t))}
    for i, t in enumerate(texts):
        w, hit, found = folded_words(t), set(), set()
        for item, own in grams.items():
            for n in {len(g) for g in own}:
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) in own:
                        hit |= set(range(j, j + n))
                        found.add(item)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == sha(",".join(sorted(map(str, found))))
    clean = decontaminate.drop_contaminated(spark, table(spark, texts), bench, max_set=max_set)
    assert {r["doc_id"] for r in clean.collect()} == {i for i in got if not got[i]["contaminated"]}
    assert clean.columns == table(spark, texts).columns


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.report(spark, table(spark, ["a b"]), none).collect()] == [False]
    assert decontaminate.report(spark, table(spark, []), none).count() == 0


@pytest.mark.parametrize("max_set", [50_000, 1])
def test_cutting_hit_words_out(spark, max_set):
    texts = [None, "", "nothing of it", "(Alpha) beta, GAMMA; delta eps zeta eta theta iota kappa lambda. end!", "x alpha beta gamma delta eps zeta eta theta iota kappa y alpha"]
    bench = spark.createDataFrame([(None, "alpha beta gamma delta eps zeta eta theta iota kappa")], "item_id long, text string")
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in decontaminate.cut_contaminated(spark, docs, bench, max_set=max_set).collect()}
    assert [got[i]["text"] for i in range(5)] == [None, "", "nothing of it", " lambda. end!", "x y alpha"]
    assert got[4]["n_chars"] == 9 and got[2]["n_chars"] == len(texts[2])
    assert [r["n_items"] for r in sorted(decontaminate.report(spark, docs, bench, max_set=max_set).collect())] == [0, 0, 0, 1, 1]
    assert decontaminate.cut_contaminated(spark, docs, bench, max_set=max_set).columns == docs.columns


def test_ties_of_turn_and_role_go_by_text(spark):
    rows = [(1, 0, "user", t) for t in ("<a", "<|", "\\b", "[z", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", chat_format.text_part(F.col("text")).alias("parts"))
    (read,) = chat_format.format_turns(turns).select(chat_format.parse_turns(F.col("formatted")).alias("t")).collect()
    assert [t["text"] for t in read["t"]] == sorted(["<a", "<|", "\\b", "[z", ""])


def test_edits_count_characters():
    (span,) = license_scan.scanner().spans(license_scan.words_of("ünder thé MIT license"))
    assert (span.label, span.edits, span.start, span.end) == ("mit", 2, 0, 21)
