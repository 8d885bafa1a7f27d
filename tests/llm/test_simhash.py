"""SimHash, vantage-point trees and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from tallybar.llm import simhash
from tallybar.llm.components import connected_components
from tests.llm.helpers import ODD, corpus, table


def fingerprint_by_loop(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_loop(pairs, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def close(points):
    return [(i, j) for i in range(len(points)) for j in range(i) if bin(points[i] ^ points[j]).count("1") <= 3]


def test_near_duplicates_against_brute_force(spark):
    texts = [*ODD, *corpus(7, 90)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark, table(spark, texts)).collect()}
    fps = [fingerprint_by_loop(t) for t in texts]
    assert {i: got[i]["fp"] & (2**64 - 1) for i in got} == dict(enumerate(fps))
    assert {i: got[i]["component_id"] for i in got} == roots_by_loop(close(fps), range(len(fps)))


def planted(seed, n, clusters, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**64, clusters, dtype=np.uint64)
    points = [*rng.integers(0, 2**64, n, dtype=np.uint64).tolist()]
    for _ in range(n):
        x = int(centres[rng.integers(clusters)])
        for b in rng.integers(0, 64, rng.integers(0, spread)):
            x ^= 1 << int(b)
        points.append(x)
    return sorted(set(points))


@pytest.mark.parametrize(("shard", "block"), [(1024, 16384), (8, 16384), (30, 20)])
def test_trees_lose_no_link(spark, monkeypatch, shard, block):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SAMPLE_SHARE", 0.9)
    points = planted(3, 300, 6, 6)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark, spark.createDataFrame([(p, p, b"") for p in signed], "id long, fp long, more binary"))
    pairs = links.collect()
    assert len(pairs) < 30 * len(points)
    found = roots_by_loop([(r["a"], r["b"]) for r in pairs], signed)
    want = roots_by_loop([(signed[i], signed[j]) for i, j in close(points)], signed)
    assert found == want
    rooted = dict(connected_components(spark, links).collect())
    assert {p: rooted.get(p, p) for p in signed} == want


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(7, 7), (100, 90)], "a long, b long")
    assert dict(connected_components(spark, chain).collect()) == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90}
    assert connected_components(spark, chain.limit(0)).count() == 0


def test_one_of_each_keeps_columns_and_null_ids(spark):
    docs = table(spark, ["a b c d", "a b c d", "x y z", "a b c d"], ids=[5, 3, 4, None])
    kept = simhash.one_of_each(spark, docs, 3, 3, None)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or -1), r["keep"]) for r in kept.collect()) == [(-1, True), (3, True), (4, True)]
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [5, 11])
def test_more_blocks_lose_no_link(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "SHARD", 20)
    monkeypatch.setattr(simhash, "SAMPLE_SHARE", 0.9)
    points = planted(5, 200, 8, 9)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark, spark.createDataFrame([(p, p, b"") for p in signed], "id long, fp long, more binary"), bits)
    pairs = [(signed[i], signed[j]) for i in range(len(points)) for j in range(i) if bin(points[i] ^ points[j]).count("1") <= bits]
    assert roots_by_loop([tuple(r) for r in links.collect()], signed) == roots_by_loop(pairs, signed)


def test_similar_texts_are_linked_and_others_not(spark):
    rng = np.random.default_rng(4)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    texts = []
    for _ in range(40):
        own = word(300)
        near = [*own]
        near[50] = near[200] = "changed"
        half = [*own[:150], *word(150)]
        texts += [" ".join(own), " ".join(near), " ".join(half)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, table(spark, texts), 5, 11, 0.8).collect()}
    assert sum(got[3 * i] == got[3 * i + 1] for i in range(40)) >= 39  # Jaccard similarity 0.93
    assert sum(got[3 * i] != got[3 * i + 2] for i in range(40)) == 40  # 0.33


def test_similarity_is_that_of_the_shingle_sets(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(60):
        own = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
        for edits in (0, 5, 6, 7, 8):  # an edit takes five of 296 shingles: similarities to the first of 0.84 to 0.76
            copy = [*own]
            for at in rng.choice(300, edits, replace=False):
                copy[at] = f"e{rng.integers(10**9)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i)}
    families = roots_by_loop([p for p, s in alike.items() if s >= 0.8], range(len(texts)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, table(spark, texts), 5, 11, 0.8).collect()}
    for low, high in ((0.80, 0.85), (0.75, 0.80)):
        assert sum(low <= s < high for s in alike.values()) >= 3
    assert got == families


def test_large_families_are_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TASK_GRAMS", 900)
    texts = [*ODD, *corpus(11, 90)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) for t in texts)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, table(spark, texts), 5, 11, 0.8).collect()}
    assert got == roots_by_loop(pairs, range(len(texts)))


def test_one_row_of_each_group_whatever_its_doc_id(spark):
    a, b, c = "a b c d e f", "p q r s t u", "v w x y z a"
    docs = table(spark, [a, a, a, b, a, c, c, c], ids=[1, 1, 2, 7, 7, None, None, None])
    kept = simhash.one_of_each(spark, docs, 5, 11, 0.8, null_ids_stay=False)
    assert kept.columns == docs.columns
    assert sorted((r["text"], r["doc_id"] or -1) for r in kept.collect()) == [(a, 1), (b, 7), (c, -1)]


@pytest.mark.parametrize(("shard", "block"), [(4_096, 32_768), (16, 32_768), (64, 40)])
def test_net_of_set_prints_loses_no_similar_pair(spark, monkeypatch, shard, block):
    monkeypatch.setattr(simhash, "NET_SHARD", shard)
    monkeypatch.setattr(simhash, "NET_BLOCK", block)
    monkeypatch.setattr(simhash, "SAMPLE_SHARE", 0.9)
    rng, texts = np.random.default_rng(3), []
    for i in range(150):
        own = [f"w{x}" for x in rng.integers(0, 100_000, 4 + 2 * i)]
        for part in (own, own[: len(own) - len(own) // 20], [*own, "more"], [f"e{i}", *own[1:]]):
            texts.append(" ".join(part))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    holders: dict = {}
    for i, grams in enumerate(sets):
        for gram in grams:
            holders.setdefault(gram, []).append(i)
    met = {(max(a, b), min(a, b)) for ids in holders.values() for a in ids for b in ids if a != b}
    pairs = [(i, j) for i, j in met if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 500
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark, table(spark, texts), 5, 11, 0.8).collect()}
    assert got == roots_by_loop(pairs, range(len(texts)))


def test_trees_of_a_similarity_are_enough():
    sample = np.random.default_rng(6).integers(0, 2**64, (20_000, simhash.WORDS), np.uint64)
    trees = simhash.net_trees(sample, 500, 0.8)
    rng, n = np.random.default_rng(7), 20_000
    flipped = np.packbits(rng.random((n, 64 * simhash.WORDS)) < 0.1515, axis=1, bitorder="little").view(np.uint64)
    assert (np.bitwise_count(flipped).sum(1) <= simhash.NETS[-1]).all()
    missed = np.ones(n)
    for bits, tree in trees:
        missed *= 1 - simhash.share_met(tree, simhash.cut(sample, bits), simhash.cut(sample ^ flipped, bits))
    assert 5 < len(trees) < 40 and missed.max() < 3e-4


def test_pipeline_stage_finds_near_copies_through_the_trees(spark, monkeypatch):
    import corpus_pipeline

    built = []
    monkeypatch.setattr(simhash, "Tree", lambda *a, own=simhash.Tree: built.append(own(*a)) or built[-1])
    words = [f"w{i}" for i in range(200)]
    docs = table(spark, [" ".join(words), " ".join([*words[:-1], "changed"]), " ".join(reversed(words))])
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == {0, 2}
    assert built
