"""The classifier on held-out rows, and the pipeline's stages on planted cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tallybar.llm import quality
from tests.llm.helpers import ODD, table

LABELS = "doc_id long, quality int, toxic int"


def rated(n, seed=1):
    """Texts of three grades: marks behind each word, an insult or two, and neither."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, grades = [], []
    for i in range(n):
        words = [rng.choice(lexicon) for _ in range(rng.randint(20, 200))]
        grade = (0, 1, 2, 2, 2)[i % 5]
        if grade == 0:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        if grade == 1:
            words[3] = words[7] = rng.choice(["dolt", "lout"])
        texts.append(" ".join(words))
        grades.append(grade)
    return texts, np.array(grades)


def test_held_out_accuracy():
    texts, grades = rated(900)
    places = [quality.features(t) for t in texts]
    model = quality.fit(places[:600], grades[:600])
    tails = model.tails(places[600:])
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails > 0.5).sum(1) == grades[600:]).mean() > 0.97
    expected = tails.sum(1)
    assert expected[grades[600:] == 0].mean() < 0.5 < expected[grades[600:] == 1].mean() < 1.5 < expected[grades[600:] == 2].mean()


def test_scores_of_odd_rows(spark):
    texts, grades = rated(200)
    docs = table(spark, [*ODD, *texts])
    at = len(ODD)
    labels = spark.createDataFrame([*[(at + i, int(g > 0), int(g == 1)) for i, g in enumerate(grades)], (at, 1, 0), (None, 1, 0), (3, None, None), (99_999, 1, 0)], LABELS)
    model = quality.train(spark, docs, labels)
    got = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    assert len(got) == len(ODD) + 200 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())
    assert {r["doc_id"] for r in quality.kept(docs, model).collect()} == {i for i, r in got.items() if r["keep"]}
    assert sum(got[at + i]["keep"] == (g == 2) for i, g in enumerate(grades)) > 190
    assert quality.train(spark, docs, labels.limit(0)) is None and quality.train(spark, docs.limit(0), labels) is None
    assert quality.kept(docs, None).count() == docs.count() and quality.scored(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    """A small corpus: clean texts, near copies, a shared passage, a benchmark passage and low grades."""
    where = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(5)
    word = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(k))
    texts, grades = rated(300, 3)
    passage, item = word(60), word(30)
    clean = [word(150) for _ in range(30)]
    near = [t.replace(t.split(" ")[70], "changed", 1) for t in clean[:5]]
    shared = [f"{word(80)} {passage} {word(80)}" for _ in range(4)]
    leaked = [f"{word(60)} {item} {word(60)}" for _ in range(2)]
    rows = [*texts, *clean, *near, *shared, *leaked]
    docs = table(spark, rows, [f"s{i % 4}" for i in range(len(rows))]).drop("fingerprint", "keep")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, g in enumerate(grades)], LABELS).write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    at = np.cumsum([0, *map(len, (texts, clean, near, shared, leaked))])
    return where, grades, passage, {n: list(range(a, b)) for n, a, b in zip(("rated", "clean", "near", "shared", "leaked"), at, at[1:], strict=False)}


def test_stages(spark, corpus_dir):
    where, grades, passage, ids = corpus_dir
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(spark, stage(spark, docs, where), name)
        steps[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "source_mixing" or docs.columns == columns
    kept = steps["quality_classifier"]
    good = [i for i in ids["rated"] if grades[i] == 2]
    assert sum(i in kept for i in good) > 0.97 * len(good) and sum(i in kept for i in ids["rated"] if grades[i] < 2) < 5
    once = steps["simhash_dedup"]
    assert all((a in once) != (b in once) or not {a, b} & set(kept) for a, b in zip(ids["clean"][:5], ids["near"], strict=True))
    assert all(i in once for i in kept if i not in ids["near"])
    cut = steps["suffix_array_dedup"]
    assert set(cut) == set(once) and all(passage not in cut[i]["text"] for i in ids["shared"] if i in cut)
    assert all(cut[i]["text"] == once[i]["text"] for i in ids["clean"] if i in once)
    free = steps["benchmark_decontamination"]
    assert set(cut) - set(free) == set(ids["leaked"]) & set(cut)
    assert set(steps["source_mixing"]) == set(free)


def test_run_gives_what_the_stages_give(spark, corpus_dir):
    result = corpus_pipeline.run(spark, corpus_dir[0])
    assert result.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken", "position"]
    assert result.count() == result.select("doc_id").distinct().count() > 100
