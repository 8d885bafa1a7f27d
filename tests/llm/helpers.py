"""Small tables for the operators' tests, with the shapes that break things."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, keep boolean"


def corpus(seed: int = 1, n: int = 60, vocabulary: int = 300, words: int = 120) -> list[str]:
    """Texts with exact copies, near copies, shared passages, repeats within a text and odd characters."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)] + ["Ünïcode", "日本語", "naïve", "A_B", "x-y"]
    some = lambda k: " ".join(rng.choice(lexicon) for _ in range(k))
    passage, texts = some(90), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            texts.append(texts[-1])
        elif kind == 2 and texts:
            copy = texts[rng.randrange(len(texts))].split(" ")
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        elif kind == 3:
            texts.append(f"{some(rng.randint(1, words))} {passage}\n{some(rng.randint(1, 30))}")
        elif kind == 4:
            part = some(70)
            texts.append(f"{part}\t{some(20)} {part}")
        else:
            texts.append(some(rng.randint(1, words)))
    return texts


def table(spark, texts: list, sources: list | None = None, ids: list | None = None):
    """documents with extra columns whose names clash with those that operators return."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(ids[i], t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), "clash", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n\t ", "one", "one", "Übermaß naïve 日本語", "word " * 40_000, "same same same", None]
