"""SimHash near-dedup with vantage-point trees.

Of fingerprints that differ in at most 2b - 1 bits one of b blocks of bits differs in one bit at most. So there are b
trees of shards, one for each block, and in each of them the radius is one: two halves for three bits, six blocks for
eleven. A tree is built on the driver from a sample of bounded size: a node has a vantage point and the median distance to it. All distinct fingerprints go down the tree to
their home shard; a branch that the triangle bound excludes is pruned, and a fingerprint whose ball crosses the bound is
a visitor of the other side as well (from outside to inside only, which meets each pair once). In a shard the pairs are
decided exactly on all bits, and only a spanning forest of the links leaves it. Shards that are too large are
split into blocks, and every two blocks meet in a task of their own.

Where a Jaccard similarity of the shingle sets is asked for, the net is of fingerprints too: SimHashes of 384 bits of the
sets, of which about 58 differ at a similarity of 0.8 and 192 between unrelated texts. Pairs within 102 bits are candidates.
The trees are over blocks of 24 bits, and as many are built as it takes for the chance that a pair at the similarity itself
meets in none to fall to 1e-4, as measured on pairs planted in the sample. In a shard pairs are decided on all bits. Texts
that candidate links connect are dealt to a task with their shingle sets, and there every pair is decided exactly through
an index of shingles; only a spanning forest leaves it. Families of over a million shingles are split into blocks, and
every two blocks meet in a task of their own. Shingles and sets are told apart by 64-bit hashes.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; copies are one fingerprint from the start; a null doc_id takes part but is
no representative unless all are null; repeated rows are rows of their own, of which one stands for the group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybar.llm.common import by_row, columns, discard, materialize
from tallybar.llm.components import connected_components
from tallybar.llm.repeats import Bitmap

BITS = 3
SEED = 42
#: Fingerprints that a tree is built from, at most (8 bytes each on the driver), and at most this share of all.
SAMPLE, SAMPLE_SHARE = 65_536, 0.125
#: Home fingerprints in a shard, about; points in a shard or block, at most.
SHARD, BLOCK = 1_024, 16_384
_CHUNK = 65_536
#: Of a similarity's net: words of a fingerprint, bits of a tree's block, home points in a shard, points in one or a block of it.
WORDS, NET_BITS, NET_SHARD, NET_BLOCK = 6, 24, 4_096, 32_768
#: The chance that trees miss a pair at the similarity itself; trees, at most; pairs planted to measure it.
NET_MISS, NET_TREES, _PLANTED = 1e-4, 128, 2_000
#: Bits that a candidate may differ in over the first words: four deviations beyond what small sets have, 3/16 at a similarity of 0.8.
NETS = [int(12 * k + 4 * (9.75 * k) ** 0.5) for k in range(1, WORDS + 1)]
#: Shingles in a task that decides pairs, about.
TASK_GRAMS = 1_000_000
_STEPS = np.random.default_rng(11).integers(0, 2**64, WORDS, np.uint64)
_PRINT = [f"w{k}" for k in range(WORDS)]
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def gram_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """The XXH64 of all word shingles, repeats included, in the order of the text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    a, b = starts[:n], ends[min(shingle, len(words)) - 1 :]
    hashed = np.empty(n, np.uint64)
    for i in range(0, n, _CHUNK):
        spans = zip(a[i : i + _CHUNK].tolist(), b[i : i + _CHUNK].tolist(), strict=True)
        hashed[i : i + _CHUNK] = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in spans), np.uint64)
    return hashed


def majority(hashed: np.ndarray) -> int:
    """The bits that most of the hashes have, as a signed long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashed), _CHUNK):
        octets = hashed[i : i + _CHUNK].view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS
    return int(np.packbits(counts * 2 > len(hashed), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """tb_row, doc_id, fp (the 64 bits as a signed long) and id (the same) of every row."""

    def make(texts: list) -> dict:
        bits = [majority(gram_hashes(t, shingle)) for t in texts]
        return {"fp": bits, "id": bits}

    return by_row(columns(docs, tb_row="long", doc_id="long", text="string"), make, "tb_row long, doc_id long, fp long, id long", ("tb_row", "doc_id"))


def set_print(grams: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingle hashes, WORDS words of 64 bits."""
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(grams), 255):
        x = grams[i : i + 255, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(grams), bitorder="little").view(np.int64)


def set_id(grams: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(grams.tobytes())], np.uint64).view(np.int64)[0])


def shingle_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """tb_row, doc_id, fp, id (a hash of the shingle set), size and the words of its SimHash of every row."""

    def make(texts: list) -> dict:
        out: dict = {"fp": [], "id": [], "size": []}
        words = np.zeros((len(texts), WORDS), np.int64)
        for i, text in enumerate(texts):
            hashed = gram_hashes(text, shingle)
            grams = np.unique(hashed)
            words[i] = set_print(grams)
            for name, value in zip(out, (majority(hashed), set_id(grams), len(grams)), strict=True):
                out[name].append(value)
        return out | dict(zip(_PRINT, words.T, strict=True))

    schema = "tb_row long, doc_id long, fp long, id long, size long, " + ", ".join(f"{w} long" for w in _PRINT)
    return by_row(columns(docs, tb_row="long", doc_id="long", text="string"), make, schema, ("tb_row", "doc_id"))


def shingle_sets(docs: DataFrame, shingle: int, wanted: Bitmap) -> DataFrame:
    """id and grams (the sorted hashes) of the shingle sets of all rows whose id may be a wanted one."""

    def make(texts: list) -> dict:
        out: dict[str, list] = {"id": [], "grams": []}
        for text in texts:
            grams = np.unique(gram_hashes(text, shingle))
            own = set_id(grams)
            out["id"].append(own)
            out["grams"].append(grams.tobytes() if wanted.holds(np.array([own]))[0] else None)
        return out

    return by_row(columns(docs, text="string"), make, "id long, grams binary", ()).where("grams IS NOT NULL")


class Tree:
    """A vantage-point tree over blocks of at most 32 bits whose leaves are shards; radius one."""

    def __init__(self, sample: np.ndarray, leaf: int, first: int = 0):
        rng = np.random.default_rng(7)
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, median, inside, outside; a leaf is (-1, shard, 0, 0)
        self.shards = first
        todo = [(sample, self._new())]
        while todo:
            values, at = todo.pop()
            split = self._split(values, rng) if len(values) > leaf else None
            if split is None:
                self.nodes[at] = (-1, self.shards, 0, 0)
                self.shards += 1
                continue
            vantage, median, near = split
            inside, outside = self._new(), self._new()
            self.nodes[at] = (vantage, median, inside, outside)
            todo += [(values[near], inside), (values[~near], outside)]

    def _new(self) -> int:
        self.nodes.append((0, 0, 0, 0))
        return len(self.nodes) - 1

    @staticmethod
    def _split(values: np.ndarray, rng: np.random.Generator) -> tuple[int, int, np.ndarray] | None:
        """The split, of a few vantage points tried, with fewest visitors for an even cut."""
        best = None
        for vantage in values[rng.integers(0, len(values), 5)]:
            d = np.bitwise_count(values ^ vantage)
            median = int(np.median(d))
            for cut in (median - 1, median):
                near = d <= cut
                larger = max(near.sum(), len(d) - near.sum())
                if 0 < near.sum() < len(d):
                    cost = larger + (d == cut + 1).sum()
                    if best is None or cost < best[0]:
                        best = (cost, int(vantage), cut, near)
        return best[1:] if best else None

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, row, home) of every visit of these values."""
        shard, row, home = [], [], []
        todo = [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            at, rows, own = todo.pop()
            if not len(rows):
                continue
            vantage, median, inside, outside = self.nodes[at]
            if vantage < 0:
                shard.append(np.full(len(rows), median, np.int32))
                row.append(rows)
                home.append(own)
                continue
            d = np.bitwise_count(values[rows] ^ np.uint32(vantage)).astype(np.int16)
            near = np.where(own, d <= median + 1, d - 1 <= median)
            far = np.where(own, d > median, d + 1 > median)
            todo.append((inside, rows[near], own[near] & (d[near] <= median)))
            todo.append((outside, rows[far], own[far]))
        if not shard:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)
        return np.concatenate(shard), np.concatenate(row), np.concatenate(home)


def block(fps: np.ndarray, k: int, of: int) -> np.ndarray:
    """The k-th of so many blocks of the fingerprints' bits."""
    low, high = 64 * k // of, 64 * (k + 1) // of
    return ((fps.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.uint32)


def spanning_links(points: np.ndarray, home: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(least, other) places for each other point of every group of linked points, least being one of each group.

    A pair is linked if it differs in at most `bits` of points; it counts if one of the two is at home. Points without any link drop out by blocks first; from the rest a group is
    gathered point by point, each compared only with points that no group has yet.
    """
    n = len(points)
    linked = np.zeros(n, bool)

    def decided(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        near = np.bitwise_count(points[rows][:, None] ^ points[others][None, :]) <= bits
        return near & (home[rows][:, None] | home[others][None, :])

    for i in range(0, n, 256):
        rows = np.arange(i, min(i + 256, n))
        for j in range(i, n, 8192):
            others = np.arange(j, min(j + 8192, n))
            near = decided(rows, others)
            own = rows[(rows >= j) & (rows < j + 8192)]
            near[own - i, own - j] = False
            linked[rows] |= near.any(1)
            linked[others] |= near.any(0)
    left = np.flatnonzero(linked)
    links = []
    while len(left):
        group, todo, left = [int(left[0])], [int(left[0])], left[1:]
        while todo and len(left):
            near = decided(np.array([todo.pop()]), left)[0]
            if near.any():
                new, left = left[near].tolist(), left[~near]
                group += new
                todo += new
        links += [(group[0], x) for x in group[1:]]
    return links


def in_blocks(routed: DataFrame, most: int) -> DataFrame:
    """routed with i and j: shards of more than so many points are split into blocks, and every two blocks meet in one (i, j)."""
    large = routed.groupBy("shard").count().where(F.col("count") > most)
    blocks = {r["shard"]: -(-r["count"] // most) for r in large.collect()}  # of the trees' shards, so bounded
    if not blocks:
        return routed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("shard")), F.lit(1))
    numbered = routed.withColumn("n", count).withColumn("i", F.pmod(F.xxhash64("id"), "n").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j")))
    return numbered.withColumn("b", F.explode(pairs)).select(*routed.columns, "b.i", "b.j")


def links(spark: SparkSession, distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between the rows (id, fp) of distinct fingerprints: a spanning forest of each shard's links."""
    of = bits // 2 + 1
    n = distinct.count()
    share = min(SAMPLE_SHARE, SAMPLE / max(n, 1))
    drawn = distinct.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))).select("fp").limit(2 * SAMPLE)
    sample = np.sort(np.array([r["fp"] for r in drawn.collect()], np.int64))  # bounded by 2 x SAMPLE
    leaf = max(8, int(SHARD * share))
    trees: list[Tree] = []
    for k in range(of):
        trees.append(Tree(block(sample, k, of), leaf, trees[-1].shards if trees else 0))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for k, tree in enumerate(trees):
                shard, row, home = tree.route(block(fps, k, of))
                yield pd.DataFrame({"shard": shard, "id": batch["id"].to_numpy(np.int64)[row], "fp": fps[row], "home": home})

    dealt = in_blocks(distinct.select("id", "fp").mapInPandas(visits, "shard int, id long, fp long, home boolean"), BLOCK)

    def decide(shard: pd.DataFrame) -> pd.DataFrame:
        ids = shard["id"].to_numpy(np.int64)
        made = spanning_links(shard["fp"].to_numpy(np.int64).view(np.uint64), shard["home"].to_numpy(bool), bits)
        return pd.DataFrame([(ids[a], ids[b]) for a, b in made], columns=["a", "b"], dtype=np.int64)

    return dealt.groupBy("shard", "i", "j").applyInPandas(decide, "a long, b long")


def cut(points: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """These bits of the points' words, as one number."""
    return (((points[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1)) << np.arange(len(bits), dtype=np.uint64)).sum(1).astype(np.uint32)


def share_met(tree: Tree, values: np.ndarray, others: np.ndarray) -> float:
    """The share of pairs that meet in a shard which is home to one of the two."""
    n = 2 * len(values)
    shard, row, home = tree.route(np.concatenate([values, others]))
    own = np.zeros(n, np.int64)
    own[row[home]] = shard[home]
    other = np.roll(np.arange(n), len(values))
    met = np.isin(own * n + other, shard.astype(np.int64) * n + row)
    return float((met | met[other])[: len(values)].mean())


def net_trees(sample: np.ndarray, leaf: int, similarity: float) -> list[tuple[np.ndarray, Tree]]:
    """(bits, tree) of as many blocks as pairs at this similarity need: equal sets of that similarity differ in this share of bits."""
    rng = np.random.default_rng(5)
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    own = sample[rng.integers(0, max(1, len(sample)), _PLANTED)] if len(sample) else sample
    near = own ^ np.packbits(rng.random((len(own), 64 * WORDS)) < share, axis=1, bitorder="little").view(np.uint64)
    trees: list[tuple[np.ndarray, Tree]] = []
    order, miss = np.arange(64 * WORDS), 1.0
    while not trees or miss > NET_MISS and len(trees) < NET_TREES:
        at = len(trees) % (len(order) // NET_BITS)
        if trees and not at:
            order = rng.permutation(order)
        bits = order[NET_BITS * at : NET_BITS * (at + 1)]
        tree = Tree(np.sort(cut(sample, bits)), leaf, trees[-1][1].shards if trees else 0)
        trees.append((bits, tree))
        miss *= 1 - share_met(tree, cut(own, bits), cut(near, bits)) if len(own) else 0.0
    return trees


def spanning_net(points: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """As spanning_links, for points of WORDS words that are linked if they differ in NETS bits at most."""
    order = np.argsort(~home, kind="stable")
    words, home, n = np.ascontiguousarray(points[order].T), home[order], len(points)
    linked = np.zeros(n, bool)

    def decided(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(words[0, rows][:, None] ^ words[0, others][None, :])
        apart += np.bitwise_count(words[1, rows][:, None] ^ words[1, others][None, :])
        near = apart <= NETS[1]
        some = np.flatnonzero(near)
        if 5 * len(some) > near.size:
            apart = apart.astype(np.uint16)
            for k in range(2, WORDS):
                apart += np.bitwise_count(words[k, rows][:, None] ^ words[k, others][None, :])
                near &= apart <= NETS[k]
            return near
        (i, j), apart = np.divmod(some, len(others)), apart.ravel()[some].astype(np.uint16)
        near = np.zeros_like(near)
        for k in range(2, WORDS):
            apart = apart + np.bitwise_count(words[k, rows[i]] ^ words[k, others[j]])
            left = apart <= NETS[k]
            i, j, apart = i[left], j[left], apart[left]
        near[i, j] = True
        return near

    for i in range(0, int(home.sum()), 16):
        rows = np.arange(i, min(i + 16, int(home.sum())))
        for j in range(i, n, 4096):
            others = np.arange(j, min(j + 4096, n))
            near = decided(rows, others)
            own = rows[(rows >= j) & (rows < j + 4096)]
            near[own - i, own - j] = False
            linked[rows] |= near.any(1)
            linked[others] |= near.any(0)
    left = np.flatnonzero(linked)
    links = []
    while len(left):
        group, todo, left = [int(left[0])], [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = decided(np.array([at]), left)[0] & (home[at] | home[left])
            if near.any():
                new, left = left[near].tolist(), left[~near]
                group += new
                todo += new
        links += [(int(order[group[0]]), int(order[x])) for x in group[1:]]
    return links


def net_links(spark: SparkSession, distinct: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the rows (id, words) of distinct sets: a spanning forest of each shard's candidates."""
    points = distinct.select("id", *_PRINT)
    share = min(SAMPLE_SHARE, SAMPLE / max(points.count(), 1))
    drawn = points.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))).select(*_PRINT).limit(2 * SAMPLE)
    sample = np.array([tuple(r) for r in drawn.collect()], np.int64).reshape(-1, WORDS).view(np.uint64)  # bounded by 2 x SAMPLE
    trees = net_trees(sample[np.lexsort(sample.T)], max(8, int(NET_SHARD * share)), similarity)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in gathered(batches, _CHUNK):
            prints = rows[_PRINT].to_numpy(np.int64)
            for bits, tree in trees:
                shard, row, home = tree.route(cut(prints.view(np.uint64), bits))
                for i in range(0, len(row), _CHUNK):
                    part = row[i : i + _CHUNK]
                    words = dict(zip(_PRINT, prints[part].T, strict=True))
                    yield pd.DataFrame({"shard": shard[i : i + _CHUNK], "id": rows["id"].to_numpy(np.int64)[part], "home": home[i : i + _CHUNK]} | words)

    def decide(shard: pd.DataFrame) -> pd.DataFrame:
        ids = shard["id"].to_numpy(np.int64)
        made = spanning_net(shard[_PRINT].to_numpy(np.int64).view(np.uint64), shard["home"].to_numpy(bool))
        return pd.DataFrame([(ids[a], ids[b]) for a, b in made], columns=["a", "b"], dtype=np.int64)

    schema = "shard int, id long, home boolean, " + ", ".join(f"{w} long" for w in _PRINT)
    dealt = in_blocks(points.mapInPandas(visits, schema), NET_BLOCK)
    return dealt.groupBy("shard", "i", "j").applyInPandas(decide, "a long, b long")


def gathered(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at least so many, but for the last."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def similar_links(grams: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(least, other) places for each other set of every group of sets whose Jaccard similarity links them.

    Each set is compared, through an index from shingles to sets, with all sets that no group has yet.
    """
    n, sizes = len(grams), np.array([len(g) for g in grams])
    every, owner = np.concatenate(grams), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    keys, first, counts = np.unique(every[order], return_index=True, return_counts=True)
    owner, free, links = owner[order], np.ones(n, bool), []

    def near(at: int) -> np.ndarray:
        found = np.searchsorted(keys, grams[at])
        c = counts[found]
        places = np.repeat(first[found] - np.cumsum(c) + c, c) + np.arange(c.sum())
        others = owner[places]
        shared = np.bincount(others[free[others]], minlength=n)
        some = np.flatnonzero(shared)
        return some[shared[some] / (sizes[at] + sizes[some] - shared[some]) >= similarity]

    for i in range(n):
        if free[i]:
            free[i], todo = False, [i]
            while todo:
                new = near(todo.pop())
                free[new] = False
                links += [(i, int(x)) for x in new]
                todo += new.tolist()
    return links


def similar(spark: SparkSession, docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between ids of distinct: a spanning forest, in each task, of the pairs of sets that are so similar."""
    sets = distinct.where("size > 0")
    families = materialize(spark, connected_components(spark, net_links(spark, sets, similarity)), "families")
    found = shingle_sets(docs, shingle, Bitmap(families, "node"))  # the sets of texts without a family stay where they are
    sized = families.join(sets.select("id", "size"), families["node"] == F.col("id")).select("id", "root", "size")
    sized = materialize(spark, sized, "family-sizes")
    grams = sized.groupBy("root").agg(F.sum("size").alias("grams"))
    tasks = 1 + (sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // TASK_GRAMS)
    n = F.ceil(F.col("grams") / TASK_GRAMS).cast("int")
    # a family of one task's size at most goes with others of its kind, as pairs of different families aren't similar anyway
    dealt = sized.join(grams, "root").select("id", n.alias("n"), F.when(n > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks))).alias("task"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("id"), "n").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j")))
    dealt = dealt.select("id", "n", "task", F.explode(pairs).alias("b")).select("id", (F.col("n") > 1).alias("large"), "task", "b.i", "b.j")
    met = dealt.join(found.groupBy("id").agg(F.first("grams").alias("grams")), "id")

    def decide(task: pd.DataFrame) -> pd.DataFrame:
        ids = task["id"].to_numpy(np.int64)
        made = similar_links([np.frombuffer(g, np.uint64) for g in task["grams"]], similarity)
        return pd.DataFrame([(ids[a], ids[b]) for a, b in made], columns=["a", "b"], dtype=np.int64)

    return met.groupBy("large", "task", "i", "j").applyInPandas(decide, "a long, b long")


def grouped(spark: SparkSession, docs: DataFrame, shingle: int, bits: int, similarity: float | None) -> DataFrame:
    """tb_row (null if docs have none), doc_id, fp and first of every row.

    first is the (no_id, doc_id, tb_row) of the row that stands for its component: the smallest doc_id, then the smallest
    tb_row; rows without a doc_id come last.
    """
    if similarity is None:
        found = materialize(spark, fingerprints(docs, shingle), "simhash")
    else:
        found = materialize(spark, shingle_prints(docs, shingle), "set-prints")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tb_row")
    more = [F.first(c).alias(c) for c in ("fp", "size", *_PRINT) if c in found.columns]
    distinct = materialize(spark, found.groupBy("id").agg(*more, F.min(own).alias("least")), "simhash-distinct")
    groups = connected_components(spark, links(spark, distinct, bits) if similarity is None else similar(spark, docs, distinct, shingle, similarity))
    rooted = distinct.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = rooted.join(least, "root").select("id", "first")
    return found.select("id", "tb_row", "doc_id", "fp").join(named, "id").select("tb_row", "doc_id", "fp", "first")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id that links reach) of every row.

    Without a similarity, fingerprints of 64 bits are linked if they differ in at most `bits`. With one, texts within the net
    of the wider SimHashes are linked if their shingle sets have this Jaccard similarity at least.
    """
    return grouped(spark, docs, shingle, bits, similarity).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 5, bits: int = 11, similarity: float | None = 0.8, null_ids_stay: bool = True) -> DataFrame:
    """docs with all columns and one row of each component, that with the smallest doc_id; of equal ones any one.

    Rows with a null doc_id come last, or all stay if null_ids_stay. The rows are numbered in a written copy of docs.
    """
    numbered = materialize(spark, docs.withColumn("tb_row", F.monotonically_increasing_id()), "numbered")
    dropped = grouped(spark, numbered, shingle, bits, similarity).where("tb_row != first.tb_row")
    if null_ids_stay:
        dropped = dropped.where("doc_id IS NOT NULL")
    return numbered.join(dropped.select("tb_row"), "tb_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
