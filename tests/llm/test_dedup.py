import random
import re

import numpy as np
import pytest
import xxhash

from songframe.llm import exact_dedup, simhash
from songframe.llm.common import table


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def fingerprint(text, n=3):
    w = words(text)
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def grouped(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def test_fingerprints_and_components(spark, hard_dir, docs):
    short = docs
    prints = [fingerprint(t) for _, t in short]
    roots = grouped(len(short), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    least = {}
    for r, (i, _) in zip(roots, short, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted((i or 0, f"{f:016x}", least[r] or 0) for (i, _), f, r in zip(short, prints, roots, strict=True))
    got = simhash.op9_simhash(spark, hard_dir).collect()
    assert len(got) == len(docs)
    known = {(i, f) for i, f, _ in want}
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in got if (r.doc_id or 0, r.fingerprint) in known) == want


@pytest.mark.parametrize(("most", "nodes"), [(4096, 1 << 20), (5, 1 << 20), (5, 40), (1000, 30)])
def test_links_against_all_pairs(spark, most, nodes):
    """Also where trees come in several batches, and large shards are dealt more finely."""
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(frame, 2, 4, most, nodes)).collect()}
    roots = grouped(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = [found.get(f, f) for f in signed]
    assert all((got[a] == got[b]) == (roots[a] == roots[b]) for a in range(len(fps)) for b in range(a))


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = f"w{rng.randrange(500)}"
            texts.append(" ".join(base))
    texts += ["", "", " ", None]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    roots = grouped(len(texts), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and bool(sets[a]))
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, id long")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame).collect()) == sorted(set(roots))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame.where("doc_id < 0")).collect()) == []


def test_shard_trees_in_blocks(spark):
    """The same forest when shards are cut into several trees."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        w = list(base)
        w[int(rng.integers(200))] = f"x{i}"
        texts.append(" ".join(w))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = simhash.similar_components(frame, most=7).collect()
    assert {r.component_id for r in rows} == {0} and len(rows) == 60


def test_exact_stage(spark, hard_dir, docs):
    frame = table(spark, hard_dir, "documents")
    left = exact_dedup.drop_exact_duplicates(frame)
    assert left.columns == frame.columns
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for i, t in docs:
        rank = (-len(t), i is None, i or 0)
        best[bare(t)] = min(best.get(bare(t), rank), rank)
    assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted(best.values())


def test_exact_heavy_hitters(spark):
    """One text in half of all rows, another in a tenth."""
    rows = [(i, "hot" if i % 2 else "warm " if i % 10 == 0 else f"t{i // 3}") for i in range(6000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t.strip(), []).append(i)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = groups[text[r.id].strip()]
        assert (r.group_size, r.keep_id, r.kept) == (len(own), min(own), r.id == min(own))


def test_similar_sets_beyond_the_radius():
    """Pairs at a similarity of 0.8 whose SimHash values differ in more than 16 bits."""
    rng = np.random.default_rng(1)
    beyond = 0
    for _ in range(400):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 9)]
        sets = [simhash.shingles(" ".join(w[:k]), 5) for k in (9, 8)]  # 5 shingles and 4 of them
        bits = [np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > len(h) for h in sets]
        fp = np.array([np.packbits(b, bitorder="little").view(np.uint64)[0] for b in bits])
        beyond += int(np.bitwise_count(fp[0] ^ fp[1])) > 16
        own = [np.unique(h.astype(np.uint32)) for h in sets]
        for asks in (np.zeros(2, int), np.array([0, 1])):  # one tree, and a block of another's queries
            root, node = simhash.similar_forest(fp, own, asks, 16, 0.8)
            assert (root.tolist(), node.tolist()) == ([0], [1])
    assert beyond > 10


@pytest.mark.parametrize("blocks", [False, True])
def test_similar_forest_against_all_pairs(blocks):
    """Fingerprints say nothing here: all links must come from the sets."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**32, rng.integers(4, 40), dtype=np.uint32)
        for _ in range(rng.integers(1, 5)):
            base = base.copy()
            base[rng.integers(len(base))] = rng.integers(0, 2**32)
            sets.append(np.unique(base))
    fp = rng.integers(0, 2**63, len(sets)).astype(np.uint64)
    asks = rng.integers(0, 2, len(sets)) if blocks else np.zeros(len(sets), int)

    def linked(a, b):
        return (not blocks or asks[a] != asks[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))

    label = list(range(len(sets)))
    for root, node in zip(*simhash.similar_forest(fp, sets, asks, 16, 0.8), strict=True):
        label[node] = root
    roots = grouped(len(sets), linked)
    assert [label.index(x) for x in label] == [roots.index(x) for x in roots]


def test_trees_are_keyed_by_integer_distance(spark):
    rng = np.random.default_rng(8)
    fps = np.unique(np.concatenate([rng.integers(0, 2**64, 300, np.uint64), np.arange(200, dtype=np.uint64)]))
    rng.shuffle(fps)
    order, parents, edges = simhash.bk_tree(fps)
    assert sorted(order.tolist()) == list(range(len(fps))) and parents[0] == -1 and (np.diff(parents) >= 0).all()
    own = fps[order]
    assert all(edges[i] == (int(own[i]) ^ int(own[parents[i]])).bit_count() for i in range(1, len(own)))
    assert len({(p, e) for p, e in zip(parents.tolist(), edges.tolist(), strict=True)}) == len(own)  # one child an edge
    for radius in (0, 2, 7):
        got = {(int(own[node]), int(fps[q])) for node, near in simhash.descend(own, parents, edges, fps, radius) for q in near}
        assert got == {(int(a), int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= radius}


@pytest.mark.parametrize("measure", ["jaccard", "cosine"])
def test_large_shards_against_all_pairs(spark, measure):
    """Shards of more than `most` sets: held against a few first, the rest in blocks."""
    rng, texts = random.Random(2), []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(40):
            if rng.random() < 0.2:
                base[rng.randrange(60)] = f"n{rng.randrange(10**6)}"  # the group drifts
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both**2 >= 0.64 * len(sets[a]) * len(sets[b]) if measure == "cosine" else both >= 0.8 * len(sets[a] | sets[b])

    roots = grouped(len(texts), linked)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (2048, 7):
        rows = simhash.similar_components(frame, measure=measure, most=most, bands=30).collect()
        assert [r.component_id for r in sorted(rows, key=lambda r: r.id)] == roots
    assert 6 <= len(set(roots)) < 200


def test_components_of_random_graphs_and_a_large_star(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(280)] + [(1000, 1000 + i) for i in range(1, 900)] + [(1500, 5000), (5000, 5001)]
    pairs = [(a, b) for a, b in pairs if a != b]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
