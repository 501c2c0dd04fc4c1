"""SimHash fingerprints, linked within a radius through broadcast BK-trees of shards.

Fingerprints that differ in at most R of 64 bits, cut into M blocks, agree in at
least M - R blocks. So each distinct fingerprint is dealt once for every choice
of M - R blocks, by the value of those bits; any two linked ones meet in a
shard. Shards of more than MOST_IN_TREE fingerprints are dealt once more, by blocks
of the bits that are left, with the same guarantee; what is still larger has several
trees. A BK-tree is stored as a row: its fingerprints level by level, and for each
the place of its parent and the edge to it, their Hamming distance. Trees
are broadcast in batches of at most TREE_NODES nodes, as many batches as their count
asks for; the fingerprints of a shard, in blocks as large as a tree, come to them where
they lie, descend together and follow only edges within the radius. A tree and a block
give a spanning forest of their links, so output grows with the rows, not with
pairs; components follow by alternating large and small stars, each round a table
in the shared folder.

Null text counts as empty; texts without words have fingerprint zero. Ids may
repeat or be null: every row has its result, and a component's id is the
smallest id that is not null. An empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import BROADCAST_ROWS, new_path, partitions, small, small_batches, staged, table, text_of, with_group

SEED = 42
#: Fingerprints of a tree, and nodes of the trees that are broadcast at once.
MOST_IN_TREE, TREE_NODES = 4096, 1 << 20
TREE = "k long, t int, trees int, batch int, large boolean, fps binary, parents binary, edges binary"


def fingerprint(text: str, n: int = 3) -> int:
    """Of n-word shingles (fewer words: of the whole sequence; none: zero)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = min(n, len(words))
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[a:b], SEED) for a, b in zip(begins[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(words) - n + 1)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones.astype(np.int64) > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """id, th (a hash of the text) and fp, a signed 64-bit fingerprint, of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([fingerprint(t, n) for t in x["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": x["id"], "th": x["th"], "fp": fp})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    return rows.mapInPandas(run, "id long, th long, fp long")


def bits_of(mask: int) -> list[int]:
    return [i for i in range(64) if mask >> i & 1]


def block_masks(radius: int, blocks: int, fixed: int = 0) -> list[int]:
    """Masks of all choices of blocks - radius of the blocks that the bits outside
    `fixed` are cut into, with those of `fixed`."""
    free = bits_of(~fixed & (1 << 64) - 1)
    edges = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    single = [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [fixed | sum(c) for c in combinations(single, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bk_tree(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of fps level by level, the place of each one's parent in that order (-1
    for the root) and the edge to it. Siblings have different edges."""
    order, parents, edges = [], [], []
    waiting = deque([(np.arange(len(fps)), -1, 0)])
    while waiting:
        own, parent, edge = waiting.popleft()
        at = len(order)
        order.append(own[0])
        parents.append(parent)
        edges.append(edge)
        rest = own[1:]
        if rest.size:
            away = np.bitwise_count(fps[rest] ^ fps[own[0]])
            waiting.extend((rest[away == d], at, int(d)) for d in np.unique(away))
    return np.array(order, np.int32), np.array(parents, np.int32), np.array(edges, np.uint8)


def descend(fps: np.ndarray, parents: np.ndarray, edges: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes of a tree, each with the places of the queries within the radius. A query
    follows the edges that differ from its distance to the node by the radius at most."""
    nodes = np.arange(len(fps))
    first, last = np.searchsorted(parents, nodes, "left").tolist(), np.searchsorted(parents, nodes, "right").tolist()
    steps, stack = edges.astype(np.int16), [(0, np.arange(len(queries)))]
    while stack:
        node, asked = stack.pop()
        away = np.bitwise_count(queries[asked] ^ fps[node]).astype(np.int16)
        near = asked[away <= radius]
        if near.size:
            yield node, near
        for child in range(first[node], last[node]):
            follow = asked[np.abs(away - steps[child]) <= radius]
            if follow.size:
                stack.append((child, follow))


def forest(fps: np.ndarray, parents: np.ndarray, edges: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what the links between a tree and queries do."""
    known = np.unique(np.concatenate((fps, queries)))
    label, at, asked = np.arange(len(known)), np.searchsorted(known, fps), np.searchsorted(known, queries)
    for node, near in descend(fps, parents, edges, queries, radius):
        met = label[np.append(asked[near], at[node])]
        least = met.min()
        other = np.unique(met[met != least])
        if other.size:
            label[np.isin(label, other)] = least
    moved = label != np.arange(len(known))
    return known[label[moved]], known[moved]


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that end where a run of equal `by` ends; rows come sorted by these."""
    held: list[pd.DataFrame] = []
    for x in batches:
        if not len(x):
            continue
        key = x[by].to_numpy()
        last = (key == key[-1]).all(axis=1)
        cut = int(np.argmax(last))  # the run that the next batch may go on with
        if held and (held[-1][by].to_numpy()[-1] == key[-1]).all():
            held.append(x)
            continue
        yield pd.concat([*held, x.iloc[:cut]], ignore_index=True)
        held = [x.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _starts(x: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each run of equal `by`."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = x[by].to_numpy()
    starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1))
    return starts, np.diff(np.append(starts, len(x)))


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row of TREE for each run of equal (k, t)."""
    for x in _runs(batches, ["k", "t"]):
        fps, out = x["fp"].to_numpy().view(np.uint64), []
        starts, sizes = _starts(x, ["k", "t"])
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            own = fps[a : a + n]
            order, parents, edges = bk_tree(own)
            out.append((own[order].tobytes(), parents.tobytes(), edges.tobytes()))
        rows = x[["k", "t", "trees", "batch"]].iloc[starts].reset_index(drop=True)
        rows["large"] = rows["trees"] > 1
        yield pd.concat((rows, pd.DataFrame(out, columns=["fps", "parents", "edges"])), axis=1)


def _descents(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Edges between the fingerprints of each row's tree and those that ask it."""
    for x in batches:
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for fps, parents, edges, asked in zip(x["fps"], x["parents"], x["edges"], x["asked"], strict=True):
            own = np.frombuffer(fps, np.uint64)
            if len(edges) == 2 and asked == fps:  # a root and its child
                found = (own[:1], own[1:]) if edges[1] <= radius else (own[:0], own[:0])
            else:
                found = forest(own, np.frombuffer(parents, np.int32), np.frombuffer(edges, np.uint8), np.frombuffer(asked, np.uint64), radius)
            a.append(found[0])
            b.append(found[1])
        yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def _in_shards(keys: DataFrame, name: str) -> DataFrame:
    """keys (k and more) of shards that hold two rows or more, with their count n."""
    sizes = staged(keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    return with_group(keys, sizes.withColumns({"own": F.col("k"), "size": F.col("n")}).select("own", "n", "size"), "k", "own", BROADCAST_ROWS).withColumnRenamed("size", "n")


def shards(fps: DataFrame, radius: int, blocks: int, most: int) -> DataFrame:
    """(k, n, fp): all shards of two or more; any two fingerprints within the radius meet in one."""
    first = block_masks(radius, blocks)
    masks = F.array(*(F.lit(signed(m)) for m in first))
    keys = fps.select("fp", F.posexplode(masks).alias("c", "mask")).select("fp", "c", F.xxhash64("c", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"))
    keys = staged(_in_shards(keys, "shards"), "keys")
    finer = F.array(*(F.array(*(F.lit(signed(m)) for m in block_masks(radius, blocks, f))) for f in first))
    again = keys.where(F.col("n") > most).select("fp", "c", F.posexplode(F.element_at(finer, F.col("c") + 1)).alias("d", "mask"))
    again = _in_shards(again.select("fp", F.xxhash64("c", "d", F.col("fp").bitwiseAND(F.col("mask"))).alias("k")), "finer-shards")
    return keys.where(F.col("n") <= most).select("k", "n", "fp").unionByName(again.select("k", "n", "fp"))


def stored_trees(fps: DataFrame, radius: int, blocks: int, most: int, nodes: int) -> tuple[DataFrame, int]:
    """The trees of all shards as a table, and the count of their batches."""
    spark = fps.sparkSession
    rows = staged(shards(fps, radius, blocks, most), "dealt")
    batches = max(1, -(-rows.count() // nodes))
    rows = rows.withColumn("trees", F.ceil(F.col("n") / most).cast("int")).withColumn("t", F.pmod(F.xxhash64("fp"), "trees").cast("int"))
    while True:  # hashing deals trees out evenly; where it does not, into more batches
        rows = rows.withColumn("batch", F.pmod(F.xxhash64("k", "t", F.lit(5)), F.lit(batches)).cast("int"))
        full = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if full <= 2 * max(nodes, most):
            break
        batches *= 2
    built = rows.repartition(partitions(spark), "k", "t").sortWithinPartitions("k", "t", "fp").select("k", "t", "trees", "batch", "fp").mapInPandas(_trees, TREE)
    path = new_path(spark, "trees")
    built.write.partitionBy("large", "batch").parquet(path)
    return spark.read.schema(TREE).parquet(path), batches


def links(fps: DataFrame, radius: int, blocks: int, most: int = MOST_IN_TREE, nodes: int = TREE_NODES) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all
    within the radius."""
    spark = fps.sparkSession
    small_batches(spark)
    trees, batches = stored_trees(fps, radius, blocks, most, nodes)
    path = new_path(spark, "links")
    for batch in range(batches):
        own = trees.where((F.col("batch") == batch) & ~F.col("large")), trees.where((F.col("batch") == batch) & F.col("large"))
        asks = own[0].unionByName(trees.where("large")).select("k", F.col("t").alias("asks"), F.col("fps").alias("asked"))
        met = asks.join(F.broadcast(own[0].unionByName(own[1]).select("k", "t", "fps", "parents", "edges")), "k").where("asks >= t")
        found = met.select("fps", "parents", "edges", "asked").mapInPandas(lambda x: _descents(x, radius), "a long, b long")
        found.where("a <> b").write.mode("append").parquet(path)
    return spark.read.schema("a long, b long").parquet(path).distinct()


def _with_least(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) with m, the least neighbour of a or a itself; and (own, n, m) of every
    a, as a stored table. The many edges of a star's centre meet its m by broadcast."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = staged(least.select(F.col("a").alias("own"), "n", F.least("a", "m").alias("m")), name)
    return with_group(edges, least, "a", "own", BROADCAST_ROWS), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node that it
    reaches. Large and small stars in turn (each keeps what is connected and
    halves heights) until nothing changes."""
    downward = lambda x: x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(downward(edges), "edges")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        both, _ = _with_least(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "least-of-all")
        large = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        met, least = _with_least(downward(staged(large, "large-star")), "least-below")
        new = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("own").alias("a"), F.col("m").alias("b")))
        edges = staged(downward(new.where("a <> b")).distinct(), "small-star")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, radius: int = 2, blocks: int = 4) -> DataFrame:
    """id, th, fp and component_id of every row."""
    rows = staged(fingerprints(docs, key, text, n), "fingerprints")
    first = staged(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    nodes = components(links(first.select("fp"), radius, blocks)).withColumnRenamed("node", "fp").join(first, "fp")
    nodes = staged(nodes, "nodes")
    ids = nodes.groupBy("root").agg(F.min("first").alias("least"))
    named = first.join(nodes.join(ids, "root").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(staged(named, "named"), "fp").select("id", "th", "fp", "component_id")


# ------------------------------------------- near duplicates by their similarity


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)), np.uint64))


def anchors(h: np.ndarray, bands: int) -> list[int]:
    """Shard keys: of each band, a hash of the least values of two mixes of h. Sets of
    Jaccard similarity s share one with probability 1 - (1 - s^2)^bands."""
    if not len(h):
        return []
    out = []
    for i in range(2 * bands):
        x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(int(((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).min()))
    return [xxhash.xxh64_intdigest(f"{i} {out[2 * i]} {out[2 * i + 1]}") - (1 << 63) for i in range(bands)]


def shingle_sets(docs: DataFrame, key: str, text: str, n: int, bands: int) -> DataFrame:
    """id, th, sig (a hash of the set), fp (its SimHash), the set's 32-bit hashes
    and the shard keys of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for t in x["t"]:
                h = shingles(t, n)
                ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                fp = int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])
                rows.append((xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63), fp, np.unique(h.astype(np.uint32)).tobytes(), anchors(h, bands)))
            yield pd.concat((x[["id", "th"]].reset_index(drop=True), pd.DataFrame(rows, columns=["sig", "fp", "own", "keys"])), axis=1)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("id"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    found = rows.mapInPandas(run, "id string, th long, sig long, fp long, own binary, keys array<long>")
    return found.withColumn("id", F.col("id").cast("long"))


#: Of the measures of similarity, the bands that shards are dealt by.
BANDS = {"jaccard": 9, "cosine": 16}


def similar_forest(fp: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, radius: int, least: float, measure: str = "jaccard") -> tuple[np.ndarray, np.ndarray]:
    """Edges (places) of stars that connect the pairs of a shard with similarity
    `least` or more. A BK-tree gives those within the radius first, as they connect
    most; pairs beyond it that are not yet connected are compared set by set too, so
    the radius decides the order of work and never the result."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    known, every = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), np.int32)
    begins = ends - sizes
    label = np.arange(len(sets))
    both = asks.any() and not asks.all()
    trees, queries = (np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)) if both else (label.copy(), label.copy())
    ratio = least * least if measure == "cosine" else least  # of the sizes of similar sets, at least

    def close(common: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        if measure == "cosine":
            return common**2 >= ratio * a * b - 1e-9
        return common >= least * (a + b - common)

    def join(root: int, near: np.ndarray) -> None:
        near = near[(label[near] != label[root]) & (sizes[near] >= ratio * sizes[root]) & (sizes[root] >= ratio * sizes[near])]
        if near.size:
            own = every[begins[root] : ends[root]]
            mark[own] = 1
            if sizes[near].sum() * 4 > len(every):
                common = np.add.reduceat(mark[every], begins)[near]
            else:
                common = np.array([mark[every[begins[q] : ends[q]]].sum() for q in near])
            mark[own] = 0
            met = near[close(common.astype(np.int64), sizes[root], sizes[near])]
            if met.size:
                at = label[np.append(met, root)]
                label[np.isin(label, at)] = at.min()

    order, parents, edges = bk_tree(fp[trees])
    for node, near in descend(fp[trees][order], parents, edges, fp[queries], radius):
        join(trees[order[node]], queries[near])
    for root in trees:  # what is still apart may be similar at any distance
        rest = queries[label[queries] != label[root]]
        join(root, rest[np.bitwise_count(fp[rest] ^ fp[root]) > radius])
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return label[moved], moved


PLACE = ["k", "i", "j"]


def _link_similar(batches: Iterator[pd.DataFrame], radius: int, least: float, measure: str) -> Iterator[pd.DataFrame]:
    for x in _runs(batches, PLACE):
        fp, side, sig = x["fp"].to_numpy().view(np.uint64), x["side"].to_numpy(), x["sig"].to_numpy()
        a, b = [], []
        for start, n in zip(*_starts(x, PLACE), strict=True):
            if n > 1:
                sets = [np.frombuffer(o, np.uint32) for o in x["own"].iloc[start : start + n]]
                root, node = similar_forest(fp[start : start + n], sets, side[start : start + n], radius, least, measure)
                a.append(sig[start + root])
                b.append(sig[start + node])
        yield pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})


def _compared(dealt: DataFrame, sets: DataFrame, *how) -> DataFrame:
    """Edges (a, b) within each (k, i, j) of dealt (k, i, j, side, fp, sig): between its
    two sides where it has both, else among all its rows."""
    rows = dealt.join(sets.hint("merge"), "sig").select(*PLACE, "side", "fp", "sig", "own")
    rows = rows.repartition(partitions(dealt.sparkSession), *PLACE).sortWithinPartitions(*PLACE)
    return rows.mapInPandas(lambda x: _link_similar(x, *how), "a long, b long").distinct()


def _dealt(keys: DataFrame, count: str, most: int) -> DataFrame:
    """keys (k, fp, sig and the column `count` of rows in a shard) cut into trees of about
    `most`: every tree meets itself and all later ones."""
    tree = F.pmod(F.xxhash64("sig"), F.greatest(F.lit(1), F.ceil(F.col(count) / most))).cast("int")
    rows = keys.withColumn("tree", tree).withColumn("to", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col(count) / most)).cast("int") - 1)))
    return rows.select("k", F.least("tree", "to").alias("i"), F.greatest("tree", "to").alias("j"), (F.col("tree") > F.col("to")).cast("int").alias("side"), "fp", "sig")


def large_edges(keys: DataFrame, sets: DataFrame, most: int, *how, pivots: int = 4) -> DataFrame:
    """Edges in shards of more than `most` sets; keys are (k, n, fp, sig).

    All rows of a shard are first held against a few of them, those whose fingerprints
    are closest to the majority of each bit: one pass, no pairs. What that connects most
    rows of the shard with is one component, whose rows need not be compared with each
    other any more; the rest is compared with itself and with that component."""
    ones = [F.sum(F.shiftright("fp", i).bitwiseAND(1)).alias(f"o{i}") for i in range(64)]
    whole = keys.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), *ones)
    major = F.lit(0).cast("long")
    for i in range(64):
        major = major.bitwiseOR(F.when(2 * F.col(f"o{i}") > F.col("rows"), F.lit(signed(1 << i))).otherwise(F.lit(0).cast("long")))
    major = staged(whole.select(F.col("k").alias("own"), F.col("rows").alias("n"), major.alias("major")), "majorities")
    rows = with_group(keys, major, "k", "own", BROADCAST_ROWS)
    rows = rows.withColumn("away", F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("major"))).alias("bits"), "sig", "fp"))
    blocks = F.ceil(F.col("n") / most).cast("int")
    taken, left = None, rows
    for _ in range(pivots):  # the closest, then the closest of the others
        best = staged(left.groupBy("k").agg(F.min("away").alias("best"), F.first("n").alias("n")), "pivot")
        taken = best if taken is None else taken.unionByName(best)
        left = with_group(left, best.select(F.col("k").alias("own"), "n", "best"), "k", "own", BROADCAST_ROWS).where(F.col("away") > F.col("best")).drop("best")
    zero = F.lit(0)
    asking = rows.withColumn("i", F.pmod(F.xxhash64("sig"), blocks).cast("int")).select("k", "i", F.col("i").alias("j"), F.lit(1).alias("side"), "fp", "sig")
    asked = taken.withColumn("i", F.explode(F.sequence(zero, blocks - 1))).select("k", "i", F.col("i").alias("j"), zero.alias("side"), F.col("best.fp").alias("fp"), F.col("best.sig").alias("sig"))
    first = staged(_compared(asking.unionByName(asked), sets, *how), "pivot-edges")
    rooted = keys.join(components(first).withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rooted = staged(rooted, "rooted")
    sizes = rooted.groupBy("k", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("k").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("main_size"), F.sum("size").alias("n"))
    rooted = staged(with_group(rooted.drop("n"), staged(sizes.withColumnRenamed("k", "own").withColumn("rows", F.col("n")), "mains"), "k", "own", BROADCAST_ROWS), "classed")
    others = rooted.where("root <> main").withColumn("others", F.col("rows") - F.col("main_size"))
    trees, queries = F.ceil((F.col("rows") - F.col("main_size")) / most).cast("int"), F.ceil(F.col("main_size") / most).cast("int")
    tree = F.pmod(F.xxhash64("sig"), trees).cast("int")
    cross = others.withColumn("i", tree).withColumn("j", F.explode(F.sequence(trees, trees + queries - 1))).select("k", "i", "j", zero.alias("side"), "fp", "sig")
    main = rooted.where("root = main AND main_size < rows").withColumn("j", trees + F.pmod(F.xxhash64("sig"), queries).cast("int")).withColumn("i", F.explode(F.sequence(zero, trees - 1))).select("k", "i", "j", F.lit(1).alias("side"), "fp", "sig")
    second = _compared(_dealt(others, "others", most).unionByName(cross).unionByName(main), sets, *how)
    return first.unionByName(second)


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least: float = 0.8, measure: str = "jaccard", radius: int = 16, bands: int | None = None, most: int = 2048) -> DataFrame:
    """id, th, sig and component_id of every row: texts are linked when the similarity of
    their sets of n-word shingles is `least` or more: Jaccard's, common over all, or the
    cosine, common over the root of the product of sizes, which is what SimHash
    estimates. A Jaccard similarity s is a cosine of 2 s / (1 + s) in sets of the same size, so
    the cosine links all that Jaccard's measure does, and more.

    At such similarities SimHash values mostly differ in up to some 16 of 64 bits,
    which no cut into blocks of bits can find cheaply; shards are therefore dealt by
    the texts' least shingle hashes. Shards with the same members are one, and only
    they carry the sets themselves. Every link that is made was checked on the sets
    (32 bits of each shingle's hash); a pair is missed only if no band deals both to one
    shard: with probability (1 - j^2)^bands for a Jaccard similarity j, which is 1e-4 at
    a Jaccard similarity of 0.8 with 9 bands, and at most 2e-4 at a cosine of 0.8 with 16."""
    bands = bands or BANDS[measure]
    rows = staged(shingle_sets(docs, key, text, n, bands), "sets")
    first = staged(rows.groupBy("sig").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.min_by("keys", "th").alias("keys")), "distinct-sets")
    keys = first.select("sig", "fp", F.explode("keys").alias("k"))
    # which members a shard has, in 128 bits
    members = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y")).where("n > 1")
    shared = staged(members.groupBy("n", "x", "y").agg(F.min("k").alias("own")).select("own", "n", F.col("n").alias("size")), "shared")
    keys = staged(with_group(keys, shared, "k", "own", BROADCAST_ROWS).withColumnRenamed("size", "n"), "shared-keys")
    sets = rows.groupBy("sig").agg(F.first("own").alias("own"))  # shuffled by sig, as the join with them is
    edges = _compared(_dealt(keys.where(F.col("n") <= most), "n", most), sets, radius, least, measure)
    large = keys.where(F.col("n") > most)
    if shared.where(F.col("n") > most).count():
        edges = edges.unionByName(large_edges(large, staged(sets, "own-sets"), most, radius, least, measure))
    nodes = staged(components(edges).withColumnRenamed("node", "sig").join(first.select("sig", "first"), "sig"), "nodes")
    ids = nodes.groupBy("root").agg(F.min("first").alias("least"))
    named = first.join(nodes.join(ids, "root").select("sig", "least"), "sig", "left").select("sig", F.coalesce("least", "first").alias("component_id"))
    return rows.select("id", "th", "sig").join(staged(named, "named"), "sig")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, least: float = 0.8, measure: str = "jaccard") -> DataFrame:
    """docs with one row of each component: that with the smallest id (of rows
    without ids or with the same: that with the smallest text hash)."""
    names = docs.columns
    rows = staged(similar_components(docs, key, text, n, least, measure), "components")
    # without any id in a component, only rows with the same set are known to be together
    rows = rows.withColumns({"g": F.col("component_id"), "h": F.when(F.col("component_id").isNull(), F.col("sig"))})
    best = rows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best")).where("n > 1")
    own = rows.join(best.withColumnsRenamed({"g": "g2", "h": "h2"}), rows["g"].eqNullSafe(F.col("g2")) & rows["h"].eqNullSafe(F.col("h2")))
    same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("th") == F.col("best.th"))
    own = staged(own.select("id", "th", same.alias("same")), "members")
    gone, again = own.where(~F.col("same")).select("id", "th").distinct(), own.where("same").groupBy("id", "th").count().where("count > 1").drop("count")
    n_gone, n_again = own.where(~F.col("same")).count(), again.count()
    cols = docs.toDF(*(f"c{i}" for i in range(len(names))))
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    cols = cols.withColumn("u", F.xxhash64(text_of(t)))

    def on(x: DataFrame):
        return cols[k].cast("long").eqNullSafe(x["id"]) & (cols["u"] == x["th"])

    cols = cols.join(small(gone, n_gone), on(gone), "left_anti")
    if n_again:  # fully repeated rows
        one = cols.join(small(again, n_again), on(again), "left_semi").dropDuplicates([k, "u"])
        cols = cols.join(small(again, n_again), on(again), "left_anti").unionByName(one)
    return cols.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
