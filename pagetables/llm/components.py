"""Links between nodes: verified star by star within buckets, then joined to components.

Nodes are 64-bit content keys. A bucket of n nodes is not expanded to its pairs: each round
compares its nodes with some leaders, and only those that are not yet in a leader's component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetables.llm import numtext as nt
from pagetables.llm.common import drop, released, settle

#: A Bloom filter of this many 64-bit words (2 MB) whatever the number of keys. With very many
#: keys it lets more through, and the exact join after it drops them.
BLOOM_WORDS = 1 << 18

#: Links in a round, as a share of its comparisons, below which no further round of leaders is made and
#: the bands that are left are searched block by block.
MIN_YIELD = 0.01
#: Bytes of text in a block of a band that is searched in memory, and what a node counts besides its text.
BLOCK, NODE_BYTES = 2_000_000, 200

#: Edges that one task of union-find takes, 16 bytes each.
EDGES_PER_TASK = 500_000

EDGES = "a long, b long"


def _union(edges: DataFrame) -> DataFrame:
    """Union-find over the distinct edges of each partition of EDGES_PER_TASK: its components as stars
    (node, smallest node)."""
    tasks = -(-edges.count() // EDGES_PER_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        parent = list(range(len(nodes)))
        for x, y in zip(index[:len(a)].tolist(), index[len(a):].tolist(), strict=True):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
        root = np.arange(len(nodes))
        for x in range(len(nodes)):  # parents come before their children
            root[x] = root[parent[x]]
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])
    return edges.distinct().coalesce(max(1, tasks)).mapInArrow(released(run), EDGES)


def _is_forest(edges: DataFrame) -> bool:
    """Whether every edge is (node, root): no node hangs on two others, and no root hangs on any."""
    nothing = F.lit(None).cast("long")
    seen = edges.select(F.col("a").alias("n"), F.col("b").alias("on"), nothing.alias("root"))
    seen = seen.union(edges.select("b", nothing, F.lit(1).cast("long")))
    found = seen.groupBy("n").agg(F.min("on").alias("low"), F.max("on").alias("high"), F.max("root").alias("root"))
    return found.filter("low <> high OR (low IS NOT NULL AND root IS NOT NULL)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for all nodes of the edges a, b but the roots.

    Distributed union-find: each partition unites its own edges; then large and small stars
    (Kiveris et al. 2014) hang the nodes on ever smaller ones, with the edges united again in
    each partition between, until every node hangs on a root; about log(n) rounds. The smallest neighbour is
    a partial aggregate, and the joins are between plain exchanges, which Spark splits for hubs.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = settle(_union(links))
    while not _is_forest(current):
        both = current.union(current.select("b", "a"))
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = settle(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        drop(least)
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")))
        star = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        before, star = [current, least, large], settle(star)
        current = settle(_union(star))
        drop(star, *before)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()


def bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter of column key; two bits for each key, gathered word by word."""
    place = F.xxhash64("key")
    bits = keys.select(F.explode(F.array(place, F.xxhash64(place))).alias("h"))
    words = bits.groupBy(F.pmod("h", F.lit(BLOOM_WORDS)).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(h, 24), 64) AS int))")).alias("v"))
    out = np.zeros(BLOOM_WORDS, np.int64)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["v"].to_numpy()
    return out


def _members(sketches: DataFrame) -> DataFrame:
    """band and key of the nodes in bands that two nodes or more have."""
    rows = sketches.select("key", F.explode("bands").alias("band"))
    shared = settle(rows.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("band"))
    # most bands have one node: a filter drops nearly all of those before the rows are shuffled again
    passes = sketches.sparkSession.sparkContext.broadcast(bloom(shared.select(F.col("band").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1)
            key = np.repeat(batch.column(0).to_numpy(), np.diff(bands.offsets.to_numpy()))
            band = bands.flatten().to_numpy()
            hit = in_bloom(passes.value, band)
            yield pa.RecordBatch.from_arrays([pa.array(band[hit]), pa.array(key[hit])], names=["band", "key"])
    found = settle(sketches.select("key", "bands").mapInArrow(released(run), "band long, key long").join(shared, "band").distinct())
    drop(shared)
    return found


def _resketched(held: DataFrame, finer: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """key and bands (a row of finer's result each) of held (key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.slice(at, 5000)
                bands = finer(part.column(1))
                counts = np.full(len(part), bands.shape[1], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), nt.lists(bands.ravel().view(np.int64), counts, pa.int64())], names=["key", "bands"])
    return settle(held.select("key", "text").mapInArrow(released(run), "key long, bands array<long>"))


#: Row, shingle and weight of each distinct shingle of a column of texts.
Shingles = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def in_prefix(row: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """Which entries, ordered by row and then by any order of tokens that all rows share, are in the prefix of their row.

    A prefix ends where what comes after it weighs less than threshold of the row; so two rows of that similarity have
    a token of both prefixes in common, whatever the order is.
    """
    if not len(row):
        return np.zeros(0, bool)
    total = np.bincount(row, weight)
    before = np.cumsum(weight) - weight
    rest = total[row] - (before - before[np.searchsorted(row, row)])
    return rest >= threshold * total[row] * (1 - 1e-9)


def similar_in_block(texts: pa.Array, root: np.ndarray, lead: np.ndarray, other: np.ndarray, shingles: Shingles,
                     threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts, left among lead and right among other (masks), of different roots and a similarity of threshold
    or more: for each of lead, one such partner of each root that has any.

    Only texts with a token of both prefixes in common are compared; tokens are ordered by how many of the texts have them.
    """
    row, token, weight = shingles(texts)
    n = len(texts)
    _, token, counts = np.unique(token, return_inverse=True, return_counts=True)
    order = np.lexsort((token, counts[token], row))
    row, token, weight = row[order], token[order], weight[order]
    total = np.bincount(row, weight, n)
    first = np.searchsorted(row, np.arange(n + 1))
    prefix = in_prefix(row, weight, threshold)
    listed = np.flatnonzero(prefix & other[row])
    listed = listed[np.argsort(token[listed], kind="stable")]
    start = np.searchsorted(token[listed], np.arange(len(counts) + 1))
    held = np.zeros(len(counts))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in np.flatnonzero(lead):
        mine = slice(first[a], first[a + 1])
        tokens = token[mine][prefix[mine]]
        at = _ranges(start[tokens], start[tokens + 1])
        near = np.unique(row[listed[at]])
        near = near[(root[near] != root[a]) & (np.minimum(total[near], total[a]) >= np.maximum(total[near], total[a]) * (threshold * (1 - 1e-9)))]
        if not len(near):
            continue
        held[token[mine]] = weight[mine]
        at = _ranges(first[near], first[near + 1])
        place = np.repeat(np.arange(len(near)), first[near + 1] - first[near])
        common = np.bincount(place, np.minimum(held[token[at]], weight[at]), len(near))
        held[token[mine]] = 0
        near = near[common >= threshold * (1 - 1e-9) * (total[near] + total[a] - common)]
        near = near[np.unique(root[near], return_index=True)[1]]
        left.append(np.full(len(near), a))
        right.append(near)
    return np.concatenate(left), np.concatenate(right)


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers from start[i] to before stop[i], one i after another."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair of key and other once, whichever way round."""
    ends = F.struct(F.least("key", "other"), F.greatest("key", "other"))
    return pairs.withColumn("ends", ends).groupBy("ends").agg(F.min(F.struct("key", "other")).alias("p")).select("p.key", "p.other")


def _rest(placed: DataFrame, held: DataFrame, shingles: Shingles, threshold: float) -> DataFrame:
    """key and other: pairs of placed (band, key, root) that share a band and have a similarity of threshold, enough
    to join all components that such pairs join.

    One node of such a pair is outside the band's largest component. The nodes outside and all nodes of a band are
    dealt into blocks of about BLOCK bytes, and each block of the one is compared with each of the other in a task's memory;
    only links leave it.
    """
    cost = held.select("key", (F.octet_length("text") + NODE_BYTES).cast("long").alias("cost"))
    sizes = placed.join(cost, "key").groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("n", "root", "cost")).alias("top"), F.sum("cost").alias("all"))
    blocks = [F.ceil(c / F.lit(BLOCK)).cast("int") for c in (F.col("all") - F.col("top.cost"), F.col("all"))]
    sizes = sizes.select("band", F.col("top.root").alias("top"), blocks[0].alias("leads"), blocks[1].alias("others"))
    own = [F.pmod(F.xxhash64("key", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("leads", "others"))]
    rows = placed.join(sizes, "band").withColumn("i_own", F.when(F.col("root") != F.col("top"), own[0])).withColumn("j_own", own[1])
    cells = F.transform(F.sequence(F.lit(0), F.col("leads") - 1), lambda i: F.struct(i.alias("i"), F.col("j_own").alias("j")))
    more = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.col("i_own").alias("i"), j.alias("j")))
    cells = F.when(F.col("i_own").isNull(), cells).otherwise(F.array_union(cells, more))
    rows = rows.select("band", "key", "root", "i_own", "j_own", F.explode(cells).alias("cell")).select(
        "band", "cell.i", "cell.j", "key", "root", F.col("i_own").eqNullSafe(F.col("cell.i")).alias("lead"),
        (F.col("j_own") == F.col("cell.j")).alias("other"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, root, lead, other = (table[c].to_numpy() for c in ("key", "root", "lead", "other"))
        a, b = similar_in_block(table["text"].combine_chunks(), root, lead, other, shingles, threshold)
        return pa.table({"key": key[a], "other": key[b]})
    return _once(rows.join(held, "key").groupBy("band", "i", "j").applyInArrow(run, "key long, other long"))


def link(sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame],
         shingles: Shingles, threshold: float, finer: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """Components of the nodes that verified links join: node, root (all but the roots).

    sketches: key, bands (array of long; nodes with a band in common may be linked); a key may stand
    in several rows. texts(keys) gives key, text for the keys that are in shared bands.
    verify(pairs) takes key, text, other, other_text and returns the pairs (a, b) that are linked.

    shingles gives the weighted sets whose Jaccard similarity verify holds against threshold.

    finer gives other bands for the texts of the nodes in shared bands, one row of unsigned 64-bit numbers each. Where it
    is given, nodes are compared that have one of those in common too: cheap bands of few minima find the nodes that may have a
    partner at all, bands of more minima, worked out for these alone, say which.

    The nodes of a band are put in the order of a hash. In round k, the next 2^k of each band with
    nodes of several components are compared with all its nodes outside their components. So a band of
    up to 4 nodes is compared in full in the first two rounds, one of 8 in three, and so
    on. After a round, the second or later, in which fewer than MIN_YIELD of the comparisons gave a
    link, all pairs that are left are searched by _rest(). So any two nodes of a band that
    verify() links are in one component in the end.
    """
    members = _members(sketches)
    held = settle(texts(members.select("key").distinct()))
    if finer:
        fine = _resketched(held, finer)
        drop(members)
        members = _members(fine)
        drop(fine)
    labels = settle(sketches.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("root")))
    placed, start, size = members.withColumn("root", F.col("key")), 0, 1

    def compared(pairs: DataFrame) -> tuple[DataFrame, int]:
        full = pairs.join(held, "key").join(held.select(F.col("key").alias("other"), F.col("text").alias("other_text")), "other")
        found = settle(verify(full.select("key", "text", "other", "other_text")))
        return found, found.count()
    order = Window.partitionBy("band").orderBy(F.xxhash64("key"), "key")
    while True:
        leaders = placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= start + size).filter(F.col("rank") > start)
        leaders = leaders.select("band", F.col("key").alias("other"), F.col("root").alias("its"))
        pairs = placed.join(leaders, "band").filter("root <> its").select("key", "other")
        pairs = settle(_once(pairs))  # two leaders meet both ways
        found, links = compared(pairs)
        if links:
            before, labels = labels, settle(components(labels.toDF("a", "b").union(found)))
            drop(before)
        start, size = start + size, 2 * size
        last = start >= 3 and links < MIN_YIELD * pairs.count()
        drop(pairs, found)
        now = placed.select("band", "key").join(labels, placed["key"] == labels["node"], "left").select(
            "band", "key", F.coalesce("root", "key").alias("root"))
        now = settle(now)
        bands = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        # what is left to compare: several components, and nodes that were not compared with all others
        bands = settle(bands.filter((F.col("low") != F.col("high")) & (F.col("n") > start + 1)).select("band"))
        before, placed = placed, settle(now.join(bands, "band"))
        drop(before, now, bands)
        if placed.isEmpty():
            return labels
        if last:
            found, links = compared(settle(_rest(placed, held, shingles, threshold)))
            return settle(components(labels.toDF("a", "b").union(found))) if links else labels


def in_bloom(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may have. Hashes as Spark's xxhash64 of a long does."""
    first = _xxhash64_long(keys.astype(np.uint64))
    hit = np.ones(len(keys), bool)
    for h in (first, _xxhash64_long(first)):
        h = h.astype(np.int64)
        word = filter_[np.mod(h, BLOOM_WORDS)]
        hit &= (word >> np.mod(h >> 24, 64)) & 1 == 1
    return hit


def _xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Published xxHash64 of 8 bytes."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(v: np.ndarray, n: int) -> np.ndarray:
        return v << np.uint64(n) | v >> np.uint64(64 - n)
    h = np.full(len(x), np.uint64(seed)) + p5 + np.uint64(8)
    h = turn(h ^ turn(x * p2, 31) * p1, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)

