"""SimHash near-duplicate detection with BK-trees.

Every text gets a 64-bit SimHash over word shingles. Distinct fingerprints are dealt into shards by
the value of bit blocks: with ``b`` blocks and radius ``r``, two fingerprints within ``r`` bits agree
on at least ``b - r`` blocks, so each choice of ``b - r`` blocks is one family of shards and no link is lost.
Each shard is a BK-tree (children keyed by integer Hamming distance to the parent); a search follows
only edges within the radius. A shard above ``shard_rows`` is cut into parts, and each pair of parts is
searched on its own, so no task needs a whole hot shard. Shards return a spanning forest of their links,
never all pairs; connected components come from alternating star contractions on stored tables.

Nulls and texts without words have fingerprint zero and link like any other. A null doc_id keeps its
row; its component is that of its fingerprint, null if no row there has an id. Repeated rows stay.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

BITS = 64


def fingerprints_of(text: pa.Array, shingle: int = 4) -> np.ndarray:
    """SimHash of each text: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    data, start, end, offsets = K.shingle_spans(K.words(text, lower=True), shingle)
    return majority(K.xxh64(data, start, end), offsets)


def majority(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bitwise majority of each run of hashes; four 16-bit counters at a time, in runs of at most 65535."""
    total = np.diff(offsets)
    parts = np.maximum(-(-total // 65535), 1)
    cuts = np.repeat(offsets[:-1], parts) + 65535 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    cuts = np.r_[cuts, offsets[-1:]]
    rows = np.r_[0, np.cumsum(parts)]
    out = np.zeros(len(total), np.uint64)
    lanes = np.uint64(0x0001000100010001)
    for k in range(16):
        packed = K.row_sums((h >> np.uint64(k)) & lanes, cuts)
        for lane in range(4):
            counts = K.row_sums(((packed >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), rows)
            out |= (2 * counts > total).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    keep = K.columns_of(docs, "doc_id", "text", *extra)
    schema = keep.drop("text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            fp = fingerprints_of(b.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in ("doc_id", *extra)], pa.array(fp.view(np.int64))], names=["doc_id", *extra, "fp"])

    return keep.mapInArrow(run, schema)


class Forest:
    """BK-trees of many shards, held as flat arrays and built level by level.

    ``slots`` is sorted: node * 65 + distance to its child, so the children of a node whose edges lie
    in a range of distances are one contiguous run.
    """

    def __init__(self, fp: np.ndarray, shard: np.ndarray):
        """fp: distinct in a shard; shard: sorted shard numbers from 0. The first of a shard is its root."""
        self.fp = fp
        self.root = np.searchsorted(shard, np.arange(int(shard[-1]) + 1 if len(shard) else 0))
        node = self.root[shard]
        left = np.flatnonzero(node != np.arange(len(fp)))
        node = node[left]
        slots, child = [], []
        while len(left):
            slot = node * 65 + np.bitwise_count(fp[node] ^ fp[left])
            found, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(found)
            child.append(left[first])
            node = left[first][inverse]
            rest = node != left
            left, node = left[rest], node[rest]
        self.slots = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        self.child = np.concatenate(child) if child else np.zeros(0, np.int64)
        order = np.argsort(self.slots, kind="stable")
        self.slots, self.child = self.slots[order], self.child[order]

    def search(self, query: np.ndarray, shard: np.ndarray, radius: int, block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, tree index) within ``radius`` bits, a block of queries at a time."""
        for a in range(0, len(query), block):
            q, node = np.arange(a, min(a + block, len(query))), self.root[shard[a : a + block]]
            while len(q):
                d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                lo = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0), "left")
                hi = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), "right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                q, node = np.repeat(q, n), self.child[at]


def _roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def contract(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of linked nodes; every node then points at the smallest index of its class."""
    while True:
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return parent
        np.minimum.at(parent, hi, lo)
        parent = _roots(parent)


def shard_links(fp: np.ndarray, shard: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Index of the class root of each row; rows (sorted by shard, side, fp) link within a shard. side 1: queries, 0: tree rows, 2: both."""
    parent = np.arange(len(fp))
    same = np.flatnonzero((shard[1:] == shard[:-1]) & (fp[1:] == fp[:-1]) & (side[1:] == side[:-1])) + 1
    parent = contract(parent, same, same - 1)
    joined = np.zeros(len(fp), bool)
    joined[same] = True
    tree = np.flatnonzero((side != 1) & ~joined)  # rows joined to an equal fingerprint are found with it
    forest = Forest(fp[tree], shard[tree])
    if not len(tree):
        return parent
    top = np.full(int(shard[-1]) + 1, -1)
    top[shard[tree][::-1]] = tree[::-1]  # the root of each shard's tree
    rooted = np.flatnonzero((top[shard] >= 0) & (np.bitwise_count(fp ^ fp[top[shard]]) <= radius))
    parent = contract(parent, rooted, top[shard][rooted])
    apart = parent != parent[top[shard]]  # from the root's class, which holds what it joins already
    mixed = np.bincount(shard, side != 2, len(top)) > 0
    open_shard = np.bincount(shard, apart, len(top)) > 0
    ask = np.flatnonzero((side != 0) & ~joined & np.where(mixed[shard], open_shard[shard], apart) & (top[shard] >= 0))
    for q, t in forest.search(fp[ask], shard[ask], radius, 1 << 16 if radius < 8 else 1 << 10):
        a, b = ask[q], tree[t]
        new = parent[a] != parent[b]
        parent = contract(parent, a[new], b[new])
    return parent


def block_keys(points: DataFrame, radius: int, blocks: int) -> DataFrame:
    """One row for each point and family of shards, with its key: the values of ``blocks - radius`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    family = F.explode(F.array(*[F.struct(F.lit(i).alias("family"), F.lit(m).alias("mask")) for i, m in enumerate(masks)]))
    return points.select("*", family.alias("f")).select("node", "fp", F.col("f.family").alias("family"), F.col("fp").bitwiseAND(F.col("f.mask")).alias("value"))


def blocks_for(n: int, radius: int, expected: int = 256) -> int:
    """Blocks, so that a shard of ``n`` evenly spread fingerprints holds ``expected`` or fewer."""
    for b in range(radius + 1, 2 * radius + 2):
        if n >> (BITS * (b - radius) // b) <= expected:
            return b
    return 2 * radius + 2


KEYS = ("family", "value", "part", "other")


def dealt(held: DataFrame) -> DataFrame:
    """Rows of ``held`` with part, other and side: shards of several ``parts`` are cut into them, and each pair of parts is a shard."""
    held = held.withColumn("own", F.pmod(F.xxhash64("node", "family"), F.col("parts")).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("part"), F.greatest(o, F.col("own")).alias("other"), F.when(o == F.col("own"), 2).when(o > F.col("own"), 0).otherwise(1).alias("side")),
    )
    return held.select("node", "fp", "family", "value", F.explode(pair).alias("p")).select("node", "fp", "family", "value", "p.part", "p.other", "p.side")


def searched(shards: DataFrame, radius: int) -> DataFrame:
    """Spanning links (a, b) of each shard, within ``radius`` bits. shards: node, fp and KEYS with side."""

    def out(table: pa.Table) -> pa.RecordBatch:
        fp, node = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy()
        new = np.zeros(len(fp), bool)
        for k in KEYS:
            v = table[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        root = shard_links(fp, np.cumsum(new), table["side"].to_numpy(), radius)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[root[linked]]), pa.array(node[linked])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:  # sorted by shard; handled in runs of whole shards
            held.append(b)
            rows += b.num_rows
            if rows < 1 << 16:
                continue
            table = pa.Table.from_batches(held)
            last = np.logical_and.reduce([(v := table[k].to_numpy()) == v[-1] for k in KEYS])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield out(table.slice(0, cut).combine_chunks())
            held, rows = table.slice(cut).to_batches(), len(table) - cut
        if rows:
            yield out(pa.Table.from_batches(held).combine_chunks())

    partitions = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(partitions, *KEYS).sortWithinPartitions(*KEYS, "side", "fp", "node").mapInArrow(run, "a long, b long")


def links(points: DataFrame, radius: int = 4, blocks: int | None = None, shard_rows: int = 4096) -> DataFrame:
    """Spanning links (a, b), a != b, between nodes whose fingerprints are within ``radius`` bits. points: node, fp."""
    keyed = block_keys(points, radius, blocks or blocks_for(points.count(), radius))
    large = K.stored(keyed.groupBy("family", "value").count().where(F.col("count") > shard_rows).select("family", "value", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts")))
    if large.isEmpty():
        return searched(keyed.select("*", F.lit(0).alias("part"), F.lit(0).alias("other"), F.lit(2).alias("side")), radius)
    return searched(dealt(keyed.join(large, ["family", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))), radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node that it reaches.

    Large-star and small-star contractions in turn, until a round changes nothing; each round is stored.
    """
    pair = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = K.stored(ordered)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = tuple(mark)
        both = now.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v")
        star = star.distinct()
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = K.stored(small.distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, shard_rows: int = 4096) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) of every row, and the rows of its exact class."""
    rows = K.stored(fingerprints(docs, shingle))
    classes = K.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("class_rows")))
    points = classes.select(F.col("fp").alias("node"), "fp")
    comps = K.stored(components(links(points, radius, shard_rows=shard_rows)).withColumnRenamed("node", "fp"))
    tops = comps.select("root").distinct().join(classes.select(F.col("fp").alias("root"), "first_id"), "root")
    members = comps.join(classes.select("fp", "first_id"), "fp").select("root", "first_id").union(tops)
    ids = members.groupBy("root").agg(F.min("first_id").alias("low_id"))
    named = classes.join(comps, "fp", "left").withColumn("root", F.coalesce("root", "fp")).join(ids, "root", "left").select("fp", F.coalesce("low_id", "first_id").alias("component_id"), "class_rows")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "class_rows")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(K.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_rows")
