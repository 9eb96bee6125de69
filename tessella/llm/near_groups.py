"""Near-duplicate groups of whole texts: SimHash BK-trees in shards of MinHash bands, then exact shingle sets.

A text is the set of its lower-cased five-word shingles (fewer words: the whole sequence). Texts that share a band of
MinHash values meet in a shard; a BK-tree over the shingles' SimHash links those within ``RADIUS`` bits and emits a
spanning forest. The connected components of these links are neighbourhoods: every pair that may be ``SIMILAR``
lies in one. Each text then moves once, to its neighbourhood, where exact similarities decide; pairs that
a class joins already are not compared, and a neighbourhood of n texts gives n - 1 links at most.

A neighbourhood above ``PART_SHINGLES`` is cut into parts. Its parts are decided alone first; only if more than one class
remains, the texts outside its largest class visit every part, so no pair of different classes is left out.

A pair of similarity s shares a band with probability 1 - (1 - s ** 4) ** 24, wherever the texts differ: 0.999996 at
0.8. Two texts of similarity 0.8 differ in 9.6 of 64 bits on average, with a standard deviation of 2.9.

Equal texts (two independent 64-bit hashes) are one class. Nulls are empty texts; texts without words are near copies
of each other. Of each group the row of the smallest doc_id stays, a null doc_id only if the group has no
other; of rows that repeat doc_id and text one stays. An empty table gives an empty result. All columns pass through,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .simhash_dedup import Forest, components, contract, dealt, majority, searched

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 24
BANDS, BAND_ROWS = 24, 4
#: Shingles of a neighbourhood that one task decides at once, and rows of a band's shard.
PART_SHINGLES, SHARD_ROWS = 4_000_000, 4096
#: Neighbourhoods above this many texts try PIVOTS texts against all others before the tree is searched.
LARGE, PIVOTS = 64, 24
FACTORS = K.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    w = K.words(text, lower=True)
    hashes = K.hash_values(w.vocab)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    count = w.counts
    size = np.minimum(count, SHINGLE)
    number = np.where(count > 0, count - size + 1, 0)
    row = np.repeat(np.arange(len(count)), number)
    at = np.arange(len(row)) - np.repeat(np.cumsum(number) - number - w.offsets[:-1], number)
    h = size[row].astype(np.uint64)
    for k in range(SHINGLE):
        live = np.flatnonzero(size[row] > k)
        h[live] = K.mix(h[live] ^ hashes[at[live] + k]) + np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(count) + 1))


def band_keys(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS keys of BAND_ROWS MinHash values of each set; all sets without shingles have the same."""
    keys = np.ones((len(offsets) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k, factor in enumerate(FACTORS):
            low = np.minimum.reduceat(grams * factor, offsets[:-1][full])
            keys[full, k // BAND_ROWS] = K.mix(keys[full, k // BAND_ROWS] ^ low) + np.uint64(1)
    return keys


def features(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the text, fp, bands and the number of distinct shingles of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, limit=2 << 20):  # shingles take about 30 bytes for each byte of text
            grams, offsets = shingle_sets(b.column("text"))
            bands = band_keys(grams, offsets).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h1"), b.column("h2"), pa.array(majority(grams, offsets).view(np.int64)), pa.array(list(bands), pa.list_(pa.int64())), pa.array(np.diff(offsets).astype(np.int64))],
                names=["doc_id", "h1", "h2", "fp", "bands", "shingles"],
            )

    return base.mapInArrow(run, "doc_id long, h1 long, h2 long, fp long, bands array<long>, shingles long")


def alike(a: np.ndarray, b: np.ndarray, grams: np.ndarray, offsets: np.ndarray, similar: float, block: int = 1 << 21) -> np.ndarray:
    """Whether the sets of rows a[i] and b[i] have a Jaccard similarity of ``similar`` or more. grams: numbers, sorted in each row."""
    size = np.diff(offsets)
    na, nb = size[a], size[b]
    out = np.minimum(na, nb) >= similar * np.maximum(na, nb)
    todo = np.flatnonzero(out)
    top = int(grams.max()) + 1 if len(grams) else 1
    cost = np.cumsum(na[todo] + nb[todo]) // block
    for part in np.split(todo, np.flatnonzero(np.diff(cost)) + 1) if len(todo) else ():
        pair = np.arange(len(part))
        left, right = (np.repeat(pair, size[x]) * top + grams[np.repeat(offsets[x], size[x]) + np.arange(int(size[x].sum())) - np.repeat(np.cumsum(size[x]) - size[x], size[x])] for x in (a[part], b[part]))
        if not len(left) or not len(right):
            continue
        at = np.searchsorted(left, right)
        at[at == len(left)] = 0
        both = np.bincount(np.repeat(pair, size[b[part]])[left[at] == right], minlength=len(part))
        out[part] = both >= similar * (na[part] + nb[part] - both)
    return out


def decide(group: np.ndarray, fp: np.ndarray, grams: np.ndarray, offsets: np.ndarray, known: np.ndarray, similar: float = SIMILAR, radius: int = RADIUS) -> np.ndarray:
    """The class root (a row number) of each row; rows are sorted by group, and links stay in a group.

    Rows of one group and equal ``known`` are one class from the start. Pairs within ``radius`` bits are compared exactly
    unless a class holds both already.
    """
    n = len(group)
    _, grams = np.unique(grams, return_inverse=True)
    size = np.diff(offsets)
    order = np.lexsort((known, group))
    same = (group[order][1:] == group[order][:-1]) & (known[order][1:] == known[order][:-1])
    parent = contract(np.arange(n), order[:-1][same], order[1:][same])
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        if hi - lo <= LARGE:
            continue
        row = np.repeat(np.arange(lo, hi), size[lo:hi])
        own = grams[offsets[lo] : offsets[hi]]
        mark = np.zeros(int(own.max()) + 1 if len(own) else 1, bool)
        tried = np.zeros(hi - lo, bool)
        for k in range(PIVOTS):
            roots, held = np.unique(parent[lo:hi], return_counts=True)
            if len(roots) == 1:
                break
            choice = np.flatnonzero(~tried & ((parent[lo:hi] == roots[held.argmax()]) if k % 2 else (parent[lo:hi] != roots[held.argmax()])))
            if not len(choice):
                continue
            p = lo + int(choice[len(choice) // 2])
            tried[p - lo] = True
            mark[grams[offsets[p] : offsets[p + 1]]] = True
            both = np.bincount(row[mark[own]] - lo, minlength=hi - lo)
            mark[grams[offsets[p] : offsets[p + 1]]] = False
            near = np.flatnonzero(both >= similar * (size[lo:hi] + size[p] - both)) + lo
            parent = contract(parent, near, np.full(len(near), p))
    largest = np.zeros(n, bool)
    held = np.bincount(parent, minlength=n)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        if hi - lo > LARGE:  # pairs inside the largest class need no search
            largest[lo:hi] = parent[lo:hi] == lo + int(held[lo:hi].argmax())
    shard = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    by = np.lexsort((fp, shard))
    distinct = by[np.r_[True, (fp[by][1:] != fp[by][:-1]) | (shard[by][1:] != shard[by][:-1])]] if n else by
    run = np.cumsum(np.r_[True, (fp[by][1:] != fp[by][:-1]) | (shard[by][1:] != shard[by][:-1])]) - 1 if n else by
    starts = np.searchsorted(run, np.arange(len(distinct) + 1))
    forest = Forest(fp[distinct], shard[distinct])
    ask = np.flatnonzero(~largest)
    for q, t in forest.search(fp[ask], shard[ask], radius, 512):
        many = starts[t + 1] - starts[t]  # all rows of a tree node's fingerprint
        a, b = np.repeat(ask[q], many), by[np.repeat(starts[t], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            new = parent[x] != parent[y]
            x, y = x[new], y[new]
            good = alike(x, y, grams, offsets, similar)
            parent = contract(parent, x[good], y[good])
    return parent


def exact_links(placed: DataFrame) -> DataFrame:
    """Links (a, b) between nodes: a spanning forest of each part of a neighbourhood. placed: grp, part, node, fp, known, text."""

    def out(table: pa.Table) -> pa.RecordBatch:
        group, part, node = (table[c].to_numpy() for c in ("grp", "part", "node"))
        new = np.zeros(len(node), bool)
        new[1:] = (group[1:] != group[:-1]) | (part[1:] != part[:-1])
        grams, offsets = shingle_sets(table["text"].combine_chunks())
        root = decide(np.cumsum(new), table["fp"].to_numpy().view(np.uint64), grams, offsets, table["known"].to_numpy())
        linked = np.flatnonzero(node != node[root])
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by part of a neighbourhood; decided in runs of whole ones
            for b in K.slices(iter([batch]), limit=4 << 20):
                held.append(b)
                size += b.num_rows + b.nbytes
                if size < 4 << 20:
                    continue
                table = pa.Table.from_batches(held)
                last = np.logical_and.reduce([(v := table[c].to_numpy()) == v[-1] for c in ("grp", "part")])
                cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                if cut:
                    yield out(table.slice(0, cut))
                    held = [pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(cut, len(table)))).combine_chunks() for c in table.columns], schema=table.schema)]
                    size = held[0].num_rows + held[0].nbytes
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    partitions = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("grp", "part", "node", "fp", "known", "text").repartition(partitions, "grp", "part").sortWithinPartitions("grp", "part", "node").mapInArrow(run, "a long, b long")


def neighbourhoods(classes: DataFrame) -> DataFrame:
    """(node, root) of every node with a neighbour: components of the links within RADIUS bits in shards of bands."""
    keyed = classes.select("node", "fp", F.posexplode("bands").alias("family", "value"))
    shared = K.stored(keyed.groupBy("family", "value").count().where("count > 1").select("family", "value", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("parts")))
    return K.stored(components(K.stored(searched(dealt(keyed.join(shared, ["family", "value"])), RADIUS))))


def near_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ``classes`` that join exactly the texts of similarity SIMILAR or more, directly or through others."""
    near = neighbourhoods(classes)
    found = near.union(near.select("root", "root").distinct())
    members = K.stored(found.join(classes.drop("bands"), "node").withColumnRenamed("root", "grp"))
    parts = K.stored(members.groupBy("grp").agg(F.ceil(F.sum("shingles") / PART_SHINGLES).cast("int").alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1))))
    members = members.join(parts, "grp").withColumn("home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    text = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.col("doc_id").cast("long").alias("tid"), text.alias("text"))
    own = lambda rows: texts.join(rows, (texts["t1"] == rows["h1"]) & (texts["t2"] == rows["h2"]) & texts["tid"].eqNullSafe(rows["first_id"]))
    links = K.stored(exact_links(own(members.select("grp", F.col("home").alias("part"), "node", "fp", F.col("node").alias("known"), "h1", "h2", "first_id"))))
    large = members.where("parts > 1")
    if large.isEmpty():
        return links
    comps = K.stored(components(links))
    rooted = K.stored(large.join(comps, "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root"))
    sizes = rooted.groupBy("grp", "known").count().groupBy("grp").agg(F.max_by("known", F.struct("count", "known")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    again = rooted.join(K.stored(sizes), "grp").select("*", F.explode(F.when(F.col("known") == F.col("most"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("part"))
    more = exact_links(own(again.select("grp", "part", "node", "fp", "known", "h1", "h2", "first_id")))
    return K.stored(links.union(more).union(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near copies: the one of the smallest doc_id."""
    rows = K.stored(features(docs))
    classes = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("fp", "bands", "shingles")])
    classes = K.stored(classes.withColumn("node", F.monotonically_increasing_id()))  # numbered once, as written
    comps = K.stored(components(near_links(docs, classes)))
    tops = comps.select(F.col("root").alias("node")).distinct()
    members = comps.unionByName(tops.withColumn("root", F.col("node"))).join(classes.select("node", "first_id"), "node")
    chosen = members.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("c")).select("c.node")
    dropped = members.select("node").join(chosen, "node", "left_anti")
    single = K.stored(classes.join(dropped, "node", "left_anti").select("h1", "h2", "first_id"))
    again = rows.groupBy("h1", "h2", "doc_id").count().where("count > 1").select("h1", "h2", F.col("doc_id").alias("first_id"))
    again = K.stored(again.join(single, (again["h1"] == single["h1"]) & (again["h2"] == single["h2"]) & again["first_id"].eqNullSafe(single["first_id"]), "left_semi"))
    mark = uuid.uuid4().hex
    one, two = f"h1_{mark}", f"h2_{mark}"
    text = F.coalesce(docs["text"], F.lit(""))
    marked = docs.select("*", F.xxhash64(text).alias(one), F.xxhash64(F.lit(7), text).alias(two))
    match = lambda left, right: (left[one] == right["h1"]) & (left[two] == right["h2"]) & left["doc_id"].cast("long").eqNullSafe(right["first_id"])
    kept = marked.join(single, match(marked, single), "left_semi")
    if again.isEmpty():
        return kept.drop(one, two)
    twice = kept.join(again, match(kept, again), "left_semi").dropDuplicates([one, two])
    return kept.join(again, match(kept, again), "left_anti").union(twice).drop(one, two)
