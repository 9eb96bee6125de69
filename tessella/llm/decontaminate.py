"""Benchmark decontamination by SimHash windows.

Every benchmark item of L words has a SimHash over its five-word shingles, weighted by how often they occur.
In a document, windows of L words are fingerprinted alike. Multi-index Hamming blocks (the 64 bits in
``BLOCKS`` blocks, each searched within ``RADIUS // BLOCKS`` bits) find every item fingerprint within
``RADIUS``; exact weighted-shingle similarity then decides: the weight of shingles that window
and item share over the item's weight, at least ``SIMILARITY``. Windows without a shingle of
any item have similarity zero and are not fingerprinted; that loses nothing.

The benchmark is taken in blocks of ``BLOCK_ITEMS`` items, each sent to the workers once, whatever its size; one scan
of the documents serves ``SCAN_BLOCKS`` blocks, so a text is read and split into words once for 80000 items.
Items of fewer than five words are one shingle of all their words; items without words match nothing;
items without an id are searched like others and reported with a null item_id.
Null texts are empty; rows that repeat are reported each; equal scores take the earliest window; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .simhash_dedup import majority

SHINGLE, SIMILARITY, RADIUS, BLOCKS, BLOCK_ITEMS = 5, 0.8, 22, 7, 5000
#: Blocks of items that one scan of the documents looks for.
SCAN_BLOCKS = 16
EDGES = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]


def gram_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words i..i+size-1 for every i that has so many after it."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = K.mix(h ^ word_hash[k : k + n]) + np.uint64(0x9E3779B97F4A7C15)
    return h


class Items:
    """Fingerprints, shingles and Hamming index of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = K.words(pa.array(texts, pa.large_string()), lower=True)
        hashes = K.hash_values(w.vocab)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
        self.ids, self.length = pa.array(ids, pa.int64()), w.counts
        rows, grams = [], []
        for r, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
            if b > a:
                g = gram_hashes(hashes[a:b], min(SHINGLE, b - a))
                rows.append(np.full(len(g), r))
                grams.append(g)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        counts = np.bincount(self.row, minlength=len(ids))
        self.weight = counts.astype(np.int64)
        self.fp = majority(self.gram, np.r_[0, np.cumsum(counts)])
        pair, n = np.unique(K.mix(self.gram) + self.row.astype(np.uint64), return_counts=True)
        self.pair, self.pair_weight = pair, n
        self.known = {size: np.unique(self.gram[np.minimum(self.length[self.row], SHINGLE) == size]) for size in range(1, SHINGLE + 1)}
        order = np.argsort(self.gram, kind="stable")
        self.by_gram, self.gram_length = self.gram[order], self.length[self.row][order]
        self.tables = {int(n): self._tables(np.flatnonzero(self.length == n)) for n in np.unique(self.length) if n}

    def _tables(self, items: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block, the items within RADIUS // BLOCKS bits of each value: (offsets by value, items)."""
        out = []
        for lo, hi in zip(EDGES[:-1], EDGES[1:], strict=True):
            width = hi - lo
            value = ((self.fp[items] >> np.uint64(lo)) & np.uint64((1 << width) - 1)).astype(np.int64)
            flips = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)]
            near = (value[:, None] ^ np.array(flips)).ravel()
            order = np.argsort(near, kind="stable")
            out.append((np.searchsorted(near[order], np.arange((1 << width) + 1)), np.repeat(items, len(flips))[order]))
        return out

    def within(self, fp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) of fingerprints of ``length``-word windows within RADIUS of an item's."""
        windows, items = [], []
        for (lo, hi), (starts, held) in zip(zip(EDGES[:-1], EDGES[1:], strict=True), self.tables[length], strict=True):
            value = ((fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)
            n = starts[value + 1] - starts[value]
            at = np.repeat(starts[value], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            windows.append(np.repeat(np.arange(len(fp)), n))
            items.append(held[at])
        pairs = np.unique(np.concatenate(windows) * len(self.ids) + np.concatenate(items))
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        close = np.bitwise_count(fp[window] ^ self.fp[item]) <= RADIUS
        return window[close], item[close]


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for count[i] steps, one run after the other."""
    return np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def matches_of(w: K.Words, items: Items, block: int = 20000) -> tuple[np.ndarray | pa.Array, ...]:
    """(row, item, first word in the row, words, similarity, differing bits): the best window of each row and item."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, float, np.int64))
    if not len(w.codes) or not len(items.gram):
        return none
    hashes = K.hash_values(w.vocab)[w.codes]
    row_of = np.repeat(np.arange(len(w.offsets) - 1), w.counts)
    wanted: list[np.ndarray] = []
    grams = {}
    for size, known in items.known.items():
        if not len(known):
            continue
        g = grams[size] = gram_hashes(hashes, size)
        mark = np.zeros(1 << 20, bool)
        mark[known >> np.uint64(44)] = True
        at = np.flatnonzero(mark[g >> np.uint64(44)])
        at = at[row_of[at] == row_of[at + size - 1]]
        lo, hi = np.searchsorted(items.by_gram, g[at], "left"), np.searchsorted(items.by_gram, g[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        length = items.gram_length[expand(lo, hi - lo)]
        anchor = np.unique(np.repeat(at, hi - lo) * (1 << 20) + length)
        at, length = anchor >> 20, anchor & ((1 << 20) - 1)
        fits = np.minimum(length, SHINGLE) == size
        at, length = at[fits], length[fits]
        first, last = w.offsets[row_of[at]], w.offsets[row_of[at] + 1]
        low = np.maximum(at + size - length, first)
        high = np.maximum(np.minimum(at, last - length), first)
        low = np.minimum(low, high)
        n = high - low + 1
        for a in range(0, len(n), block):
            part = slice(a, a + block)
            wanted.append(np.unique(expand(low[part], n[part]) * (1 << 20) + np.repeat(length[part], n[part])))
    if not wanted:
        return none
    keys = np.unique(np.concatenate(wanted))
    out = [none]
    for a in range(0, len(keys), block):
        start, length = keys[a : a + block] >> 20, keys[a : a + block] & ((1 << 20) - 1)
        for n in np.unique(length):
            s = start[length == n]
            size = min(SHINGLE, int(n))
            held = np.minimum(n, w.offsets[row_of[s] + 1] - s) - size + 1  # a shorter text is one window
            s, held = s[held > 0], held[held > 0]
            if not len(s):
                continue
            g = grams[size][expand(s, held)]
            fp = majority(g, np.r_[0, np.cumsum(held)])
            window, item = items.within(fp, int(n))
            if not len(window):
                continue
            many = held[window]
            pair = np.repeat(np.arange(len(window)), many)
            key = K.mix(g[expand((np.cumsum(held) - held)[window], many)]) + item[pair].astype(np.uint64)
            at = np.searchsorted(items.pair, key)
            at[at == len(items.pair)] = 0
            shared = items.pair[at] == key
            seen, inside = np.unique(pair[shared] * len(items.pair) + at[shared], return_counts=True)
            both = np.minimum(inside, items.pair_weight[seen % len(items.pair)])
            total = np.bincount(seen // len(items.pair), both, len(window))
            similarity = total / items.weight[item]
            good = np.flatnonzero(similarity >= SIMILARITY)
            window, item = window[good], item[good]
            row = row_of[s[window]]
            out.append((row, item, s[window] - w.offsets[row], np.full(len(good), n), similarity[good], np.bitwise_count(fp[window] ^ items.fp[item]).astype(np.int64)))
    row, item, first, n, similarity, bits = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((first, bits, -similarity, item, row))
    best = order[np.r_[True, (np.diff(row[order]) != 0) | (np.diff(item[order]) != 0)]] if len(order) else order
    return row[best], items.ids.take(pa.array(item[best])), first[best], n[best], similarity[best], bits[best]


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, similarity double, bits long"


def blocks_of(spark: SparkSession, benchmark: DataFrame, block_items: int) -> Iterator[Broadcast]:
    """The different benchmark items, ``block_items`` at a time; one empty block if there are none."""
    rows = K.columns_of(benchmark, "item_id", "text").where("text IS NOT NULL").dropDuplicates()
    block: list = []
    empty = True
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == block_items:
            yield spark.sparkContext.broadcast(Items([r[0] for r in block], [r[1] for r in block]))
            block, empty = [], False
    if block or empty:
        yield spark.sparkContext.broadcast(Items([r[0] for r in block], [r[1] for r in block]))


def scans_of(spark: SparkSession, benchmark: DataFrame, block_items: int) -> Iterator[list[Broadcast]]:
    """The blocks, SCAN_BLOCKS at a time."""
    blocks = blocks_of(spark, benchmark, block_items)
    while held := list(islice(blocks, SCAN_BLOCKS)):
        yield held


def find(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The best window of each document and benchmark item whose similarity reaches SIMILARITY."""
    source = docs.select(F.col("doc_id").cast("long"), "text")

    def scan(blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, words, items in ((b, w, i) for b in K.slices(batches) for w in [K.words(b.column("text"), lower=True)] for i in blocks):
                row, *rest = matches_of(words, items.value)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *[x if isinstance(x, pa.Array) else pa.array(x) for x in rest]], names=SCHEMA.replace(",", "").split()[::2])

        return source.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.union, map(scan, scans_of(docs.sparkSession, benchmark, block_items)))


def clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows without a match, in all their columns; each row is judged by its own text, whatever its doc_id."""

    def scan(rows: DataFrame, blocks: list[Broadcast]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in K.slices(batches):
                keep, words = np.ones(b.num_rows, bool), K.words(b.column("text"), lower=True)
                for items in blocks:
                    keep[matches_of(words, items.value)[0]] = False
                yield b.filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    return reduce(scan, scans_of(docs.sparkSession, benchmark, block_items), docs)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(K.read(spark, sf_dir, "documents"), K.read(spark, sf_dir, "benchmark"))
