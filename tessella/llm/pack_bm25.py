"""Lexical retrieval packing: each window is filled with a seed document's BM25 neighbours.

Documents are tokenised and reduced to term counts; full windows of a long document stand alone, its rest
is packed. Rows are range-sorted by a MinHash of their terms, so that lexically close documents (and copies)
meet, and cut into shards of at most ``SHARD_DOCS`` rests; a group of copies of any size spreads over
as many shards as it fills. Each shard has a BM25 inverted index over all of its documents. From the
longest unused document on, a seed asks the index for its unused neighbours by score; each that fits the
window's room is taken, until none fits. Scores are those of the shard's own index and statistics; terms are told apart by
32 bits of their hash. Documents of other shards are not asked for: see the README for the recall this gives.

Null and empty texts are one id without terms: they score zero and fill what room is left. Equal scores take the
longer document, then the earlier row. Repeated rows are packed each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .tokens import Encoder

WINDOW, SHARD_DOCS, K1, B = 1024, 1024, 1.2, 0.75
#: Bytes of text whose ids and terms a worker holds at once.
FEATURE_BYTES = 3 << 20
#: Postings of rare terms whose scores are added at once.
POSTINGS = 1 << 15
#: Terms in more documents of a shard than this have their postings held as a dense row.
DENSE = 24
FEATURES = "doc_id bigint, doc_tokens bigint, crcs array<bigint>, near bigint, far bigint, terms binary, counts binary"


def features(docs: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Token count, checksum of each piece, two MinHash values and term counts of every document."""
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary))
    source = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, limit=FEATURE_BYTES):
            ids, offsets = encoder.value.encode(b.column("text"))
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crcs = [[K.crc(raw[4 * a : 4 * min(a + window, hi)]) for a in range(lo, hi, window)] for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            w = K.words(b.column("text"), lower=True)
            h = K.hash_values(w.vocab) if len(w.vocab) else np.zeros(0, np.uint64)
            row = np.repeat(np.arange(b.num_rows), w.counts)
            pair, n = np.unique(row * max(1, len(h)) + w.codes, return_counts=True)
            row, term = pair // max(1, len(h)), h[pair % max(1, len(h))] if len(h) else np.zeros(0, np.uint64)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            full = np.flatnonzero(np.diff(ends))
            near, far = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            if len(full):
                near[full] = np.minimum.reduceat(K.mix(term), ends[full])
                far[full] = np.minimum.reduceat(K.mix(term ^ np.uint64(0xA5A5A5A5A5A5A5A5)), ends[full])
            short, many = (term >> np.uint64(32)).astype("<u4").tobytes(), n.astype("<u4").tobytes()
            cut = ends.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crcs, pa.list_(pa.int64())), pa.array(near.view(np.int64)), pa.array(far.view(np.int64)), pa.array([short[4 * a : 4 * z] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([many[4 * a : 4 * z] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["doc_id", "doc_tokens", "crcs", "near", "far", "terms", "counts"],
            )

    return source.mapInArrow(run, FEATURES)


def bm25(terms: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Score of every document of a shard (columns) for the terms of every other (rows)."""
    n = len(terms)
    scores = np.zeros((n, n), np.float32)
    size = np.array([len(t) for t in terms])
    if not size.sum():
        return scores
    doc = np.repeat(np.arange(n), size)
    tf = np.concatenate(counts).astype(np.float64)
    length = np.bincount(doc, tf, n)
    _, term, df = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))).astype(np.float32)
    order = np.argsort(term, kind="stable")  # the postings, term by term
    term, doc, weight = term[order], doc[order], weight[order]
    often = df > DENSE
    rows = np.cumsum(often) - 1
    dense = often[term]
    asked, held = np.zeros((int(often.sum()), n), np.float32), np.zeros((int(often.sum()), n), np.float32)
    asked[rows[term[dense]], doc[dense]] = 1
    held[rows[term[dense]], doc[dense]] = weight[dense]
    scores += asked.T @ held
    rare = ~dense & (df[term] > 1)
    term, doc, weight = term[rare], doc[rare], weight[rare]
    if len(term):
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        many = np.diff(np.r_[first, len(term)])
        first, many = np.repeat(first, many), np.repeat(many, many)
        total = np.zeros(n * n)
        for lo in range(0, len(term), POSTINGS):  # a posting meets at most DENSE others
            each, start = many[lo : lo + POSTINGS], first[lo : lo + POSTINGS]
            at = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            total += np.bincount(np.repeat(doc[lo : lo + POSTINGS], each) * n + doc[at], weight[at], n * n)
        scores += total.astype(np.float32).reshape(n, n)
    return scores


def fill(lengths: np.ndarray, scores: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Greedy windows: the longest unused document, then its unused neighbours by score while they fit."""
    n = len(lengths)
    unused = np.ones(n, bool)
    out = []
    for seed in np.lexsort((np.arange(n), -lengths)).tolist():
        if not unused[seed]:
            continue
        unused[seed] = False
        group, room = [seed], window - int(lengths[seed])
        fits = np.flatnonzero(unused & (lengths <= room))
        fits = fits[np.lexsort((fits, -lengths[fits], -scores[seed, fits]))] if len(fits) else fits
        while len(fits):
            i = int(fits[0])
            group.append(i)
            unused[i] = False
            room -= int(lengths[i])
            fits = fits[1:]
            fits = fits[lengths[fits] <= room]
        out.append(group)
    return out


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = SCHEMA.replace(",", "").split()[::2]


def retrieval_pack(docs: DataFrame, window: int = WINDOW, shard_docs: int = SHARD_DOCS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row for each piece, in the form of SCHEMA."""
    made = K.stored(features(docs, window, vocabulary))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["near", "far", "doc_id"]
    placed = made.repartitionByRange(partitions, *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        pool: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)

        def shard() -> pa.RecordBatch:
            nonlocal sequence
            lengths = np.array([p[2] for p in pool])
            scores = bm25([np.frombuffer(p[5], "<u4") for p in pool], [np.frombuffer(p[6], "<u4") for p in pool])
            rows = []
            for group in fill(lengths, scores, window):
                offset = 0
                for i in group:
                    rows.append((*pool[i][:5], sequence, offset))
                    offset += pool[i][2]
                sequence += 1
            pool.clear()
            return batch(rows)

        for b in batches:
            full = []
            for doc, tokens, crcs, terms, counts in zip(*(b.column(n).to_pylist() for n in ("doc_id", "doc_tokens", "crcs", "terms", "counts")), strict=True):
                for k, c in enumerate(crcs):
                    length = min(window, tokens - k * window)
                    if length == window:
                        full.append((doc, k * window, length, c, tokens, sequence, 0))
                        sequence += 1
                    else:
                        pool.append((doc, k * window, length, c, tokens, terms, counts))
                if len(pool) == shard_docs:
                    yield shard()
            if full:
                yield batch(full)
        if pool:
            yield shard()

    return placed.select("doc_id", "doc_tokens", "crcs", "terms", "counts").mapInArrow(run, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_pack(K.read(spark, sf_dir, "documents"))
