"""Language-model scoring by deleted interpolation.

A bigram, a unigram and a uniform estimate (all maximum-likelihood) are mixed; the weights depend on the bucket (log2) of
the context's count and come from expectation-maximisation on held-out counts: a tenth of the training
documents is deleted from the counts, and their tokens, as a histogram of quantised ratios of the
three estimates, train the weights. Final counts use all training documents.

Texts are lower-cased (A-Z), split into words and ended with one end token; the first token's context is the end
token. Documents are tokenised once, and their chunks written to the shared folder; everything after reads these,
so a recomputed task meets the same chunks whatever the batch boundaries were. Chunks send their distinct
n-gram hashes (64 bits), as compressed sorted arrays, to hash buckets; buckets add them up over the corpus and return
to each chunk just the counts it asked for. No task or driver holds a whole vocabulary: a bucket has about
``BUCKET_BYTES`` of text behind it. The rows sent are at most chunks times buckets, and never more than the chunks'
distinct n-grams. A chunk is named by its content; a missing answer is an error.

Null and empty texts are one end token. Without training tokens every score is 0. A null doc_id counts as the
empty text in folds; repeated rows are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 24 << 20
END = K.hash_text([" "])[0]  # no word has a space
#: Tokens scored at once; bytes of a row group of stored chunks, so that a reader holds one or two of them.
BLOCK_TOKENS, GROUP_BYTES = 1 << 18, 4 << 20
ROW_GROUPS = {"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.enable.dictionary": False, "compression": "none"}
BINS, LEVELS = 4, 40  # bins of a factor of two; buckets of context counts


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


class Chunk(NamedTuple):
    """Documents as token numbers; hashes[number] names the word, number 0 is the end token."""

    name: int
    ids: list
    folds: np.ndarray
    offsets: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray

    def bigrams(self) -> np.ndarray:
        before = np.r_[0, self.tokens[:-1]]
        before[self.offsets[:-1]] = 0
        return K.mix(K.mix(self.hashes[before] + np.uint64(1)) ^ self.hashes[self.tokens])

    def contexts(self) -> np.ndarray:
        before = np.r_[0, self.tokens[:-1]]
        before[self.offsets[:-1]] = 0
        return before


def chunk_of(batch: pa.RecordBatch) -> Chunk:
    text = K.plain(batch.column("text"))
    w = K.words(text, lower=True)
    rows = batch.num_rows
    tokens = np.zeros(len(w.codes) + rows, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[w.offsets[1:] + np.arange(rows)] = False
    tokens[inner] = w.codes + 1
    hashes = np.r_[END, K.hash_values(w.vocab)] if len(w.vocab) else np.array([END])
    ids = batch.column("doc_id").to_pylist()
    name = xxhash.xxh64(K.bytes_view(text)[0].tobytes())
    name.update(repr((ids, w.counts.tolist())).encode())
    return Chunk(name.intdigest() - (1 << 63), ids, batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64), w.offsets + np.arange(rows + 1), tokens, hashes)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, Chunk]]:
    """Chunks of the deleted documents (fold 1) and of all others, apart."""
    for b in K.slices(batches, limit=CHUNK_BYTES):
        deleted = b.column("fold").to_numpy(zero_copy_only=False) == 1
        for flag in (False, True):
            part = b.filter(pa.array(deleted == flag))
            if part.num_rows:
                yield flag, chunk_of(part)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


ASK = "bucket int, chunk long, deleted boolean, words binary, word_counts binary, pairs binary, pair_counts binary"
TOLD = "chunk long, bucket int, deleted boolean, words binary, word_lost binary, pairs binary, pair_lost binary, kinds long, tokens long, kinds_left long, tokens_left long"
DOCS = "chunk long, deleted boolean, ids array<long>, folds binary, offsets binary, numbers binary, hashes binary"


def chunk_of_row(r: dict) -> Chunk:
    """A chunk from its row of DOCS."""
    offsets = np.r_[0, np.cumsum(expand(r["offsets"], np.int64))]
    return Chunk(r["chunk"], r["ids"], expand(r["folds"], np.uint8).astype(np.int64), offsets, expand(r["numbers"], np.uint32).astype(np.int64), expand(r["hashes"], np.uint64))


def asks(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each chunk and bucket: distinct n-grams with their counts in training documents."""

    def questions(c: Chunk, deleted: bool) -> pa.RecordBatch:
        learnt = np.repeat(c.folds != 0, np.diff(c.offsets))
        columns = []
        for keys in (c.hashes[c.tokens], c.bigrams()):
            kind, inverse = np.unique(keys, return_inverse=True)
            columns.append((kind, np.bincount(inverse, learnt, len(kind)).astype(np.uint32), np.searchsorted(bucket_of(kind, buckets), np.arange(buckets + 1))))
        met = np.flatnonzero(np.add(*[np.diff(cut) for _, _, cut in columns]))
        out = []
        for k in met.tolist():
            parts = [(kind[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]) for kind, n, cut in columns]
            out.append((k, c.name, deleted, *[f for kind, n in parts for f in (squeeze_sorted(kind), squeeze(n))]))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names=ASK.replace(",", "").split()[::2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                yield questions(chunk_of_row(r), r["deleted"])

    return rows.mapInArrow(run, ASK)


def answer(table: pa.Table) -> pa.Table:
    """Counts over the corpus for one bucket, dealt back to its chunks; what the deleted documents hold is told to theirs."""
    bucket = table["bucket"][0].as_py()
    deleted = table["deleted"].to_pylist()
    told: list[list] = []
    stats = []
    for keys_in, counts_in in (("words", "word_counts"), ("pairs", "pair_counts")):
        keys = [expand_sorted(x) for x in table[keys_in].to_pylist()]
        counts = [expand(x, np.uint32) for x in table[counts_in].to_pylist()]
        kind, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        flat = np.concatenate(counts).astype(np.float64)
        lost = flat * np.repeat(np.array(deleted, bool), [len(k) for k in keys])
        total, gone = np.bincount(inverse, flat, len(kind)).astype(np.uint64), np.bincount(inverse, lost, len(kind)).astype(np.uint64)
        told += [[], []]
        for e, k, d in zip(ends, keys, deleted, strict=True):
            at = inverse[e - len(k) : e]
            told[-2].append(squeeze(total[at]))
            told[-1].append(squeeze(gone[at]) if d else b"")
        stats.append((int((total > 0).sum()), int(total.sum()), int((total > gone).sum()), int((total - gone).sum())))
    n = len(deleted)
    first = [[s, *[0] * (n - 1)] for s in stats[0]]
    arrays = [table["chunk"].combine_chunks(), pa.array([bucket] * n, pa.int32()), table["deleted"].combine_chunks(), *[pa.array(t, pa.binary()) for t in told], *[pa.array(x, pa.int64()) for x in first]]
    return pa.Table.from_arrays(arrays, names=TOLD.replace(",", "").split()[::2])


def document_rows(source: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for deleted, c in chunks(batches):
            columns = [[c.name], [deleted], [c.ids], [squeeze(c.folds.astype(np.uint8))], [squeeze(np.diff(c.offsets))], [squeeze(c.tokens.astype(np.uint32))], [squeeze(c.hashes)]]
            kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=DOCS.replace(",", "").split()[::2])

    return source.mapInArrow(run, DOCS)


class Counted(NamedTuple):
    """A chunk and the places of its tokens, contexts and bigrams in the counts of its distinct n-grams."""

    chunk: Chunk
    at: np.ndarray
    before: np.ndarray
    pair_at: np.ndarray
    words: np.ndarray
    words_lost: np.ndarray
    pairs: np.ndarray
    pairs_lost: np.ndarray

    def blocks(self, lost: bool = False) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Counts of each token, its context and its bigram, a block of tokens at a time; with ``lost``, less what the deleted documents hold."""
        words, pairs = (self.words - self.words_lost, self.pairs - self.pairs_lost) if lost else (self.words, self.pairs)
        for a in range(0, len(self.at), BLOCK_TOKENS):
            cut = slice(a, a + BLOCK_TOKENS)
            yield cut, words[self.at[cut]], words[self.before[cut]], pairs[self.pair_at[cut]]


def counted(docs: pa.Table, told: pa.Table) -> Iterator[Counted]:
    """The counts that a chunk asked for, in the corpus and in the deleted documents."""
    order = np.argsort(told["bucket"].to_numpy(), kind="stable")
    buckets = told["bucket"].to_numpy()[order]
    order = order[np.r_[True, buckets[1:] != buckets[:-1]]] if len(order) else order  # equal chunks get equal answers

    def joined(name: str) -> np.ndarray:
        parts = [told[name][int(i)].as_py() for i in order]
        return np.concatenate([expand(p, np.uint64) for p in parts if p] or [np.zeros(0, np.uint64)]).astype(np.float64)

    words, words_lost, pairs, pairs_lost = (joined(n) for n in ("words", "word_lost", "pairs", "pair_lost"))
    for i in range(docs.num_rows):
        c = chunk_of_row(docs.slice(i, 1).to_pylist()[0])
        kind, back = np.unique(c.hashes, return_inverse=True)
        used = np.zeros(len(kind), bool)
        used[back[c.tokens]] = True
        number = (np.cumsum(used) - 1)[back]
        pair, pair_at = np.unique(c.bigrams(), return_inverse=True)
        if used.sum() != len(words) or len(pair) != len(pairs):
            raise ValueError("a chunk's counts are missing")
        yield Counted(c, number[c.tokens], number[c.contexts()], pair_at, words, words_lost, pairs, pairs_lost)


def level_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(context, 0.5))).astype(np.int64) + 1, LEVELS - 1)


def binned(p: np.ndarray, p0: float) -> np.ndarray:
    """log2 of p / p0 in BINS steps each; -1 for zero."""
    return np.where(p > 0, np.maximum(np.rint(BINS * np.log2(np.maximum(p, 1e-300) / p0)) + 1024, 0), -1).astype(np.int64)


def learn_weights(histogram: list[tuple[int, int, int, float]], rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket of context counts, by expectation-maximisation."""
    weights = np.full((LEVELS, 3), np.nan)
    rows = np.array(histogram, float).reshape(-1, 4)
    for level in np.unique(rows[:, 0]).astype(int):
        r = rows[rows[:, 0] == level]
        p = np.stack([*[np.where(r[:, i] >= 0, 2.0 ** ((r[:, i] - 1024) / BINS), 0) for i in (1, 2)], np.ones(len(r))], axis=1)
        w = np.array([1 / 3] * 3)
        for _ in range(rounds):
            share = p * w
            share *= (r[:, 3] / share.sum(1))[:, None]
            w = share.sum(0) / share.sum()
        weights[level] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    last = np.array([0.0, 0.9, 0.1])
    for level in range(LEVELS):  # a bucket without held-out tokens takes the weights of the one below
        if np.isnan(weights[level]).any():
            weights[level] = last
        last = weights[level]
    weights[0] = [0, weights[0][1] + weights[0][0], weights[0][2]]
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    source = docs.select(F.col("doc_id").cast("long"), K.fold("doc_id", 10).alias("fold"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = K.stored(document_rows(source), **ROW_GROUPS)
    told = K.stored(asks(rows, buckets).repartition(max(partitions, min(buckets, 1 << 15)), "bucket").groupBy("bucket").applyInArrow(answer, TOLD), **ROW_GROUPS)
    kinds, tokens, kinds_left, tokens_left = (int(x or 0) for x in told.agg(*[F.sum(c) for c in ("kinds", "tokens", "kinds_left", "tokens_left")]).first())
    p0 = 1.0 / (kinds + 1)

    def tally(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        parts = []
        for c in counted(docs, told):
            for _, word, context, pair in c.blocks(lost=True):
                parts.append(np.stack([level_of(context), binned(pair / np.maximum(context, 1), p0), binned(word / max(tokens_left, 1), p0)], axis=1))
        kind, n = np.unique(np.concatenate(parts), axis=0, return_counts=True) if parts else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        return pa.table({"level": kind[:, 0], "b2": kind[:, 1], "b1": kind[:, 2], "n": n})

    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def total(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for c in counted(docs, told):
            known, base, model = np.zeros(len(c.at), bool), np.zeros(len(c.at)), np.zeros(len(c.at))
            for cut, word, context, pair in c.blocks():
                w = shared.value[level_of(context)]
                known[cut] = word > 0
                base[cut] = np.log10((word + 0.1) / (tokens + 0.1 * (kinds + 1)))
                model[cut] = np.log10(w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] * p0) if tokens else 0
            o = c.chunk.offsets
            columns = [pa.array(c.chunk.ids, pa.int64()), pa.array(c.chunk.folds == 0), pa.array(np.diff(o)), pa.array(K.row_sums(known.astype(np.int64), o)), pa.array([tokens] * len(c.chunk.ids), pa.int64()), pa.array(K.row_sums(base, o)), pa.array(K.row_sums(model, o))]
            out.append(pa.table(columns, names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64())], names=names)

    held = rows.where("deleted").groupBy("chunk").cogroup(told.where("deleted").select("chunk", "bucket", "words", "word_lost", "pairs", "pair_lost").groupBy("chunk"))
    histogram = held.applyInArrow(tally, "level long, b2 long, b1 long, n long").groupBy("level", "b2", "b1").agg(F.sum("n").alias("n")).collect()
    shared = docs.sparkSession.sparkContext.broadcast(learn_weights([tuple(r) for r in histogram]))
    every = rows.groupBy("chunk").cogroup(told.select("chunk", "bucket", "words", F.lit(b"").alias("word_lost"), "pairs", F.lit(b"").alias("pair_lost")).groupBy("chunk"))
    return every.applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(K.read(spark, sf_dir, "documents"))
