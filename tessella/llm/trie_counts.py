"""Token counts of a unigram segmentation, by dynamic programming over a trie.

Pieces come from a public SentencePiece vocabulary; piece i of it has score ``-log(i + 1)`` (Zipf's law
over ranks; nothing is trained), a byte outside all pieces costs ``FALLBACK``. A pre-token is a word with the
mark U+2581 before it. The distinct pre-tokens of a batch form a trie; for each node, so once for
each shared prefix, the forward score is the best over pieces that end there of the score at
the piece's start plus the piece's score. Equal scores take fewer tokens. Terminal nodes give the counts of
their pre-tokens, and a text's count is the sum over its words. Pre-tokens of more than ``LONG_WORD`` bytes, whose
prefixes are seldom shared, take the same recurrence one by one, in time proportional to length times longest piece.

Null and empty texts have 0 tokens; empty tables give empty results; rows that repeat are counted
each; very long words are cut nowhere; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

MARK = "▁".encode()
FALLBACK = -20.0
BASE = np.uint64(0x100000001B3)
#: Words whose counts a Python worker keeps between batches.
KEPT_WORDS = 200_000
#: Bytes of a pre-token from which it is scored alone, and starts looked up at once there.
LONG_WORD, STARTS = 128, 1 << 16


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces in order of rank, without control and single-byte pieces."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Pieces:
    """Piece scores by length: sorted hashes with scores aligned."""

    def __init__(self, pieces: list[bytes]):
        score = {}
        for i, p in enumerate(pieces):
            score.setdefault(p, -math.log(i + 1.0))
        self.longest = max(map(len, score), default=1)
        self.kept: dict[bytes, int] = {}  # filled by each worker
        self.power = np.ones(self.longest + 1, np.uint64)
        self.table = {}
        by_length: dict[int, list[bytes]] = {}
        for p in score:
            by_length.setdefault(len(p), []).append(p)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                self.power[n] = self.power[n - 1] * BASE
        for n, ps in by_length.items():
            h = np.zeros(len(ps), np.uint64)
            raw = np.frombuffer(b"".join(ps), np.uint8).reshape(len(ps), n)
            for k in range(n):
                h = h * BASE + raw[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.table[n] = (h[order], np.array([score[ps[i]] for i in order]))

    def scores(self, n: int, h: np.ndarray) -> np.ndarray:
        if n not in self.table:
            return np.full(len(h), -np.inf)
        known, score = self.table[n]
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        return np.where(known[at] == h, score[at], -np.inf)


def forward(words: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token count and score of each word (bytes). Words are sorted, so a trie node is a run of equal prefixes."""
    order = pc.sort_indices(words.cast(pa.large_binary())).to_numpy()
    data, offsets = K.bytes_view(words.cast(pa.large_binary()).take(pa.array(order)))
    length = np.diff(offsets)
    count, score = np.zeros(len(words), np.int64), np.zeros(len(words))
    if not len(words):
        return count, score
    differs = np.zeros(len(words), bool)  # from the word before, in the bytes so far
    differs[0] = True
    node = [np.zeros(len(words), np.int64)]  # the node of each word at depth 0, 1, ...
    best, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    prefix = [np.zeros(1, np.uint64)]  # hash of the path to each node
    active = np.arange(len(words))
    depth = 0
    while len(active):
        depth += 1
        active = active[length[active] >= depth]
        if not len(active):
            break
        byte = data[offsets[active] + depth - 1]
        before = np.r_[-1, active[:-1]]
        new = differs[active] | (before != active - 1)
        new[1:] |= byte[1:] != byte[:-1]
        differs[active] = new
        at = np.cumsum(new) - 1
        here = np.zeros(len(words), np.int64)
        here[active] = at
        reps = active[new]
        h = prefix[-1][node[-1][reps]] * BASE + byte[new] + np.uint64(1)
        top, few = np.full(len(reps), -np.inf), np.zeros(len(reps), np.int64)
        for n in range(1, min(depth, pieces.longest) + 1):
            up = node[-n][reps]
            s = pieces.scores(n, h - prefix[-n][up] * pieces.power[n])
            if n == 1:
                s = np.where(np.isneginf(s), FALLBACK, s)
            s, c = best[-n][up] + s, tokens[-n][up] + 1
            better = (s > top) | ((s == top) & (c < few))
            top, few = np.where(better, s, top), np.where(better, c, few)
        for level, value in ((node, here), (best, top), (tokens, few), (prefix, h)):
            level.append(value)
            if len(level) > pieces.longest + 1:
                level.pop(0)
        ends = active[length[active] == depth]
        count[order[ends]], score[order[ends]] = few[here[ends]], top[here[ends]]
    return count, score


def forward_long(word: bytes, pieces: Pieces) -> tuple[int, float]:
    """Token count and score of one word: pieces are looked up for all starts of a block at once, length by length."""
    data = np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
    best, tokens = [-math.inf] * (len(word) + 1), [0] * (len(word) + 1)
    best[0] = 0.0
    for a in range(0, len(word), STARTS):
        z = min(a + STARTS, len(word))
        h, found = np.zeros(z - a, np.uint64), []
        for n in range(1, min(pieces.longest, len(word) - a) + 1):
            h = h[: min(z, len(word) - n + 1) - a] * BASE
            h += data[a + n - 1 : a + n - 1 + len(h)]
            s = pieces.scores(n, h)
            if n == 1:
                s = np.where(np.isneginf(s), FALLBACK, s)
            at = np.flatnonzero(~np.isneginf(s))
            found.append((at + a, at + a + n, s[at]))
        start, end, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        for i, j, s in zip(start[order].tolist(), end[order].tolist(), score[order].tolist(), strict=True):
            top, few = best[i] + s, tokens[i] + 1
            if top > best[j] or (top == best[j] and few < tokens[j]):
                best[j], tokens[j] = top, few
    return tokens[-1], best[-1]


def counts_of(vocab: pa.Array, pieces: Pieces, kept: dict[bytes, int]) -> np.ndarray:
    """Token counts of distinct words; known ones are looked up, the others go through the trie."""
    values = vocab.cast(pa.large_binary()).to_pylist()
    found = [kept.get(v) for v in values]
    new = [i for i, f in enumerate(found) if f is None]
    short = []
    for i in new:
        if len(values[i]) + len(MARK) > LONG_WORD:
            found[i] = forward_long(MARK + values[i], pieces)[0]
        else:
            short.append(i)
    if short:
        for a in range(0, len(short), 1 << 16):
            part = short[a : a + (1 << 16)]
            count, _ = forward(pa.array([MARK + values[i] for i in part], pa.large_binary()), pieces)
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for i, c in zip(part, count.tolist(), strict=True):
                found[i] = c
                if len(values[i]) <= 64:
                    kept[values[i]] = c
    return np.array(found, np.int64)


def token_counts(docs: DataFrame, pieces: list[bytes] | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""
    table = docs.sparkSession.sparkContext.broadcast(Pieces(pieces if pieces is not None else vocabulary()))
    source = K.columns_of(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = table.value.kept
        for b in K.slices(batches):
            w = K.words(b.column("text"))
            n = K.row_sums(counts_of(w.vocab, table.value, kept)[w.codes], w.offsets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(n)], names=["doc_id", "n_words", "n_tokens"])

    return source.mapInArrow(run, source.select("doc_id").schema.add("n_words", "long").add("n_tokens", "long"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(K.read(spark, sf_dir, "documents"))
