"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` for each language in the training rows, over lower-cased letters of words (with
start and end marks). The n-grams of all languages stand in sorted hash arrays, one per order, with a column
of discounted probabilities for each language; contexts likewise, with their interpolation weights. The
language with the lowest cross-entropy per symbol wins; equal ones take the first in alphabetical order.

Models are fitted on a bounded sample: about ``SAMPLE_DOCS`` whole documents and ``SAMPLE_BYTES`` of each
language, by hash of doc_id. A fifth of it stays out of the counts and calibrates the score (a softmax over
entropy times the root of the number of symbols, whose temperature minimises the log loss) and the rejection (``accepted`` is false where the cross-entropy exceeds all
but ``1 - ACCEPT`` of the language's own). Prediction reads whole texts of all rows.

Null texts and texts without a letter are ``und`` with score 0; so is everything if there is no training row.
Empty tables give empty results; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

ORDER, SAMPLE_DOCS, SAMPLE_BYTES, ACCEPT = 5, 400, 1_500_000, 0.995
#: Words whose scores a Python worker keeps between batches.
KEPT_WORDS = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(vocab: pa.Array) -> pa.Array:
    """Lower-cased letters of each word."""
    return pc.replace_substring_regex(pc.utf8_lower(vocab), r"\PL+", "")


class Sequence:
    """Symbols of many words, with ORDER - 1 start marks before and an end mark after each; h[k] are k-gram hashes."""

    def __init__(self, forms: pa.Array):
        length = pc.utf8_length(forms).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = np.frombuffer("".join(forms.to_pylist()).encode("utf-32-le"), np.uint32)
        step = length + ORDER
        first = np.cumsum(step) - step + ORDER - 1
        cp = np.full(int(step.sum()), 1, np.uint64)
        word_start = np.cumsum(length) - length
        cp[np.repeat(first - word_start, length) + np.arange(len(symbols))] = symbols.astype(np.uint64) + np.uint64(3)
        cp[first + length] = 2
        n = length + 1
        self.at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.offsets = np.r_[0, np.cumsum(n)]
        self.h = [np.zeros(len(cp), np.uint64)]
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(ORDER):
                moved = np.zeros(len(cp), np.uint64)
                moved[k:] = cp[: len(cp) - k] if k else cp
                self.h.append(self.h[-1] + moved * power)
                power = power * BASE

    def grams(self, k: int) -> np.ndarray:
        return self.h[k][self.at]

    def contexts(self, k: int) -> np.ndarray:
        """What stands before the last symbol of the k-gram."""
        return self.h[k - 1][self.at - 1]


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, len(table) where absent."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, len(table)) if len(table) else at


def kneser_ney(forms: pa.Array, weight: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each order from 1: (n-gram hashes, their discounted probability, context hashes, their weight on the order below)."""
    s = Sequence(forms)
    out = []
    for k in range(1, ORDER + 1):
        if k == ORDER:
            gram, first, inverse = np.unique(s.grams(k), return_index=True, return_inverse=True)
            count = np.bincount(inverse, np.repeat(weight, np.diff(s.offsets)), len(gram))
        else:
            kinds = np.unique(s.grams(k + 1), return_index=True)[1]
            gram, at, count = np.unique(s.grams(k)[kinds], return_index=True, return_counts=True)
            first = kinds[at]
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
        context, place = np.unique(s.contexts(k)[first], return_inverse=True)
        total, kinds_after = np.bincount(place, count), np.bincount(place)
        out.append((gram, (count - discount) / total[place], context, discount * kinds_after / total))
    return out


class Models:
    """The models of all languages, with calibration."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        held = {g: (t[::5] if len(t) > 5 else t) for g, t in texts.items()}
        fitted = []
        for g in self.langs:
            own = [x for i, x in enumerate(texts[g]) if i % 5 or len(texts[g]) <= 5]
            w = K.words(pa.array(own, pa.large_string()))
            forms = letters(w.vocab).dictionary_encode()
            n = np.bincount(forms.indices.to_numpy(zero_copy_only=False), np.bincount(w.codes, minlength=len(w.vocab)), len(forms.dictionary)) if len(w.vocab) else np.zeros(0)
            some = pc.utf8_length(forms.dictionary).to_numpy(zero_copy_only=False) > 0
            fitted.append(kneser_ney(forms.dictionary.filter(pa.array(some)), n[some]))
        count = len(self.langs)
        self.tables = []
        for k in range(ORDER):
            grams = np.unique(np.concatenate([f[k][0] for f in fitted])) if fitted else np.zeros(0, np.uint64)
            contexts = np.unique(np.concatenate([f[k][2] for f in fitted])) if fitted else np.zeros(0, np.uint64)
            alpha, below = np.zeros((len(grams) + 1, count), np.float32), np.ones((len(contexts) + 1, count), np.float32)
            for j, f in enumerate(fitted):
                alpha[np.searchsorted(grams, f[k][0]), j] = f[k][1]
                below[np.searchsorted(contexts, f[k][2]), j] = f[k][3]
            self.tables.append((grams, alpha, contexts, below))
        self.floor = 1.0 / (len(self.tables[0][0]) + 1) if fitted else 1.0
        self.kept: dict[bytes, int] = {}  # filled by each worker, with the rows of self.rows
        self.rows = np.zeros((0, count + 1))
        self.heat, self.limit = 1.0, np.full(count, np.inf)
        if count:
            self._calibrate(held)

    def word_scores(self, forms: pa.Array) -> np.ndarray:
        """For each word: its log probability in every language, then its number of symbols."""
        out = np.zeros((len(forms), len(self.langs) + 1))
        some = np.flatnonzero(pc.utf8_length(forms).to_numpy(zero_copy_only=False))
        if not len(some):
            return out
        s = Sequence(forms.take(pa.array(some)))
        p = np.full((len(s.at), len(self.langs)), self.floor, np.float32)
        for k, (grams, alpha, contexts, below) in enumerate(self.tables, 1):
            p = p * below[lookup(contexts, s.contexts(k))] + alpha[lookup(grams, s.grams(k))]
        out[some, :-1] = np.add.reduceat(np.log(p).astype(np.float64), s.offsets[:-1], axis=0)
        out[some, -1] = np.diff(s.offsets)
        return out

    def vocab_scores(self, vocab: pa.Array) -> np.ndarray:
        forms = letters(vocab).dictionary_encode()
        values = forms.dictionary.cast(pa.large_binary()).to_pylist()
        get = self.kept.get
        slot = np.fromiter((get(v, -1) for v in values), np.int64, len(values))
        new = np.flatnonzero(slot < 0)
        fresh = np.concatenate([self.word_scores(forms.dictionary.take(pa.array(new[a : a + (1 << 15)]))) for a in range(0, len(new), 1 << 15)]) if len(new) else np.zeros((0, len(self.langs) + 1))
        scores = np.empty((len(values), len(self.langs) + 1))
        old = slot >= 0
        scores[old], scores[new] = self.rows[slot[old]], fresh
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept, self.rows = {}, np.zeros((0, len(self.langs) + 1))
        if len(new) <= KEPT_WORDS:
            base = len(self.rows)
            self.kept.update((values[i], base + j) for j, i in enumerate(new.tolist()) if len(values[i]) <= 64)
            self.rows = np.concatenate([self.rows, fresh])
        return scores[forms.indices.to_numpy(zero_copy_only=False)]

    def entropies(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text in each language, and its number of symbols."""
        w = K.words(text)
        sums = np.zeros((len(text), len(self.langs) + 1))
        if len(w.codes):
            per_word = self.vocab_scores(w.vocab)
            for j in range(sums.shape[1]):
                sums[:, j] = K.row_sums(per_word[:, j][w.codes], w.offsets)
        n = sums[:, -1]
        return -sums[:, :-1] / np.maximum(n, 1)[:, None], n

    def confidence(self, entropy: np.ndarray, n: np.ndarray, heat: float | None = None) -> np.ndarray:
        x = -(self.heat if heat is None else heat) * entropy * np.sqrt(n)[:, None]
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def _calibrate(self, held: dict[str, list[str]]) -> None:
        entropy, n, label = [], [], []
        for j, g in enumerate(self.langs):
            e, m = self.entropies(pa.array(held[g], pa.large_string()))
            e, m = e[m > 0], m[m > 0]
            if len(m):
                self.limit[j] = np.quantile(e[:, j], ACCEPT) * 1.02
                entropy.append(e)
                n.append(m)
                label.append(np.full(len(m), j))
        if label:
            e, m, y = np.concatenate(entropy), np.concatenate(n), np.concatenate(label)
            grid = [2.0**i for i in range(-10, 6)]
            loss = [-np.log(np.maximum(self.confidence(e, m, t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
            self.heat = grid[int(np.argmin(loss))]


def sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Texts of each language by hash of doc_id: twice the bound is drawn by hash, then cut to it."""
    rank = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    sized = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    if not sized:
        return {}
    shares = {r["lang"]: min(1.0, 2 * docs / r["n"], 2 * size / max(1, r["b"])) for r in sized}
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("lang")]
    drawn = labelled.where(rank <= share * F.lit(float(1 << 30))).select("lang", rank.alias("rank"), "text").collect()
    out: dict[str, list[str]] = {g: [] for g in shares}
    held = dict.fromkeys(shares, 0)
    for r in sorted(drawn, key=lambda r: (r["lang"], r["rank"], r["text"])):
        g = r["lang"]
        if len(out[g]) < docs and (not out[g] or held[g] < size):
            out[g].append(r["text"])
            held[g] += len(r["text"])
    return {g: t for g, t in out.items() if t}


def fit(labelled: DataFrame) -> Models:
    """Models from the rows of (doc_id, lang, text) whose lang and text are not null."""
    return Models(sample(K.columns_of(labelled, "doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")))


def predict(docs: DataFrame, models: Models, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and accepted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    source = K.columns_of(docs, "doc_id", *extra, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in K.slices(batches):
            entropy, n = m.entropies(b.column("text"))
            best = np.where(n > 0, entropy.argmin(1), len(m.langs)) if m.langs else np.zeros(b.num_rows, np.int64)
            known = best < len(m.langs)
            rows, low, score = np.flatnonzero(known), np.zeros(b.num_rows), np.zeros(b.num_rows)
            low[rows] = entropy[rows, best[rows]]
            score[rows] = m.confidence(entropy[rows], n[rows])[np.arange(len(rows)), best[rows]] if len(rows) else 0
            accepted = known & (low <= np.r_[m.limit, -np.inf][best])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", *extra)], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(low), pa.array(accepted)], names=["doc_id", *extra, "lang_pred", "score", "cross_entropy", "accepted"])

    schema = source.drop("text").schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("cross_entropy", "double"), ("accepted", "boolean")):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.read(spark, sf_dir, "documents").withColumn("held_out", K.fold("doc_id", 3) == 1)
    return predict(docs, fit(docs.where("NOT held_out")), ("held_out",))
