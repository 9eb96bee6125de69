"""Toxicity by compression distance.

Labelled texts are cut into windows of ``WINDOW`` words. ``PAIRS`` times, one zstandard dictionary is trained on
windows of toxic texts and one on windows of ordinary texts, each on a share of its windows drawn by a seeded
generator and of ``DICTIONARY_BYTES``. Every window of a text is compressed with every dictionary; a pair's
difference is the length with the ordinary minus the length with the toxic dictionary. A window's distance is the mean
difference, none counted above ``MOST``, plus the least one, so that what only one pair happens to hold counts little.
What a text's windows exceed ordinary ones by gives its features: the most, the three most, all, and all by the number
of windows. A logistic fit, calibrated on the training rows, turns them into a score. Every window is compressed;
further pairs are left out only where no outcome of theirs could lift the window above ordinary ones.

Fitting reads a bounded sample: about ``SAMPLE_DOCS`` labelled texts of each label and ``SAMPLE_BYTES``, by hash of
doc_id, without repeated texts. Scoring covers whole texts of all rows.

Null and empty texts get the score of a text without windows; without labelled rows of both kinds
every score is 0.0. Empty tables give empty results; repeated rows are scored each; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

SAMPLE_DOCS, SAMPLE_BYTES = 2500, 10_000_000
WINDOW, PAIRS, DICTIONARY_BYTES, THRESHOLD = 4, 4, 65536, 0.7
#: Windows that a dictionary is trained on at most, and the segment and d-mer size of its training.
TRAINING_WINDOWS, SEGMENT, DMER = 60_000, 32, 6
#: Bytes that the difference of one pair counts at most.
MOST = 3
#: Distance that this share of ordinary windows stays below; what exceeds it counts.
ORDINARY_SHARE = 0.997
#: Weight of all toxic texts together in the logistic fit.
TOXIC_SHARE = 0.4


def forms(vocab: pa.Array) -> pa.Array:
    """Lower-cased letters and digits of each word."""
    return pc.replace_substring_regex(pc.utf8_lower(vocab), r"[^\pL\pN]+", "")


def runs(texts: list[str], limit: int = 1 << 20) -> Iterator[pa.Array]:
    """Consecutive texts of about ``limit`` characters at a time, so that the driver holds few temporary arrays."""
    number = np.cumsum([len(t) for t in texts]) // limit
    cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if texts else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield pa.array(texts[a:b], pa.large_string())


def normal(texts: list[str]) -> list[list[str]]:
    out, held = [], {}
    for part in runs(texts):
        w = K.words(part)
        values = [held.setdefault(x, x) for x in forms(w.vocab).to_pylist()]
        out += [[x for c in w.codes[a:b].tolist() if (x := values[c])] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    return out


def trained(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:DICTIONARY_BYTES]


def windows(words: list[str]) -> list[bytes]:
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, len(words), WINDOW)]


def drawn(samples: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Seven tenths of the windows, ``TRAINING_WINDOWS`` at most; all of them if they are few."""
    n = len(samples)
    return [samples[i] for i in rng.choice(n, min(TRAINING_WINDOWS, n * 7 // 10), replace=False)] if n > 200 else samples


def different(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones: those that share one of two MinHash values of five-word shingles with one are left out."""
    seen: set = set()
    out = []
    for part in runs(texts):
        data, start, end, offsets = K.shingle_spans(K.words(part, lower=True), 5)
        h = K.xxh64(data, start, end)
        for t, lo, hi in zip(part.to_pylist(), offsets[:-1], offsets[1:], strict=True):
            own = h[lo:hi]
            keys = {(k, int(K.mix(own ^ np.uint64(k)).min())) for k in (1, 2)} if len(own) else {(0, 0)}
            if not keys & seen:
                out.append(t)
            seen |= keys
    return out


class Model:
    """The pairs of dictionaries, what ordinary windows reach, and the logistic fit."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.ok = bool(toxic and ordinary)
        if not self.ok:
            return
        toxic, ordinary = different(toxic), different(ordinary)
        bad, good = ([w for t in normal(texts) for w in windows(t)] for texts in (toxic, ordinary))
        self.ok = bool(bad and good)
        if not self.ok:
            return
        rng = np.random.default_rng(7)
        self.pairs = [(trained(drawn(good, rng)), trained(drawn(bad, rng))) for _ in range(PAIRS)]
        del bad, good
        self.usual: float | None = None
        parts = [self.distances(part) for part in (*runs(toxic), *runs(ordinary))]
        own = np.concatenate([np.full(int(o[-1]), k < len(list(runs(toxic)))) for k, (_, o) in enumerate(parts)])
        self.usual = float(np.quantile(np.concatenate([d for d, _ in parts])[~own], ORDINARY_SHARE)) if not own.all() else 0.0
        self._fit(np.concatenate([self.summary(*x) for x in parts]), np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"}

    def compressors(self) -> list[tuple]:
        """The compress functions of each pair; made once in each process. The first, which sees every window, searches less."""
        if not hasattr(self, "_ready"):
            make = lambda **how: zstandard.ZstdCompressionParameters(window_log=17, hash_log=13, chain_log=17, min_match=4, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0, **how)
            quick, best = make(strategy=zstandard.STRATEGY_BTLAZY2, search_log=4), make(strategy=zstandard.STRATEGY_BTOPT, search_log=3)
            self._ready = [tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=best if k else quick).compress for d in pair) for k, pair in enumerate(self.pairs)]
        return self._ready

    def distances(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The distance of every window, and the offsets of the texts' windows."""
        w = K.words(text)
        if not len(w.codes):
            return np.zeros(0), np.zeros(len(text) + 1, np.int64)
        coded = forms(w.vocab).dictionary_encode()
        values = coded.dictionary.cast(pa.large_binary()).to_pylist()
        form = coded.indices.to_numpy(zero_copy_only=False)[w.codes]
        some = np.array([bool(v) for v in values])[form]
        form, offsets = form[some], K.keep_where(some, w.offsets)
        n = -(-np.diff(offsets) // WINDOW)
        ends = np.r_[0, np.cumsum(n)]
        start = np.repeat(offsets[:-1] - WINDOW * ends[:-1], n) + WINDOW * np.arange(int(ends[-1]))
        stop = np.minimum(start + WINDOW, np.repeat(offsets[1:], n))
        total = np.zeros(len(start))
        for a in range(0, len(start), 1 << 16):
            part = [b" %b " % b" ".join([values[i] for i in form[x:y].tolist()]) for x, y in zip(start[a : a + (1 << 16)].tolist(), stop[a : a + (1 << 16)].tolist(), strict=True)]
            total[a : a + (1 << 16)] = self._beyond(part) if self.usual is not None else self._each(part)
        return total, ends

    def _each(self, part: list[bytes]) -> np.ndarray:
        each = np.stack([np.fromiter((len(plain(s)) - len(toxic(s)) for s in part), np.int64, len(part)) for plain, toxic in self.compressors()])
        return np.minimum(each, MOST).mean(0) + each.min(0)

    def _beyond(self, part: list[bytes]) -> np.ndarray:
        """The distances, or ``usual`` where pairs so far leave no way above it: the others add MOST to the mean at most."""
        n = len(self.pairs)
        capped, least = np.zeros(len(part)), np.full(len(part), np.inf)
        live = np.arange(len(part))
        for k, (plain, toxic) in enumerate(self.compressors(), 1):
            each = np.fromiter((len(plain(s)) - len(toxic(s)) for s in map(part.__getitem__, live.tolist())), np.int64, len(live))
            capped[live] += np.minimum(each, MOST)
            least[live] = np.minimum(least[live], each)
            live = live[(capped[live] + MOST * (n - k)) / n + least[live] > self.usual]
        out = np.full(len(part), self.usual)
        out[live] = capped[live] / n + least[live]
        return out

    def summary(self, distance: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, of what its windows exceed ``usual`` by: the most, the sum of the three most, of all, and that per log of its windows."""
        n = np.diff(offsets)
        out = np.zeros((len(n), 4))
        over = np.maximum(distance - self.usual, 0)
        at = np.flatnonzero(over)
        of = np.searchsorted(offsets, at, "right") - 1
        order = np.lexsort((-over[at], of))
        of, over = of[order], over[at][order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        for limit, column in ((1, 0), (3, 1), (1 << 60, 2)):
            np.add.at(out[:, column], of[rank < limit], over[rank < limit])
        out[:, 3] = out[:, 2] / np.log(2 + n)
        return out

    def features(self, text: pa.Array) -> np.ndarray:
        return self.summary(*self.distances(text))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps, with a small ridge; toxic texts weigh ``TOXIC_SHARE`` in all."""
        self.center, self.spread = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - self.center) / self.spread, np.ones(len(x))]
        share = np.where(y == 1, TOXIC_SHARE / max(y.sum(), 1), (1 - TOXIC_SHARE) / max((1 - y).sum(), 1)) * len(y)
        ridge = 1e-3 * len(y)
        b = np.zeros(z.shape[1])
        loss = lambda b: (share * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ b))).sum() + ridge / 2 * (b[:-1] ** 2).sum()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            penalty = np.r_[np.full(len(b) - 1, ridge), 1e-9]
            step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (share * (y - p)) - penalty * b)
            while loss(b + step) > loss(b) + 1e-9 and np.abs(step).max() > 1e-9:
                step = step / 2
            b = b + step
            if np.abs(step).max() < 1e-7:
                break
        self.weights = b

    def score(self, text: pa.Array) -> np.ndarray:
        if not self.ok:
            return np.zeros(len(text))
        z = (self.features(text) - self.center) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """Different toxic and ordinary texts, by hash of doc_id, within the bounds.

    Only ids and lengths meet the labels; the texts of the drawn ids, about 1.5 times the bound, follow.
    """
    rank = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxic")), F.lit(1 << 30))
    narrow = docs.select("doc_id", F.octet_length("text").alias("b"))
    known = K.stored(narrow.join(labels, "doc_id").select("doc_id", "toxic", "b", rank.alias("rank")))
    sized = {r[0]: (r[1], r[2]) for r in known.groupBy("toxic").agg(F.count("*"), F.sum("b")).collect()}
    share = {label: min(1.0, 1.5 * size / max(n, 1), 1.5 * most / max(b or 0, 1)) for label, (n, b) in sized.items()}
    picked = [r for label in share for r in known.where((F.col("toxic") == label) & (F.col("rank") <= F.lit(share[label] * (1 << 30)))).select("doc_id", "toxic", "rank").distinct().collect()]
    out: dict[int, list[str]] = {1: [], 0: []}
    if picked:
        ids = docs.sparkSession.createDataFrame(picked, known.select("doc_id", "toxic", "rank").schema)
        drawn = docs.join(F.broadcast(ids), "doc_id").select("toxic", "rank", "text").collect()  # ids: the bounded sample
        for r in sorted(drawn, key=lambda r: (r["rank"], r["text"])):
            out[r["toxic"]].append(r["text"])
    for label in out:
        texts = list(dict.fromkeys(out[label]))[:size]
        ends = np.cumsum([len(t) for t in texts])
        out[label] = [t for t, e in zip(texts, ends, strict=True) if e <= most or e == ends[0]]
    return out[1], out[0]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents; rows of a null text or label are left out."""
    known = K.columns_of(labels, "doc_id", "toxic").where("toxic IN (0, 1)")
    return Model(*sample(K.columns_of(docs, "doc_id", "text").where("text IS NOT NULL"), known))


def with_scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys((*keep, "text")))
    source = K.columns_of(docs, *columns)
    schema = K.columns_of(docs, *keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            score = shared.value.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            yield b.filter(pa.array(shared.value.score(b.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.read(spark, sf_dir, "documents").withColumn("held_out", K.fold("doc_id", 3) == 1)
    labels = K.read(spark, sf_dir, "labels").where(K.fold("doc_id", 3) != 1)
    return with_scores(docs, fit(docs.where("NOT held_out"), labels), ("doc_id", "held_out"))
