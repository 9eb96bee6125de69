"""Quality rules as a short-circuit cascade.

A rule has a statistic, computed for many texts at once, and a verdict on it. ``plan_cascade`` times each
rule on a sample of about ``SAMPLE_ROWS`` rows from all parts and counts what it rejects there, then orders the rules by
rejections per second. ``cascade`` applies them in that order; a text that one rule rejects is not
looked at by the next. The verdict is a conjunction, so the order changes only the cost.

Null texts count as empty and are rejected; empty tables give empty results; ties in the order fall back
to the rules' names; repeated rows are judged alike; extra columns pass through ``cascade`` unchanged.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS, SAMPLE_TASKS = 1000, 4
WINDOW = 5


class Batch:
    """Texts with the parts that several rules share; each part is made when first asked for."""

    def __init__(self, text: pa.Array):
        self.text = K.plain(text)
        self._made: dict[str, object] = {}

    def part(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def take(self, rows: np.ndarray) -> Batch:
        out = Batch(self.text.take(pa.array(rows)))
        if "words" in self._made:  # split once, whatever rules follow
            n, first = self.words.counts[rows], self.words.offsets[:-1][rows]
            ends = np.r_[0, np.cumsum(n)]
            out._made["words"] = K.Words(self.words.codes[np.repeat(first - ends[:-1], n) + np.arange(int(ends[-1]))], self.words.vocab, ends)
        return out

    @property
    def words(self) -> K.Words:
        return self.part("words", lambda: K.words(self.text))

    @property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @property
    def word_chars(self) -> np.ndarray:
        w = self.words
        return K.row_sums(pc.utf8_length(w.vocab).to_numpy(zero_copy_only=False).astype(np.int64)[w.codes], w.offsets)

    def matches(self, pattern: str) -> np.ndarray:
        return self.part(pattern, lambda: pc.count_substring_regex(self.text, pattern).to_numpy(zero_copy_only=False).astype(np.int64))

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word of each text, and those of them that equal an earlier one."""

        def make():
            flat, offsets = K.split_lists(pc.split_pattern(self.text, "\n"))
            used = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
            flat, offsets = flat.filter(pa.array(used)), K.keep_where(used, offsets)
            codes = flat.dictionary_encode()
            key = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * max(1, len(codes.dictionary)) + codes.indices.to_numpy(zero_copy_only=False)
            first = np.zeros(len(key), bool)
            first[np.unique(key, return_index=True)[1]] = True
            return np.diff(offsets), K.row_sums((~first).astype(np.int64), offsets)

        return self.part("lines", make)

    @property
    def repeat_words(self) -> np.ndarray:
        return self.part("repeat", lambda: repeated_words(self.words))


def repeated_words(w: K.Words, size: int = WINDOW) -> np.ndarray:
    """Words inside windows of ``size`` words that occur twice or more in their text, the first included."""
    counts = w.counts
    number = np.maximum(counts - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), number)
    first = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(w.offsets[:-1], number)
    key = K.mix(row.astype(np.uint64) + np.uint64(1))
    for k in range(size):
        key = K.mix(key ^ (w.codes[first + k].astype(np.uint64) + np.uint64(k << 40)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if same.any():  # hashes propose, words decide
        a, b = order[:-1][same], order[1:][same]
        equal = row[a] == row[b]
        for k in range(size):
            equal &= w.codes[first[a] + k] == w.codes[first[b] + k]
        if not equal.all():
            return _repeated_exact(w, size)
    twice = np.zeros(len(key), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    cover = np.zeros(len(w.codes) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + size, -1)
    return K.row_sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), w.offsets)


def _repeated_exact(w: K.Words, size: int) -> np.ndarray:
    out = np.zeros(len(w.offsets) - 1, np.int64)
    for r, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
        if b - a >= size:
            grams = np.lib.stride_tricks.sliding_window_view(w.codes[a:b], size)
            _, inverse, n = np.unique(grams, axis=0, return_inverse=True, return_counts=True)
            marked = np.zeros(b - a, bool)
            for i in np.flatnonzero(n[inverse.ravel()] > 1):
                marked[i : i + size] = True
            out[r] = marked.sum()
    return out


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Batch], np.ndarray]


#: The default rules; ratios are written as integer comparisons, so that SQL agrees exactly.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda b: b.n_words < 10),
    Rule("repeated_windows", lambda b: 100 * b.repeat_words > 20 * b.n_words),
    Rule("symbols", lambda b: 10 * b.matches("[#*$%&|<>]") > 3 * b.n_words),
    Rule("shouting", lambda b: 10 * b.matches("[!?]") > 5 * b.n_words),
    Rule("duplicate_lines", lambda b: 10 * b.lines[1] > 5 * b.lines[0]),
    Rule("word_length", lambda b: (b.word_chars < 2 * b.n_words) | (b.word_chars > 20 * b.n_words)),
)
BASE = ("few_words", "repeated_windows")


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on about ``sample_rows`` rows drawn from all parts of the table.

    The sample is measured where it lies, in ``SAMPLE_TASKS`` tasks; the driver sees two sums for each rule.
    """
    texts = K.columns_of(docs, "text")
    drawn = texts.sample(fraction=min(1.0, sample_rows / max(1, texts.count())), seed=17).repartition(SAMPLE_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, warm = [0.0] * len(rules), [0] * len(rules), False
        for b in K.slices(batches):
            if not warm:  # the first use of a kernel costs more
                warm = [rule.rejects(Batch(b.column("text").slice(0, 1))) for rule in rules]
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                rejected[k] += int(np.sum(rule.rejects(Batch(b.column("text")))))
                seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds, pa.float64()), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    measured = drawn.mapInArrow(run, "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    worth = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in measured.collect()}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-worth.get(k, 0.0), rules[k].name))]


def verdicts(batch: Batch, ordered: list[Rule]) -> np.ndarray:
    """Which texts all rules keep; each rule sees only what the earlier ones kept."""
    kept, left = np.zeros(len(batch.text), bool), np.arange(len(batch.text))
    for rule in ordered:
        if not len(left):
            break
        good = np.flatnonzero(~rule.rejects(batch))
        if len(good) < len(left):
            batch, left = batch.take(good), left[good]
    kept[left] = True
    return kept


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, ordered: list[Rule] | None = None) -> DataFrame:
    """The rows that every rule keeps, with all their columns."""
    ordered = ordered or plan_cascade(docs, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            kept = verdicts(Batch(b.column("text")), ordered)
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def statistics(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base statistics of every document and the cascade's verdict."""
    ordered = plan_cascade(docs, tuple(r for r in rules if r.name not in BASE), sample_rows)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            t = Batch(b.column("text"))
            base = {r.name: r.rejects(t) for r in rules if r.name in BASE}
            failed = np.logical_or.reduce([*base.values(), np.zeros(b.num_rows, bool)])
            kept = ~failed
            alive = np.flatnonzero(kept)
            if len(alive):
                kept[alive] = verdicts(t if len(alive) == b.num_rows else t.take(alive), ordered)
            columns = [t.n_words, t.word_chars, t.matches("[#*$%&|<>]"), t.lines[1], t.repeat_words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(failed), pa.array(kept)], names=["doc_id", *fields, "base_failed", "kept"])

    source = K.columns_of(docs, "doc_id", "text")
    schema = source.select("doc_id").schema
    for f in fields:
        schema = schema.add(f, "long")
    return source.mapInArrow(run, schema.add("base_failed", "boolean").add("kept", "boolean"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(K.read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
used AS (SELECT rid, line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM used GROUP BY rid),
pos AS (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM pos),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n_rep FROM (SELECT rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS j FROM twice) GROUP BY rid),
s AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(n_rep, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[!?]')) AS n_shout
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_shout > 5 * n_words
    OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM s
"""
