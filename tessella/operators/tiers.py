"""Label tiers: conversions, interval algebra, alignment metrics, text formats, constrained decoding, G2P."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_durations(df: DataFrame, key: str, duration: str, order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Adds start and end by running sums of durations in order."""
    end = F.sum(duration).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(duration))


def points_to_intervals(df: DataFrame, key: str) -> DataFrame:
    """Each point lasts to the next; the last one only ends the tier."""
    return df.withColumn("end", F.lead("time").over(Window.partitionBy(key).orderBy("idx"))).where(F.col("end").isNotNull()).select(key, "idx", F.col("time").alias("start"), "end", "mark")


def without_ignored(df: DataFrame, key: str, ignored: list[str]) -> DataFrame:
    """Drops an ignored first point, and an ignored point whose predecessor is ignored too."""
    prev = F.lag("mark").over(Window.partitionBy(key).orderBy("idx"))
    first = F.lag("idx").over(Window.partitionBy(key).orderBy("idx")).isNull()
    return df.withColumn("__d", F.col("mark").isin(*ignored) & (first | prev.isin(*ignored))).where(~F.col("__d")).drop("__d")


def bucketed(df: DataFrame, width: float) -> DataFrame:
    return df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def overlaps(a: DataFrame, b: DataFrame, on: list[str], width: float) -> DataFrame:
    """Pairs of overlapping intervals: an equi-join on coarse time buckets, each pair reported in its first common one."""
    left, right = bucketed(a, width), bucketed(b.withColumnsRenamed({"start": "b_start", "end": "b_end"}).withColumn("start", F.col("b_start")).withColumn("end", F.col("b_end")), width).drop("start", "end")
    both = left.join(right, [*on, "__bucket"]).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))
    return both.where(F.col("__bucket") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("b_start") / width))).drop("__bucket")


def difference(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """(key, idx, start, end): the parts of each interval of a that no interval of b covers."""
    hit = overlaps(a, b.select(key, "start", "end"), [key], width).select(key, "idx", "start", "end", F.greatest("b_start", "start").alias("s"), F.least("b_end", "end").alias("e"))
    w = Window.partitionBy(key, "idx").orderBy("s", "e")
    seen = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = hit.withColumn("from", F.coalesce(seen, F.col("start"))).withColumn("far", F.max("e").over(Window.partitionBy(key, "idx")))
    holes = rows.where(F.col("from") < F.col("s")).select(key, "idx", F.col("from").alias("start"), F.col("s").alias("end"))
    tails = rows.where(F.col("far") < F.col("end")).select(key, "idx", F.col("far").alias("start"), "end").distinct()
    return holes.union(tails).union(a.select(key, "idx", "start", "end").join(hit.select(key, "idx").distinct(), [key, "idx"], "left_anti"))


def iou(pred: DataFrame, target: DataFrame, key: str, width: float) -> DataFrame:
    """(mark, iou): overlap of equal marks over their union, six places; NULL for an empty union."""
    inter = overlaps(pred, target.select(key, "mark", "start", "end"), [key, "mark"], width).groupBy("mark").agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("i"))
    total = pred.select("mark", "start", "end").union(target.select("mark", "start", "end")).groupBy("mark").agg(F.sum(F.col("end") - F.col("start")).alias("t"))
    i = F.coalesce("i", F.lit(0.0))
    return total.join(inter, "mark", "left").select("mark", F.round(F.try_divide(i, F.col("t") - i), 6).alias("iou"))


def boundary_distance(pred: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, same, distance, span): positional distance of point tiers; ``same`` is false where marks or lengths differ."""
    p, t = pred.select(key, "idx", F.col("time").alias("p"), F.col("mark").alias("pm")), target.select(key, "idx", F.col("time").alias("t"), F.col("mark").alias("tm"))
    g = p.join(t, [key, "idx"], "full_outer").groupBy(key)
    return g.agg(F.every(F.coalesce(F.col("pm") == F.col("tm"), F.lit(False))).alias("same"), F.sum(F.abs(F.col("p") - F.col("t"))).alias("distance"), (F.max("t") - F.min("t")).alias("span"))


def edit_count(pred: list[tuple[float, str]], target: list[tuple[float, str]], tolerance: float = 20.0) -> int:
    """Edits that turn one point tier into another: insert 1 (2 for a new mark), delete 1, move 1, rename 1."""
    n, m = len(pred), len(target)
    d = np.zeros((n + 1, m + 1), int)
    d[:, 0], d[0, :] = np.arange(n + 1), 2 * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            (pt, pm), (tt, tm) = pred[i - 1], target[j - 1]
            insert = 1 + (j == 1 or tm != target[j - 2][1])
            move = int(abs(pt - tt) > tolerance) + int(pm != tm)
            d[i, j] = min(d[i, j - 1] + insert, d[i - 1, j] + 1, d[i - 1, j - 1] + move)
    return int(d[n, m])


def edit_counts(df: DataFrame, key: str, tolerance: float = 20.0) -> DataFrame:
    """(key, edits, most): from rows with arrays pred and target of struct(time, mark)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tier = lambda x: [(r["time"], r["mark"]) for r in x]
            yield pd.DataFrame({key: b[key], "edits": [edit_count(tier(p), tier(t), tolerance) for p, t in zip(b["pred"], b["target"], strict=True)], "most": [2 * len(t) - 2 for t in b["target"]]})

    return df.select(key, "pred", "target").mapInPandas(run, df.select(key).schema.add("edits", "long").add("most", "long"))


def viterbi(log_prob: np.ndarray, edge: np.ndarray, pause: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and confidence of each frame. log_prob: frames by states in order; pause: states that may be skipped.

    A frame stays in its state or advances by one, or by two over a pause. An advance is scored by the state that it
    leaves, plus that state's best frame so far weighted by frames per state (pauses have no such bonus).
    """
    frames, states = log_prob.shape
    stay, go = np.log(np.clip(1 - edge, 1e-6, 1)), np.log(np.clip(edge, 1e-6, 1))
    score, back = np.full((frames, states), -np.inf), np.zeros((frames, states), int)
    best = np.full(states, -np.inf)
    for s in (0, 1) if states > 1 and pause[0] else (0,):
        score[0, s] = best[s] = log_prob[0, s]
    best = np.where(pause, 0.0, best)
    for t in range(1, frames):
        leave = score[t - 1] + log_prob[t] + go[t] + np.where(np.isneginf(best), 0.0, best) * (frames / states)
        choices = np.full((3, states), -np.inf)
        choices[0] = score[t - 1] + log_prob[t] + stay[t]
        choices[1, 1:] = leave[:-1]
        choices[2, 2:] = np.where(pause[1:-1], leave[:-2], -np.inf)
        back[t], score[t] = choices.argmax(0), choices.max(0)
        best = np.where(pause, 0.0, np.where(back[t] == 0, np.maximum(best, log_prob[t]), log_prob[t]))
    state = states - 2 if states > 1 and pause[-1] and score[-1, -2] > score[-1, -1] else states - 1
    path = np.zeros(frames, int)
    for t in range(frames - 1, -1, -1):
        path[t] = state
        state -= back[t, state]
    along = score[np.arange(frames), path]
    return path, np.exp(np.minimum(np.diff(along, prepend=0.0), 0.0))


def align(df: DataFrame, key: str) -> DataFrame:
    """(key, path, confidence): from rows with arrays log_prob (array of arrays), edge and pause."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [viterbi(np.array([list(r) for r in p], float), np.array(e, float), np.array(z, bool)) for p, e, z in zip(b["log_prob"], b["edge"], b["pause"], strict=True)]
            yield pd.DataFrame({key: b[key], "path": [o[0].tolist() for o in out], "confidence": [float(np.exp(np.mean(np.log(o[1] + 1e-6)) / 3)) for o in out]})

    return df.select(key, "log_prob", "edge", "pause").mapInPandas(run, df.select(key).schema.add("path", "array<int>").add("confidence", "double"))


def srt_text(cues: DataFrame, key: str, legacy: bool = False) -> DataFrame:
    """(key, srt): numbered cues in order of start."""
    from tessella.functions.scalars import timestamp

    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "pos"))
    block = F.concat_ws("\n", F.col("n").cast("string"), F.concat_ws(" --> ", timestamp(F.col("start"), legacy), timestamp(F.col("end"), legacy)), "text", F.lit(""))
    return cues.withColumn("n", n).select(key, "n", block.alias("block")).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("srt"))


def htk_lines(df: DataFrame, key: str, truncate: bool = True) -> DataFrame:
    """(key, lab): ``start end mark`` lines in 100 ns ticks."""
    from tessella.functions.scalars import to_ticks

    line = F.concat_ws(" ", to_ticks(F.col("start"), truncate).cast("string"), to_ticks(F.col("end"), truncate).cast("string"), "mark")
    return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("lab"))


def g2p_dictionary(words: Column, phones: Column) -> Column:
    """Phones of words with SP after each and none at the edges; words outside the dictionary (a map) are left out."""
    known = F.filter(words, lambda w: F.map_contains_key(phones, w))
    return F.concat(F.array(F.lit("SP")), F.flatten(F.transform(known, lambda w: F.concat(F.element_at(phones, w), F.array(F.lit("SP"))))))


def g2p_none(phones: Column) -> Column:
    """Runs of SP collapsed, SP at both ends."""
    padded = F.concat(F.array(F.lit("SP")), phones, F.array(F.lit("SP")))
    return F.filter(F.transform(padded, lambda p, i: F.when((i > 0) & (p == "SP") & (F.get(padded, i - 1) == "SP"), F.lit(None)).otherwise(p)), lambda p: p.isNotNull())


def g2p_phoneme(phones: Column) -> Column:
    """SP between all phones and at both ends."""
    return F.concat(F.array(F.lit("SP")), F.flatten(F.transform(phones, lambda p: F.array(p, F.lit("SP")))))


def vocabulary(df: DataFrame, column: str, ignored: list[str]) -> DataFrame:
    """(phone, id): distinct phones without ignored ones, SP first, then in order."""
    seen = df.select(F.explode(column).alias("phone")).distinct().where(~F.col("phone").isin("SP", *ignored))
    rest = seen.withColumn("id", F.row_number().over(Window.orderBy("phone")).cast("int"))  # a vocabulary is small
    return rest.union(df.sparkSession.range(1).select(F.lit("SP"), F.lit(0)))
